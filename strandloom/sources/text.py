"""BED, GFF3 and VCF text, tiles of a genome, and tables that are written. Files whose name ends in gz are decompressed by their extension.

The parsers take a DataFrame with a ``value`` column of lines, so they work on any source of lines.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .fasta import TILE, read_fasta  # noqa: F401  tiles come from FASTA


def _field(number: int):
    return F.get(F.split("value", "\t"), number - 1)


def parse_bed(lines: DataFrame) -> DataFrame:
    """(contig, start_, end_, name, strand): three columns at least; no name is empty, no strand is a dot. Empty lines are skipped."""
    rows = lines.where(F.trim("value") != "")
    strand = F.substring(F.coalesce(_field(6), F.lit("")), 1, 1)
    start, end = _field(2).cast("bigint"), _field(3).cast("bigint")
    fine = F.assert_true(end > start, F.concat(F.lit("a BED interval must end after its start: "), F.col("value")))
    return rows.select(
        _field(1).alias("contig"), start.alias("start_"), F.coalesce(fine.cast("bigint"), end).alias("end_"), F.coalesce(_field(4), F.lit("")).alias("name"), F.when(strand.isin("+", "-"), strand).otherwise(".").alias("strand")
    )


def parse_gff(lines: DataFrame) -> DataFrame:
    """(contig, start_, end_, type, strand) of exons and genes with a strand; half-open from 0."""
    rows = lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    parsed = rows.select(_field(1).alias("contig"), (_field(4).cast("bigint") - 1).alias("start_"), _field(5).cast("bigint").alias("end_"), F.lower(_field(3)).alias("type"), _field(7).alias("strand"), _field(3).alias("raw"))
    return parsed.where(F.col("raw").isin("exon", "Exon", "gene", "Gene") & F.col("strand").isin("+", "-")).drop("raw")


def parse_vcf(lines: DataFrame) -> DataFrame:
    """(contig, pos, ref, alt, filter_, gt) of a file with one sample; pos from 0. More or fewer samples are an error."""
    rows = lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    keys, values = F.split(_field(9), ":"), F.split(_field(10), ":")
    gt = F.get(values, F.array_position(keys, F.lit("GT")).cast("int") - 1)
    single = F.assert_true(F.size(F.split("value", "\t")) == 10, F.concat(F.lit("a VCF file must have exactly one sample: "), F.col("value")))
    pos = F.coalesce(single.cast("bigint"), _field(2).cast("bigint") - 1)
    return rows.select(_field(1).alias("contig"), pos.alias("pos"), _field(4).alias("ref"), _field(5).alias("alt"), _field(7).alias("filter_"), F.coalesce(gt, F.lit(".")).alias("gt"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(spark.read.text(path))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """BED rows with a ``roi_id``, so that equal rows stay apart."""
    return read_bed(spark, path).withColumn("roi_id", F.monotonically_increasing_id())


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_gff(spark.read.text(path))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Of a VCF file, or of a BCF file by its name's end."""
    if path.endswith(".bcf"):
        from .bcf import read_bcf

        return read_bcf(spark, path)
    return parse_vcf(spark.read.text(path))


def tiles_of(genome: DataFrame) -> DataFrame:
    """Tiles of a genome that comes as (contig, pos, refnuc)."""
    at = F.floor(F.col("pos") / TILE).cast("bigint")
    return genome.groupBy("contig", at.alias("tile")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "refnuc"))), lambda x: x["refnuc"]), "").alias("seq"))


def letter(base: Column) -> Column:
    """Upper case; letters but A, C, G and T are N."""
    upper = F.upper(base)
    return F.when(upper.isin("A", "C", "G", "T"), upper).otherwise("N")


def positions(tiles: DataFrame) -> DataFrame:
    """(contig, pos, refnuc) of tiles."""
    cells = tiles.select("contig", "tile", F.posexplode(F.split("seq", "")).alias("k", "base"))
    return cells.select("contig", (F.col("tile") * TILE + F.col("k")).alias("pos"), letter(F.col("base")).alias("refnuc"))


def tile_of(pos: Column) -> Column:
    return F.shiftright(pos, TILE.bit_length() - 1)


def fetch(tiles: DataFrame, ranges: DataFrame, key: str, start: str = "start_", end: str = "end_") -> DataFrame:
    """(key, seq): the bases of each range, from the tiles that it touches."""
    touched = F.sequence(F.floor(F.col(start) / TILE).cast("bigint"), F.floor((F.col(end) - 1) / TILE).cast("bigint"))
    spread = ranges.where(F.col(end) > F.col(start)).select(key, "contig", F.col(start).alias("s"), F.col(end).alias("e"), F.explode(touched).alias("tile"))
    first = F.greatest(F.col("s") - F.col("tile") * TILE, F.lit(0))
    last = F.least(F.col("e") - F.col("tile") * TILE, F.lit(TILE))
    part = F.substring("seq", first.cast("int") + 1, (last - first).cast("int"))
    pieces = spread.join(tiles, ["contig", "tile"]).select(key, "tile", part.alias("part"))
    return pieces.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tile", "part"))), lambda x: x["part"]), "").alias("seq"))


def contigs(parts: DataFrame) -> DataFrame:
    """(contig, len) of (contig, len) rows from several headers, which must agree."""
    agreed = parts.groupBy("contig").agg(F.max("len").alias("len"), F.countDistinct("len").alias("n"))
    checked = F.assert_true(F.col("n") == 1, F.concat(F.lit("headers disagree on the length of "), F.col("contig")))
    return agreed.select("contig", F.coalesce(checked.cast("bigint"), F.col("len")).alias("len"))


def _line(values: list) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(["" if v is None else v for v in values])
    return out.getvalue()


def write_table(result: DataFrame, path: str, mode: str = "error") -> None:
    """The folder ``path`` with one CSV file, ``table.csv``, with a header; rows in the order they have.

    Sorted parts are written in parallel and then joined as streams: no task holds the table.
    """
    spark = result.sparkSession
    if files.exists(spark, path):
        if mode != "overwrite":
            raise FileExistsError(path)
        files.delete(spark, path)
    result.write.csv(f"{path}/_parts")
    files.join_parts(spark, f"{path}/_parts", f"{path}/table.csv", _line(result.columns))
    files.delete(spark, f"{path}/_parts")


def append_index(row: DataFrame, path: str) -> None:
    """Adds a run's editing index to the file ``path``; a new file gets a header, one that is there only rows."""
    spark = row.sparkSession
    old = "".join(f"{r['value']}\n" for r in spark.read.text(path).collect()) if files.exists(spark, path) else _line(row.columns)
    files.replace_text(spark, path, old + "".join(_line(list(r)) for r in row.collect()))
