"""Genomic views over the benchmark tables: genome, reads, regions, exclusions, features, variants.

The SQL is FIXTURES.md's; only reads are made in another way here: each alignment's bases are fetched
from the genome's tiles by an equi join, so that no task ever holds a contig. The genome's tiles and the reads stand for a FASTA and
a BAM file: they are written once for each directory and session, in the shared folder, and every query reads them from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bam, bcf, fasta, files, text

_N = "(select cast(floor(count(*) / 3) as bigint) from {orders})"

GENOME = """
select concat('c', cast(o_orderkey % 3 as string)) as contig, cast(floor(o_orderkey / 3) as bigint) as pos,
  translate(substr(md5(concat('g', cast(o_orderkey as string))), 1, 1), '0123456789abcdef', 'ACGTACGTACGTACGN') as refnuc
from {orders}"""

STARTS = f"""
select event_id as read_id, concat('c', cast(event_id % 3 as string)) as contig,
  (event_id * 7919) % ({_N} - 60) as pos,
  cast(case when event_id % 2 = 0 then 16 else 0 end + case when event_id % 4 < 2 then 65 else 129 end
     + case when event_id % 23 = 0 then 256 else 0 end + case when event_id % 7 = 0 then 0 else 2 end as int) as flags,
  cast(case when event_id % 17 = 0 then 0 when event_id % 19 = 0 then 255 else event_id % 61 end as int) as mapq,
  case event_id % 10 when 0 then '10M5N30M' when 1 then '3S37M' when 2 then '16M2D24M'
                     when 3 then '8M2I30M' when 4 then '5H20=1X19M' else '40M' end as cigar,
  translate(substr(concat(md5(concat('q', cast(event_id as string))), md5(concat('r', cast(event_id as string)))), 1, 40),
            '0123456789abcdef', '!+5?IIIIIIIIIIII') as qual
from {{events}}"""

SEQUENCED = """
select r.read_id, r.contig, r.pos, r.flags, r.mapq, r.cigar,
  case when r.read_id % 5 = 0 then translate(r.s, 'A', 'G')
       else concat(substr(r.s, 1, cast(r.read_id % 40 as int)),
                   translate(substr(r.s, cast(r.read_id % 40 as int) + 1, 1), 'ACGT', 'GTCA'),
                   substr(r.s, cast(r.read_id % 40 as int) + 2)) end as seq,
  r.qual
from {r} r"""

ROIS = f"""
select cast(p_partkey as bigint) as roi_id, concat('c', cast(p_partkey % 3 as string)) as contig,
  cast((p_partkey * 131) % ({_N} - 300) as bigint) as start_,
  cast((p_partkey * 131) % ({_N} - 300) + 20 + p_partkey % 150 as bigint) as end_,
  p_brand as name, case p_size % 3 when 0 then '+' when 1 then '-' else '.' end as strand
from {{part}}"""

EXCLUDE = f"""
select cast(s_suppkey as bigint) as ex_id, concat('c', cast(s_suppkey % 3 as string)) as contig,
  cast((s_suppkey * 379) % ({_N} - 100) as bigint) as start_,
  cast((s_suppkey * 379) % ({_N} - 100) + 10 + s_suppkey % 60 as bigint) as end_
from {{supplier}}"""

GFF = f"""
select cast(c_custkey as bigint) as feat_id, concat('c', cast(c_custkey % 3 as string)) as contig,
  case when c_custkey % 5 = 0 then 'gene' when c_custkey % 5 = 4 then 'CDS' else 'exon' end as type,
  cast((c_custkey * 97) % ({_N} - 60) + 1 as bigint) as start1,
  cast((c_custkey * 97) % ({_N} - 60) + case when c_custkey % 5 = 0 then 30 else 4 + c_custkey % 20 end as bigint) as end1,
  case when c_custkey % 11 = 0 then '.' when c_nationkey % 2 = 0 then '+' else '-' end as strand
from {{customer}}"""

VCF = """
select contig, pos + 1 as pos1, refnuc as ref,
  case when k % 13 = 0 then 'CT' when k % 7 = 0 then concat(translate(refnuc, 'ACGT', 'CATG'), ',', translate(refnuc, 'ACGT', 'GTAC'))
       else translate(refnuc, 'ACGT', 'GTAC') end as alt,
  case when k % 17 = 0 then 'q10' else 'PASS' end as filter_,
  case when k % 7 = 0 then '1/2' when k % 5 = 0 then '0/0' when k % 3 = 0 then '1|1' when k % 11 = 0 then './1'
       when k % 19 = 0 then '.' else '0/1' end as gt
from (select concat('c', cast(o_orderkey % 3 as string)) as contig, cast(floor(o_orderkey / 3) as bigint) as pos, o_orderkey as k,
        translate(substr(md5(concat('g', cast(o_orderkey as string))), 1, 1), '0123456789abcdef', 'ACGTACGTACGTACGN') as refnuc
      from {orders} where o_orderkey % 29 = 0) v"""

READ_LENGTH = 40


_WRITTEN: dict[tuple[str, str, str], str] = {}
_FILES: dict[tuple[str, str, str], list[str]] = {}
#: Files that reads and variants are written to.
PARTS = 8


class Fixtures:
    """The views over one directory of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def _sql(self, query: str, **extra: DataFrame) -> DataFrame:
        names = [n for n in ("orders", "events", "part", "supplier", "customer") if f"{{{n}}}" in query]
        tables = {n: self.spark.read.parquet(f"{self.sf_dir}/{n}.parquet") for n in names}
        return self.spark.sql(query, **tables, **extra)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            path = self.folder(name)
            files.stored(make(), path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    def prepare(self) -> None:
        """Writes what is written once."""
        self.tiles(), self.reads()

    def folder(self, name: str) -> str:
        return files.fresh(self.spark, name)

    def _written(self, name: str, write: Callable[[str], list[str]]) -> list[str]:
        """Paths of files that are written once."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _FILES:
            _FILES[key] = write(self.folder(name))
        return _FILES[key]

    def contigs(self) -> list[tuple[str, int]]:
        tiles = self.tiles().groupBy("contig").agg(F.max(F.col("tile") * text.TILE + F.length("seq")).alias("len"))
        return [(r["contig"], r["len"]) for r in tiles.orderBy("contig").collect()]

    def bam_files(self) -> list[str]:
        """The reads as sorted and indexed BAM files; a read's name is its number."""

        def write(folder: str) -> list[str]:
            files.make_dir(self.spark, folder)
            return bam.write_parts(self.reads().withColumn("name", F.concat(F.lit("r"), "read_id")), folder, self.contigs(), PARTS)

        return self._written("bam", write)

    def fasta_file(self, index: bool = True) -> str:
        """The genome in lines of 64 bases, with signs in its headers that start records elsewhere."""

        def write(folder: str) -> list[str]:
            lines = F.regexp_replace(F.regexp_replace("seq", "(.{64})", "$1\n"), "\n$", "")
            head = F.when(F.col("tile") == 0, F.concat(F.lit(">"), "contig", F.lit(" A>G\tlen=1\n"))).otherwise("")
            self.tiles().orderBy("contig", "tile").select(F.concat(head, lines).alias("value")).write.text(f"{folder}/parts")
            files.join_parts(self.spark, f"{folder}/parts", f"{folder}/genome.fa", "")
            if index:
                files.replace_text(self.spark, f"{folder}/genome.fa.fai", fasta.make_index(f"{folder}/genome.fa"))
            return [f"{folder}/genome.fa"]

        return self._written(f"fasta {index}", write)[0]

    def bed_file(self, rows: DataFrame, name: str) -> str:
        """``rows`` (contig, start_, end_, and name and strand where there are) as gzipped BED."""
        more = ["name", F.lit("0"), "strand"] if "name" in rows.columns else []
        line = F.concat_ws("\t", "contig", "start_", "end_", *more).alias("value")
        return self._text_file(f"{name}.bed", rows.select(line))

    def _text_file(self, name: str, lines: DataFrame) -> str:
        def write(folder: str) -> list[str]:
            lines.write.option("compression", "gzip").text(folder)
            return [folder]

        return self._written(name, write)[0]

    def gff_file(self) -> str:
        line = F.concat_ws("\t", "contig", F.lit("src"), "type", "start1", "end1", F.lit("."), "strand", F.lit("."), F.lit("ID=x"))
        return self._text_file("gff", self.gff_raw().select(line.alias("value")))

    def vcf_file(self) -> str:
        line = F.concat_ws("\t", "contig", "pos1", F.lit("."), "ref", "alt", F.lit("50"), "filter_", F.lit("."), F.lit("DP:GT"), F.concat(F.lit("9:"), F.col("gt")))
        return self._text_file("vcf", self.vcf_raw().select(line.alias("value")))

    def bcf_files(self) -> list[str]:
        def write(folder: str) -> list[str]:
            files.make_dir(self.spark, folder)
            return bcf.write_parts(self.vcf(), folder, self.contigs(), ["q10"], PARTS)

        return self._written("bcf", write)

    def genome(self) -> DataFrame:
        """(contig, pos, refnuc) of every position."""
        return text.positions(self.tiles())

    def tiles(self) -> DataFrame:
        return self._once("tiles", lambda: text.tiles_of(self._sql(GENOME)))

    def reads(self) -> DataFrame:
        def make() -> DataFrame:
            starts = self._sql(STARTS)
            ends = starts.select("read_id", "contig", "pos", (F.col("pos") + READ_LENGTH).alias("stop"))
            fetched = text.fetch(self.tiles(), ends, "read_id", "pos", "stop")
            return self._sql(SEQUENCED, r=starts.join(fetched.withColumnRenamed("seq", "s"), "read_id"))

        return self._once("reads", make)

    def rois(self) -> DataFrame:
        return self._sql(ROIS)

    def exclude(self) -> DataFrame:
        return self._sql(EXCLUDE)

    def gff_raw(self) -> DataFrame:
        return self._sql(GFF)

    def gff(self) -> DataFrame:
        """Exons and genes with a strand, half-open."""
        raw = self.gff_raw().where("type in ('exon', 'gene') and strand in ('+', '-')")
        return raw.select("contig", (F.col("start1") - 1).alias("start_"), F.col("end1").alias("end_"), "type", "strand")

    def vcf_raw(self) -> DataFrame:
        return self._sql(VCF)

    def vcf(self) -> DataFrame:
        return self.vcf_raw().select("contig", (F.col("pos1") - 1).alias("pos"), "ref", "alt", "filter_", "gt")
