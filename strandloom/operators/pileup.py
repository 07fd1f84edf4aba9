"""Alignments to observations: CIGAR expansion, trimming, matched blocks, counts by position.

``bases`` gives a row per observed base: an alignment's CIGAR is folded once, inside the row, to its aligned blocks: the reference
and read offsets at which bases stand over each other. Counts are made of ``pieces``, what a block has in a tile of the genome:
these are shuffled by tile, and a task counts one tile after another (``kernels``), however many positions there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nucleotides import ACGT, count_column, normalize
from ..functions.strands import deduce, of_read
from ..sources import text
from . import intervals, kernels
from .filters import PHRED

_BLOCKS = "array<struct<ref:bigint,query:bigint,len:bigint>>"


def aligned_blocks(cigar: Column) -> Column:
    """Blocks of M, = and X by offset: from the alignment's start, from the read's first stored base."""
    kinds = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    sizes = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))

    def step(done: Column, op: Column) -> Column:
        n, kind = op["n"].cast("bigint"), op["kind"]
        block = F.array(F.struct(done["ref"].alias("ref"), done["query"].alias("query"), n.alias("len")))
        return F.struct(
            (done["ref"] + F.when(kind.isin("M", "=", "X", "D", "N"), n).otherwise(0)).alias("ref"),
            (done["query"] + F.when(kind.isin("M", "=", "X", "S", "I"), n).otherwise(0)).alias("query"),
            F.when(kind.isin("M", "=", "X"), F.concat(done["out"], block)).otherwise(done["out"]).alias("out"),
        )

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("ref"), zero.alias("query"), F.array().cast(_BLOCKS).alias("out"))
    return F.aggregate(F.arrays_zip(sizes.alias("n"), kinds.alias("kind")), start, step, lambda done: done["out"])


def reference_length(cigar: Column) -> Column:
    """Reference bases that an alignment spans."""
    sizes = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda total, n: total + n.cast("bigint"))


def trimmed_blocks(trim5: int = 0, trim3: int = 0) -> Column:
    """Aligned blocks cut to the part of the read that trimming leaves, in the read's own direction."""
    blocks, total = aligned_blocks(F.col("cigar")), F.length("seq").cast("bigint")
    if not (trim5 or trim3):
        return blocks
    forward = of_read(F.col("flags")) == "+"
    low = F.when(forward, trim5).otherwise(trim3).cast("bigint")
    high = total - F.when(forward, trim3).otherwise(trim5)

    def cut(b: Column) -> Column:
        start, end = F.greatest(b["query"], low), F.least(b["query"] + b["len"], high)
        return F.struct((b["ref"] + start - b["query"]).alias("ref"), start.alias("query"), (end - start).alias("len"))

    return F.filter(F.transform(blocks, cut), lambda b: (b["len"] > 0) & (total > trim5 + trim3))


def _block_rows(reads: DataFrame, trim5: int, trim3: int, *more: Column) -> DataFrame:
    """(read_id, contig, start_, end_, letters, marks, more) of every aligned block that trimming leaves."""
    blocks = reads.select("read_id", "contig", "pos", "seq", "qual", *more, F.explode(trimmed_blocks(trim5, trim3)).alias("b")).where("b.len > 0")
    part = lambda c: F.substring(F.col(c), F.col("b.query").cast("int") + 1, F.col("b.len").cast("int"))
    here = F.col("pos") + F.col("b.ref")
    rest = [c for c in blocks.columns if c not in ("read_id", "contig", "pos", "seq", "qual", "b")]
    return blocks.select("read_id", "contig", here.alias("start_"), (here + F.col("b.len")).alias("end_"), part("seq").alias("letters"), part("qual").alias("marks"), *rest)


def bases(reads: DataFrame, design: str = "u", trim5: int = 0, trim3: int = 0, phred: int = PHRED, within: DataFrame | None = None) -> DataFrame:
    """(read_id, contig, pos, base, trstrand): a row per observed base of sufficient quality; other letters are N.

    With ``within`` (contig, r_start, r_end) what no range is near is left out before it is cut to bases.
    """
    blocks = _block_rows(reads, trim5, trim3, deduce(F.col("flags"), design).alias("trstrand"))
    if within is not None:
        blocks = intervals.touching(blocks, within, "start_", "end_", ["letters", "marks"])
    # a base that is missing (a sequence shorter than its CIGAR says) has no mark either
    cells = F.posexplode(F.split("letters", "")).alias("k", "letter")
    single = blocks.select("read_id", "contig", "start_", "marks", "trstrand", cells)
    mark = F.ascii(F.substring(F.col("marks"), F.col("k") + 1, F.lit(1)))
    return single.where((F.col("letter") != "") & (mark - 33 >= phred)).select("read_id", "contig", (F.col("start_") + F.col("k")).alias("pos"), normalize(F.col("letter")).alias("base"), "trstrand")


def touched(ranges: DataFrame, start: str, end: str) -> kernels.Touched:
    """The stretches of tiles that ``ranges`` (contig, start, end) touch; 64 tiles reach the driver as one number."""
    tiles = by_tile(ranges.select("contig", start, end), start, end).select("contig", "tile")
    words = tiles.groupBy("contig", F.shiftright("tile", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(tile & 63 as int))")).alias("bits"))
    found: dict[str, list[tuple[int, int]]] = {}
    for r in words.collect():
        found.setdefault(r["contig"], []).append((r["word"], r["bits"]))
    out = {}
    for contig, pairs in found.items():
        word, bits = np.array(sorted(pairs), np.int64).T
        row, bit = np.nonzero(bits[:, None] >> np.arange(64) & 1)
        out[contig] = kernels.stretches((word[row] << 6) + bit)
    return out


def by_tile(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """``ranges`` with a row for each tile that they touch, cut to it."""
    first, last = text.tile_of(F.col(start)), text.tile_of(F.col(end) - 1)
    spread = ranges.where(F.col(end) > F.col(start)).withColumn("tile", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col(start), F.col("tile") * text.TILE), F.least(F.col(end), (F.col("tile") + 1) * text.TILE)
    return spread.withColumns({start: low, end: high})


def _placed(reads: DataFrame) -> DataFrame:
    return reads.where("contig is not null and pos is not null")


def pieces(reads: DataFrame, design: str = "u", trim5: int = 0, trim3: int = 0, phred: int = PHRED, within: DataFrame | None = None) -> DataFrame:
    """What ``bases`` gives, by blocks and tiles (``kernels.PIECE``), for ``pileup``, ``stranded_pileup`` and ``positions``.

    With ``within`` (contig, r_start, r_end) tiles that no range touches are left out.
    """
    near = None if within is None else touched(within, "r_start", "r_end")
    kind = F.when(deduce(F.col("flags"), design) == "-", 1).otherwise(0).cast("tinyint")
    rows = _placed(reads).select("contig", F.col("pos").cast("bigint").alias("pos"), F.col("flags").cast("int").alias("flags"), kind.alias("kind"), "cigar", "seq", "qual")
    return rows.mapInArrow(lambda batches: kernels.pieces(batches, trim5, trim3, phred, near), "contig string, tile bigint, kind tinyint, at int, data binary")


def matched_runs(reads: DataFrame, trim5: int = 0, trim3: int = 0, phred: int = PHRED, within: kernels.Touched = None) -> DataFrame:
    """``reads`` (read_id, contig, flags) with ``runs``: their stretches of accepted bases within one aligned block, ascending; N counts as matched.

    ``gap`` is the longest stretch between two of them. Reads without any are gone, and with ``within`` those that are in no touched tile.
    """
    rows = _placed(reads).select("read_id", "contig", F.col("pos").cast("bigint").alias("pos"), F.col("flags").cast("int").alias("flags"), "cigar", "seq", "qual")
    kind = rows.schema["read_id"].dataType.simpleString()
    return rows.mapInArrow(
        lambda batches: kernels.runs(batches, trim5, trim3, phred, within), f"read_id {kind}, contig string, flags int, runs array<struct<start_:bigint,end_:bigint>>, gap bigint"
    )


def matched_blocks(reads: DataFrame, trim5: int = 0, trim3: int = 0, phred: int = PHRED) -> DataFrame:
    """(read_id, contig, start_, end_): a row for each of ``matched_runs``."""
    runs = matched_runs(reads, trim5, trim3, phred)
    return runs.select("read_id", "contig", F.explode("runs").alias("r")).select("read_id", "contig", "r.start_", "r.end_")


def count(observed: DataFrame, *keys: str) -> DataFrame:
    """Counts of A, C, G and T of single ``bases`` by ``keys``, for streams; positions where only other letters were seen have none."""
    return observed.where(F.col("base") != "N").groupBy(*keys).agg(*[count_column(n, F.col("base")) for n in ACGT])


def _as_pieces(observed: DataFrame) -> DataFrame:
    if "data" in observed.columns:
        return observed
    tile, code = text.tile_of(F.col("pos")), F.unhex(F.concat(F.lit("0"), F.translate("base", "ACGTN", "01234")))
    kind = F.when(F.col("trstrand") == "-", 1).otherwise(0).cast("tinyint")
    return observed.where("base <> 'N'").select("contig", tile.alias("tile"), kind.alias("kind"), (F.col("pos") - tile * text.TILE).cast("int").alias("at"), code.alias("data"))


def positions(observed: DataFrame, design: str = "u", tiles: DataFrame | None = None, ranges: DataFrame | None = None, also: bool = False) -> DataFrame:
    """(contig, pos, refnuc, counts) of the positions that ``observed`` (``pieces`` or ``bases``) covers, one row a position.

    Counts are A to T, and of both strands side by side (``+A`` to ``-T``) where the design tells them. There is no refnuc without
    ``tiles``; with them only positions that the genome holds come. With ``ranges`` (contig, start_, end_) all of their
    positions come, covered or not, instead of the others, or with ``also`` beside them, marked by ``forced``. Tiles
    and ranges are counted where the bases are, in one exchange.
    """
    rows = _as_pieces(observed)
    other = lambda df, kind, at, data: df.select("contig", "tile", F.lit(kind).cast("tinyint").alias("kind"), at.cast("int").alias("at"), data.alias("data"))
    if ranges is not None:
        parts = by_tile(ranges.select("contig", "start_", "end_"), "start_", "end_")
        size = F.unhex(F.lpad(F.hex(F.col("end_") - F.col("start_")), 8, "0"))
        rows = rows.unionByName(other(parts, kernels.RANGE, F.col("start_") - F.col("tile") * text.TILE, size))
        if not also:
            tiles = tiles.join(parts.select("contig", "tile").distinct(), ["contig", "tile"], "left_semi")
    if tiles is not None:
        rows = rows.unionByName(other(tiles, kernels.GENOME, F.lit(0), F.col("seq").cast("binary")))
    strands, genome, how = (1 if design == "u" else 2), tiles is not None, "" if ranges is None else "also" if also else "only"
    names = [f"{s}{n}" for s in ([""] if strands == 1 else "+-") for n in ACGT]
    schema = ", ".join(["contig string", "pos bigint", *["refnuc string"] * genome, *[f"`{n}` bigint" for n in names], *["forced boolean"] * also])
    sorted_ = rows.repartition("contig", "tile").sortWithinPartitions("contig", "tile")
    return sorted_.mapInArrow(lambda batches: kernels.counted(batches, strands, genome, how), schema)


def pileup(observed: DataFrame) -> DataFrame:
    return positions(observed)


def stranded_pileup(observed: DataFrame, design: str = "s") -> DataFrame:
    """A row per position and strand that has counts."""
    if "data" not in observed.columns:
        return count(observed, "contig", "pos", "trstrand")
    if design == "u":
        return positions(observed).withColumn("trstrand", F.lit("."))
    return by_strand(positions(observed, design)).where(" + ".join(ACGT) + " > 0")


def by_strand(places: DataFrame) -> DataFrame:
    """``places`` with counts of both strands side by side: a row with A to T for each strand."""
    own = [c for c in places.columns if c[1:] not in ACGT or c[:1] not in "+-"]
    strands = F.array(*[F.struct(F.lit(s).alias("trstrand"), *[F.col(f"`{s}{n}`").alias(n) for n in ACGT]) for s in "+-"])
    return places.select(*own, F.explode(strands).alias("s")).select(*own, "s.*")


def mapped_reads(observed: DataFrame) -> DataFrame:
    """(trstrand, reads): reads with at least one accepted base."""
    return observed.select("trstrand", "read_id").distinct().groupBy("trstrand").agg(F.count("*").alias("reads"))
