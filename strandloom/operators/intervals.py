"""Half-open intervals on contigs: range joins, subtraction, splitting, binning, segmentation.

Spark plans ``start <= pos and pos < end`` as a nested loop. Here both sides get the bucket of their
position: an interval one row for each bucket it touches, a point one row. The join is then an equi
join on (contig, bucket) with the range as a residual; pairs of intervals are kept in the bucket in
which their overlap starts, so each is found once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Near the usual length of a region: more buckets repeat intervals, fewer repeat comparisons.
BUCKET = 256


def _bucket(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(width)).cast("bigint")


def bucketed(intervals: DataFrame, start: str, end: str, width: int = BUCKET) -> DataFrame:
    first, last = _bucket(F.col(start), width), _bucket(F.col(end) - 1, width)
    return intervals.where(F.col(end) > F.col(start)).withColumn("bucket", F.explode(F.sequence(first, last)))


def points_in(points: DataFrame, intervals: DataFrame, pos: str, start: str, end: str, how: str = "inner", width: int = BUCKET) -> DataFrame:
    """Pairs of a point and an interval that holds it; ``how`` as in a join from the points' side."""
    left = points.withColumn("bucket", _bucket(F.col(pos), width)).alias("l")
    right = bucketed(intervals, start, end, width).alias("r")
    held = (F.col(f"l.{pos}") >= F.col(f"r.{start}")) & (F.col(f"l.{pos}") < F.col(f"r.{end}"))
    on = (F.col("l.contig") == F.col("r.contig")) & (F.col("l.bucket") == F.col("r.bucket")) & held
    joined = left.join(right, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("bucket")
    kept = [F.col(f"r.{c}") for c in intervals.columns if c not in points.columns]
    return joined.select(*[F.col(f"l.{c}") for c in points.columns], *kept)


def overlaps(left: DataFrame, right: DataFrame, l_range: tuple[str, str], r_range: tuple[str, str], width: int = BUCKET) -> DataFrame:
    """Pairs of overlapping intervals, each once. Columns of ``right`` that ``left`` has too are left out."""
    (ls, le), (rs, re) = l_range, r_range
    a, b = bucketed(left, ls, le, width).alias("l"), bucketed(right, rs, re, width).alias("r")
    first = _bucket(F.greatest(F.col(f"l.{ls}"), F.col(f"r.{rs}")), width)
    on = (
        (F.col("l.contig") == F.col("r.contig"))
        & (F.col("l.bucket") == F.col("r.bucket"))
        & (F.col(f"l.{ls}") < F.col(f"r.{re}"))
        & (F.col(f"r.{rs}") < F.col(f"l.{le}"))
        & (F.col("l.bucket") == first)
    )
    kept = [F.col(f"r.{c}") for c in right.columns if c not in left.columns]
    return a.join(b, on).select(*[F.col(f"l.{c}") for c in left.columns], *kept)


def touching(blocks: DataFrame, ranges: DataFrame, start: str, end: str, strings: list[str], width: int = 4 * BUCKET) -> DataFrame:
    """The parts of ``blocks`` (contig, start, end) in whose bucket a range (contig, r_start, r_end) overlaps them.

    Blocks are cut where buckets meet, with their ``strings``, which have a letter a base; so each part is in one bucket
    and comes once, whatever it overlaps, and a part that nothing overlaps goes before its bases are looked at.
    """
    first, last = _bucket(F.col(start), width), _bucket(F.col(end) - 1, width)
    spread = blocks.withColumn("bucket", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col(start), F.col("bucket") * width), F.least(F.col(end), (F.col("bucket") + 1) * width)
    at, size = (low - F.col(start) + 1).cast("int"), (high - low).cast("int")
    kept = [c for c in blocks.columns if c not in (start, end, *strings)]
    parts = spread.select(*kept, "bucket", low.alias(start), high.alias(end), *[F.substring(F.col(c), at, size).alias(c) for c in strings])
    near = bucketed(ranges.select(F.col("contig").alias("r_contig"), "r_start", "r_end").distinct(), "r_start", "r_end", width).withColumnRenamed("bucket", "r_bucket")
    on = (F.col("contig") == F.col("r_contig")) & (F.col("bucket") == F.col("r_bucket")) & (F.col(start) < F.col("r_end")) & (F.col("r_start") < F.col(end))
    return parts.join(near, on, "left_semi").drop("bucket")


_PIECES = "array<struct<start_:bigint,end_:bigint>>"


def subtract(intervals: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """``intervals`` with ``pieces``: what is left of each outside ``excluded``; those with nothing left are gone.

    ``key`` tells intervals apart, so duplicates stay. An interval's cuts are folded in one row.
    """
    cuts = overlaps(
        intervals.select(key, "contig", F.col("start_").alias("own_start"), F.col("end_").alias("own_end")),
        excluded.select("contig", F.col("start_").alias("cut_start"), F.col("end_").alias("cut_end")),
        ("own_start", "own_end"),
        ("cut_start", "cut_end"),
    )
    listed = cuts.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("cut_start", "cut_end"))).alias("cuts"))

    def step(done: Column, cut: Column) -> Column:
        piece = F.array(F.struct(done["at"].alias("start_"), cut["cut_start"].alias("end_")))
        return F.struct(
            F.greatest(done["at"], cut["cut_end"]).alias("at"),
            F.when(cut["cut_start"] > done["at"], F.concat(done["out"], piece)).otherwise(done["out"]).alias("out"),
        )

    start, end = F.col("start_").cast("bigint"), F.col("end_").cast("bigint")
    rest = F.aggregate(
        F.col("cuts"),
        F.struct(start.alias("at"), F.array().cast(_PIECES).alias("out")),
        step,
        lambda done: F.when(done["at"] < end, F.concat(done["out"], F.array(F.struct(done["at"].alias("start_"), end.alias("end_"))))).otherwise(done["out"]),
    )
    whole = F.array(F.struct(start.alias("start_"), end.alias("end_")))
    joined = intervals.where("end_ > start_").join(listed, key, "left")
    return joined.withColumn("pieces", F.when(F.col("cuts").isNull(), whole).otherwise(rest)).drop("cuts").where(F.size("pieces") > 0)


def whole_pieces(intervals: DataFrame) -> DataFrame:
    """``intervals`` with themselves as their only piece, as if nothing were excluded."""
    return intervals.withColumn("pieces", F.array(F.struct(F.col("start_").cast("bigint").alias("start_"), F.col("end_").cast("bigint").alias("end_"))))


def split(intervals: DataFrame, size: int) -> DataFrame:
    """Each interval in pieces of ``size`` from its start; the last may be shorter."""
    starts = F.sequence(F.col("start_"), F.col("end_") - 1, F.lit(size).cast("bigint"))
    cut = intervals.where("end_ > start_").withColumn("start_", F.col("start_").cast("bigint")).withColumn("end_", F.col("end_").cast("bigint")).withColumn("piece", F.explode(starts))
    return cut.withColumn("start_", F.col("piece")).withColumn("end_", F.least(F.col("piece") + size, "end_")).drop("piece")


#: Bases of a contig whose intervals are ordered together.
CHUNK = 1 << 20


def _carried(rows: DataFrame, value: Column, name: str, upto: int) -> DataFrame:
    """``rows`` with the greatest ``value`` of those of the contig before them, or up to and with them (``upto`` -1 or 0), in ``rows``'s order.

    Chunks of a contig are ordered apart, and one row a chunk is carried on, so that no task holds a contig.
    """
    own = Window.partitionBy("contig", "chunk").orderBy("start_", F.desc("end_"), "k").rowsBetween(Window.unboundedPreceding, upto)
    before = Window.partitionBy("contig").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("contig", "chunk").agg(F.max(value).alias("top")).withColumn("carry", F.max("top").over(before))
    inside = rows.withColumn(name, F.max(value).over(own)).join(tops.select("contig", "chunk", "carry"), ["contig", "chunk"])
    return inside.withColumn(name, F.greatest(name, "carry")).drop("carry")


def greedy_bins(intervals: DataFrame, size: int) -> DataFrame:
    """(contig, start_, end_, items): intervals by start, longer first, joined while they end within ``size`` of the bin's start.

    A bin's end shrinks to its last item's; an item longer than ``size`` makes a bin of its length. The
    fold is sequential, so contigs are cut first wherever no interval reaches the next start by ``size``; a task folds
    what lies between two such places.
    """
    rows = intervals.select("contig", F.col("start_").cast("bigint").alias("start_"), F.col("end_").cast("bigint").alias("end_"))
    rows = rows.withColumn("chunk", _bucket(F.col("start_"), CHUNK)).withColumn("k", F.monotonically_increasing_id())
    known = _carried(rows, F.greatest(F.col("end_"), F.col("start_") + size), "reached", -1)
    opens = F.when(F.col("reached").isNull() | (F.col("start_") >= F.col("reached")), F.col("start_"))
    islands = _carried(known.withColumn("opens", opens), F.col("opens"), "island", 0)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["start_", "end_"], ascending=[True, False])
        bins: list[list] = []
        limit = 0
        for start, end in zip(ordered["start_"].tolist(), ordered["end_"].tolist()):
            if bins and end <= limit:
                bins[-1][2] = max(bins[-1][2], end)
                bins[-1][3] += 1
            else:
                bins.append([pdf["contig"].iloc[0], start, end, 1])
                limit = max(end, start + size)
        return pd.DataFrame(bins, columns=["contig", "start_", "end_", "items"])

    return islands.select("contig", "island", "start_", "end_").groupBy("contig", "island").applyInPandas(fold, "contig string, start_ bigint, end_ bigint, items bigint")


def segments(intervals: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """(key, contig, start_, end_): each interval cut at every border of a feature that overlaps it."""
    own = intervals.select(key, "contig", F.col("start_").alias("own_start"), F.col("end_").alias("own_end"))
    met = overlaps(own, features.select("contig", F.col("start_").alias("f_start"), F.col("end_").alias("f_end")), ("own_start", "own_end"), ("f_start", "f_end"))
    borders = met.select(key, "contig", "own_end", F.explode(F.array("f_start", "f_end")).alias("at"), "own_start").where("at > own_start and at < own_end").drop("own_start")
    starts = own.where("own_end > own_start").select(key, "contig", "own_end", F.col("own_start").alias("at")).unionByName(borders)
    # Of equal borders all but the last begin an empty segment: nothing is made distinct, so no task holds its borders in a hash table.
    after = F.lead("at").over(Window.partitionBy(key).orderBy("at"))
    cut = starts.select(key, "contig", F.col("at").alias("start_"), F.coalesce(after, "own_end").alias("end_"))
    return cut.where("end_ > start_")
