"""Region mode: a row per region and strand of transcription, with its 4x4 matrix of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nucleotides import ACGT
from ..functions.strands import deduce
from ..sources import files, text
from . import filters, intervals, pileup, refpred, sites, strand
from .filters import cell

COUNTS = [f"n_{n.lower()}" for n in ACGT]
CELLS = [cell(a, b) for a in ACGT for b in ACGT]
HEADER = ["contig", "start", "end", "strand", "name", "trstrand", "coverage", "nucmasked", "heterozygous"] + [
    c for a in ACGT for c in (f"#{a}", *[f"{a}->{b}" for b in ACGT])
]


def regions(rois: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """``rois`` (roi_id, contig, start_, end_, name, strand) with pieces, post_start, post_end and nucmasked."""
    cut = intervals.whole_pieces(rois) if exclude is None else intervals.subtract(rois, exclude, "roi_id")
    kept = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda total, p: total + p["end_"] - p["start_"])
    return (
        cut.withColumn("post_start", F.try_element_at("pieces", F.lit(1))["start_"])
        .withColumn("post_end", F.try_element_at("pieces", F.lit(-1))["end_"])
        .withColumn("nucmasked", F.col("end_") - F.col("start_") - kept)
    )


def _strands(design: str) -> list[str]:
    return ["."] if design == "u" else ["+", "-"]


#: Lengths at which regions are told apart by ``read_coverage``, beside the shortest.
LENGTHS = (8, 64, 1024)


def read_coverage(cut: DataFrame, reads: DataFrame, design: str = "u", **bases) -> DataFrame:
    """(roi_id, trstrand, coverage): reads with a matched base in a region's range, masked gaps included.

    A read misses no region between its ends that is longer than the stretches between its runs: such pairs are counted by the reads'
    ends (``_spanning``). The others, as a read with an intron or a region of a few bases, meet one by one (``_meeting``). A region's
    ``class`` is the number of lengths that it reaches, but one; a read's is the number that its longest gap reaches, and pairs are
    of the first kind where the read's isn't the greater.
    """
    length = F.col("post_end") - F.col("post_start")
    least = cut.select(F.min(length)).first()[0] or 1
    lengths = [least, *(n for n in LENGTHS if n > least)]
    near = pileup.touched(cut, "post_start", "post_end")
    reached = lambda n: sum(((n >= k).cast("int") for k in lengths[1:]), (n >= lengths[0]).cast("int"))
    runs = pileup.matched_runs(reads, **bases, within=near).select("contig", "runs", deduce(F.col("flags"), design).alias("trstrand"), reached(F.col("gap")).alias("class"))
    ranges = cut.select("roi_id", "contig", "post_start", "post_end", (reached(length) - 1).alias("class"))
    met = _spanning(ranges, runs.where(F.col("class") < len(lengths)), design, len(lengths)).unionByName(_meeting(ranges, runs.where("class > 0")))
    return met.groupBy("roi_id", "trstrand").agg(F.sum("reads").alias("coverage")).where("coverage > 0")


def _spanning(ranges: DataFrame, runs: DataFrame, design: str, classes: int) -> DataFrame:
    """(roi_id, trstrand, reads): parts whose sum is the number of reads of no greater class between whose ends a base of the region's range lies.

    These are the reads that begin before the range's end, but for those that end before its start. Tile by tile: those that begin in a
    tile before the range's end there, and where the range starts those that come from the tile before and haven't ended.
    """
    first, last = F.col("runs")[0]["start_"], F.element_at("runs", -1)["end_"]
    at, upto = text.tile_of(first), text.tile_of(last - 1)

    def event(tile: Column, pos: Column, order: int, began: int, inside: int) -> Column:
        """Of equal places the order is: who enters or has ended, the regions' borders, who begins."""
        return F.struct(tile.alias("tile"), pos.alias("pos"), F.lit(order).alias("order"), F.lit(began).alias("began"), F.lit(inside).alias("inside"))

    entered = F.transform(F.when(upto > at, F.sequence(at + 1, upto)).otherwise(F.array().cast("array<bigint>")), lambda t: event(t, t * text.TILE, 0, 0, 1))
    moved = runs.select("contig", "trstrand", "class", F.inline(F.concat(F.array(event(at, first, 2, 1, 0), event(upto, last, 0, 0, -1)), entered)))
    parts = pileup.by_tile(ranges.withColumn("from", F.col("post_start")), "post_start", "post_end")
    ends = F.array(F.struct(F.col("post_end").alias("pos"), F.lit(False).alias("opens")))
    start = F.struct(F.col("post_start").alias("pos"), F.lit(True).alias("opens"))
    either = F.when(F.col("post_start") == F.col("from"), F.array_append(ends, start)).otherwise(ends)
    borders = parts.select("contig", "tile", "class", "roi_id", F.array(*map(F.lit, _strands(design))).alias("strands"), F.explode(either).alias("b"))
    borders = borders.select("contig", "tile", F.explode("strands").alias("trstrand"), "class", "b.pos", F.lit(1).alias("order"), "roi_id", "b.opens")
    by = ["contig", "tile", "trstrand"]
    so_far = Window.partitionBy(*by).orderBy("pos", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {f"{n}{k}": F.sum(F.when((F.col("order") != 1) & (F.col("class") == k), F.col(n)).otherwise(0)) for n in ("began", "inside") for k in range(classes)}
    seen = moved.unionByName(borders, allowMissingColumns=True).withColumns({n: v.over(so_far) for n, v in sums.items()}).where("roi_id is not null")
    total = lambda n: sum((F.when(F.col("class") >= k, F.col(f"{n}{k}")).otherwise(0) for k in range(1, classes)), F.col(f"{n}0"))
    return seen.select("roi_id", "trstrand", F.when(F.col("opens"), total("inside")).otherwise(total("began")).alias("reads"))


def _meeting(cut: DataFrame, runs: DataFrame) -> DataFrame:
    """(roi_id, trstrand, reads): 1 for each read and region of a lower class that share a base.

    A read keeps its runs in one row, and a read and a region meet once, in the bucket of the first base that they share: pairs
    need not be made distinct, and only partial counts move after the join.
    """
    width = intervals.BUCKET
    bucket = lambda pos: F.floor(pos / F.lit(width)).cast("bigint")
    touched = F.flatten(F.transform("runs", lambda r: F.sequence(bucket(r["start_"]), bucket(r["end_"] - 1))))
    spread = runs.withColumn("class", F.explode(F.sequence(F.lit(0), F.col("class") - 1))).select("contig", "runs", "trstrand", "class", F.explode(F.array_distinct(touched)).alias("bucket"))
    names = {"contig": "r_contig", "class": "r_class", "bucket": "r_bucket"}
    ranges = intervals.bucketed(cut.select("roi_id", "contig", "class", "post_start", "post_end"), "post_start", "post_end").withColumnsRenamed(names)
    first = F.try_element_at(F.filter("runs", lambda r: (r["start_"] < F.col("post_end")) & (F.col("post_start") < r["end_"])), F.lit(1))["start_"]
    on = (
        (F.col("contig") == F.col("r_contig"))
        & (F.col("bucket") == F.col("r_bucket"))
        & (F.col("class") == F.col("r_class"))
        & (F.col("runs")[0]["start_"] < F.col("post_end"))
        & (F.col("post_start") < F.element_at("runs", -1)["end_"])
        & (F.col("bucket") == bucket(F.greatest(first, F.when(first.isNotNull(), F.col("post_start")))))
    )
    return spread.join(ranges, on).select("roi_id", "trstrand", F.lit(1).cast("bigint").alias("reads"))


def pieces_of(cut: DataFrame) -> DataFrame:
    """(roi_id, contig, p_start, p_end) of every piece of ``regions``."""
    return cut.select("roi_id", "contig", F.explode("pieces").alias("p")).select("roi_id", "contig", F.col("p.start_").alias("p_start"), F.col("p.end_").alias("p_end"))


def matrix(cut: DataFrame, tiles: DataFrame, observed: DataFrame, design: str = "u", predictor: sites.Predictor = refpred.autoref) -> DataFrame:
    """(roi_id, trstrand, heterozygous, n_a..n_t, a_to_a..t_to_t) of every region and strand of the design.

    Driven from the genome's side: uncovered positions count in n_x too. Positions whose prediction is N
    are left out, those with two alleles only counted. Every position comes once, however many regions hold it: sums run over a tile's
    positions, and what a region has in a tile is the difference between its two ends.
    """
    parts = pileup.by_tile(pieces_of(cut), "p_start", "p_end")
    places = pileup.positions(observed, design, tiles, pieces_of(cut).withColumnsRenamed({"p_start": "start_", "p_end": "end_"}))
    rows = sites.predicted(places, design, predictor).select("contig", text.tile_of(F.col("pos")).alias("tile"), "trstrand", "pos", F.lit(1).alias("after"), "n1", "n2", *ACGT)
    ends = F.array(F.struct(F.col("p_start").alias("pos"), F.lit(-1).alias("sign")), F.struct(F.col("p_end").alias("pos"), F.lit(1).alias("sign")))
    borders = parts.select("contig", "tile", F.array(*map(F.lit, _strands(design))).alias("strands"), "roi_id", F.explode(ends).alias("b"))
    borders = borders.select("contig", "tile", F.explode("strands").alias("trstrand"), "b.pos", F.lit(0).alias("after"), "roi_id", "b.sign")
    # A tile's positions and borders come in order; narrow rows are sorted, and sums are widened after that.
    by = ["contig", "tile", "trstrand"]
    ordered = rows.unionByName(borders, allowMissingColumns=True).repartition(*by).sortWithinPartitions(*by, "pos", "after")
    place, hom = F.col("after") == 1, F.col("n2").isNull()
    sums = {"places": F.count_if(place), "heterozygous": F.count_if(place & ~hom)}
    sums |= {n: F.count_if(place & hom & (F.col("n1") == a)) for a, n in zip(ACGT, COUNTS)}
    sums |= {cell(a, b): F.sum(F.when(place & hom & (F.col("n1") == a), F.col(b)).otherwise(0)) for a in ACGT for b in ACGT}
    so_far = Window.partitionBy(*by).orderBy("pos", "after").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = ordered.select("roi_id", "trstrand", "sign", *[v.over(so_far).alias(n) for n, v in sums.items()]).where("roi_id is not null")
    found = known.groupBy("roi_id", "trstrand").agg(*[F.sum(F.col("sign") * F.col(n)).alias(n) for n in sums])
    return found.where("places > 0").drop("places")


def roi_table(
    rois: DataFrame,
    tiles: DataFrame,
    reads: DataFrame,
    exclude: DataFrame | None = None,
    design: str = "u",
    predictor: sites.Predictor = refpred.autoref,
    covered: bool = True,
    **bases,
) -> DataFrame:
    """A row per region and strand of the design, before thresholds and strand prediction; without ``covered``, without coverage.

    Regions that the genome doesn't hold have null counts, which pass no threshold; ``output`` writes zeros.
    """
    cut = regions(rois, exclude)
    if exclude is not None:  # positions, reads, coverage and the table all need the pieces: they are cut once
        cut = files.stored(cut, files.fresh(rois.sparkSession, "regions"))
    near = pieces_of(cut).select("contig", F.col("p_start").alias("r_start"), F.col("p_end").alias("r_end"))
    observed = pileup.pieces(reads, design, **bases, within=near)
    rows = cut.withColumn("trstrand", F.explode(F.array(*map(F.lit, _strands(design)))))
    full = rows.join(matrix(cut, tiles, observed, design, predictor), ["roi_id", "trstrand"], "left")
    if covered:
        full = full.join(read_coverage(cut, reads, design, **bases), ["roi_id", "trstrand"], "left").na.fill(0, ["coverage"])
    return full


def mark_forced(table: DataFrame, force: DataFrame) -> DataFrame:
    """``table`` with ``forced``: whether ``force`` lists the region by contig, range after exclusion, strand and name."""
    listed = force.select("contig", F.col("start_").alias("post_start"), F.col("end_").alias("post_end"), "strand", "name").distinct()
    joined = table.join(listed.withColumn("forced", F.lit(True)), ["contig", "post_start", "post_end", "strand", "name"], "left")
    return joined.withColumn("forced", F.coalesce("forced", F.lit(False)))


def keep(table: DataFrame, force: DataFrame | None = None, **thresholds) -> DataFrame:
    passing = filters.roi_threshold(**thresholds)
    if force is None:
        return table.where(passing)
    return mark_forced(table, force).where(F.col("forced") | passing).drop("forced")


def stranded(table: DataFrame, annotated: DataFrame | None = None, design: str = "u", **editing) -> DataFrame:
    if design != "u":
        return table
    return strand.predict(table, annotated, lambda: strand.by_editing_roi(**editing), "post_start", "post_end")


def output(table: DataFrame) -> DataFrame:
    named = ["contig", "start_", "end_", "strand", "name", "trstrand", "coverage", "nucmasked", "heterozygous"] + [
        c for a, n in zip(ACGT, COUNTS) for c in (n, *[cell(a, b) for b in ACGT])
    ]
    # Plain renames above a filter on all cells would make the optimiser derive it for every mixture of names.
    filled = {"heterozygous", *COUNTS, *CELLS}
    order = table.orderBy("contig", "start_", "end_", "trstrand", "name", "roi_id")
    return order.select(*[(F.coalesce(c, F.lit(0).cast("bigint")) if c in filled else F.col(c)).alias(h) for c, h in zip(named, HEADER)])
