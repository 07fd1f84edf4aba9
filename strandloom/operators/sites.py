"""Site mode: a row per position and strand of transcription."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nucleotides import ACGT, symbol
from . import filters, intervals, pileup, refpred, strand

Predictor = Callable[[DataFrame], DataFrame]
COLUMNS = ["contig", "pos", "trstrand", "refnuc", "prednuc", *ACGT]


def predicted(places: DataFrame, design: str, predictor: Predictor) -> DataFrame:
    """``places`` (as ``pileup.positions`` gives them) with n1, n2, and a row with counts for every strand of the design.

    The reference is predicted once per position, from all strands together.
    """
    if design == "u":
        return predictor(places).withColumn("trstrand", F.lit("."))
    pooled = places.withColumns({n: F.col(f"`+{n}`") + F.col(f"`-{n}`") for n in ACGT})
    return pileup.by_strand(predictor(pooled).drop(*ACGT))


def site_table(
    tiles: DataFrame, observed: DataFrame, design: str = "u", predictor: Predictor = refpred.autoref, force: DataFrame | None = None, reach: Callable[[DataFrame], DataFrame] = lambda at: at
) -> DataFrame:
    """(contig, pos, refnuc, n1, n2, trstrand, counts) of every covered position and every strand of the design; a strand without counts has zeros.

    With ``force`` all its positions come too, covered or not, and ``forced`` marks them. ``reach`` takes those positions that the analysis looks at.
    """
    places = pileup.positions(observed, design, tiles, force, force is not None)
    return predicted(reach(places), design, predictor)


def restrict(sites: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Positions inside any interval of ``include`` and outside all of ``exclude``.

    A position in several included intervals counts once.
    """
    if include is not None:
        sites = intervals.points_in(sites, include.select("contig", "start_", "end_"), "pos", "start_", "end_", "left_semi")
    if exclude is not None:
        sites = intervals.points_in(sites, exclude.select("contig", "start_", "end_"), "pos", "start_", "end_", "left_anti")
    return sites


def forced(tiles: DataFrame, observed: DataFrame, force: DataFrame, design: str = "u", predictor: Predictor = refpred.autoref) -> DataFrame:
    """All positions of ``force``, on every strand of the design, covered or not, as ``site_table`` gives them."""
    return predicted(pileup.positions(observed, design, tiles, force), design, predictor)


def keep(sites: DataFrame, must: DataFrame | None = None, **thresholds) -> DataFrame:
    """Sites that pass the thresholds, those that are marked as forced, and all of ``must``."""
    passing = filters.site_threshold(**thresholds)
    if "forced" in sites.columns:
        return sites.where(F.col("forced") | passing).drop("forced")
    passing = sites.where(passing)
    if must is None:
        return passing
    return passing.join(must.select("contig", "pos").distinct(), ["contig", "pos"], "left_anti").unionByName(must.select(*sites.columns))


def stranded(sites: DataFrame, annotated: DataFrame | None = None, design: str = "u", **editing) -> DataFrame:
    """Strand prediction for unstranded designs; others are left as they are."""
    if design != "u":
        return sites
    spanned = sites.withColumn("pos_end", F.col("pos") + 1)
    return strand.predict(spanned, annotated, lambda: strand.by_editing_site(**editing), "pos", "pos_end").drop("pos_end")


def output(sites: DataFrame) -> DataFrame:
    return sites.withColumn("prednuc", symbol(F.col("n1"), F.col("n2"))).select(*COLUMNS).orderBy("contig", "pos", "trstrand")
