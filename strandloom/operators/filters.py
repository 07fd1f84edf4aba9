"""Predicates on reads and result rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.nucleotides import ACGT, coverage, frequent, mismatches

INCLUDE, EXCLUDE, MAPQ, PHRED = 0, 2820, 1, 20


def by_flags(include: int = INCLUDE, exclude: int = EXCLUDE) -> Column:
    flags = F.col("flags")
    return (flags.bitwiseAND(F.lit(include)) == include) & (flags.bitwiseAND(F.lit(exclude)) == 0)


def by_mapq(least: int = MAPQ, no_255: bool = False) -> Column:
    passed = F.col("mapq") >= least
    return passed & (F.col("mapq") != 255) if no_255 else passed


def reads(include: int = INCLUDE, exclude: int = EXCLUDE, mapq: int = MAPQ, no_255: bool = False) -> Column:
    return by_flags(include, exclude) & by_mapq(mapq, no_255)


def _passes(cov: Column, mism: Column, least_cov: int, least_mism: int, least_freq: float) -> Column:
    return (cov >= least_cov) & (mism >= least_mism) & frequent(mism, cov, least_freq)


def site_threshold(least_cov: int = 10, least_mism: int = 3, least_freq: float = 0.01) -> Column:
    """Of a heterozygous site either allele may pass. Zero coverage never passes."""
    one = _passes(coverage(), mismatches(F.col("n1")), least_cov, least_mism, least_freq)
    two = _passes(coverage(), mismatches(F.col("n2")), least_cov, least_mism, least_freq)
    return one | (F.col("n2").isNotNull() & two)


def roi_threshold(least_cov: int = 10, least_mism: int = 5, least_freq: float = 0.01) -> Column:
    """Coverage is the sum of the region's 16 counts here."""
    cells = [F.col(cell(a, b)) for a in ACGT for b in ACGT]
    off = [F.col(cell(a, b)) for a in ACGT for b in ACGT if a != b]
    return _passes(sum(cells[1:], cells[0]), sum(off[1:], off[0]), least_cov, least_mism, least_freq)


def cell(a: str, b: str) -> str:
    """The matrix column of reference ``a`` observed as ``b``."""
    return f"{a.lower()}_to_{b.lower()}"


