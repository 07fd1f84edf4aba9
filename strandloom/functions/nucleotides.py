"""Nucleotides and their counts. A nucleotide is one of A, C, G, T, or N for any other letter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACGT = ("A", "C", "G", "T")
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}


def normalize(letter: Column) -> Column:
    upper = F.upper(letter)
    return F.when(upper.isin(*ACGT), upper).otherwise("N")


def count_column(letter: str, base: Column) -> Column:
    return F.count_if(base == letter).alias(letter)


def coverage(counts: dict[str, Column] | None = None) -> Column:
    counts = counts or {n: F.col(n) for n in ACGT}
    return sum((counts[n] for n in ACGT[1:]), counts[ACGT[0]])


def count_of(nucleotide: Column) -> Column:
    """The count column that ``nucleotide`` names; 0 for N."""
    return F.coalesce(*[F.when(nucleotide == n, F.col(n)) for n in ACGT], F.lit(0).cast("long"))


def mismatches(reference: Column) -> Column:
    """All counts but the reference's; every count where the reference is N."""
    return coverage() - count_of(reference)


def most_frequent() -> Column:
    """The most frequent nucleotide; of equal counts the first in the alphabet."""
    top = F.greatest(*[F.col(n) for n in ACGT])
    return F.coalesce(*[F.when(F.col(n) == top, F.lit(n)) for n in ACGT])


def frequent(part: Column, whole: Column, least: float) -> Column:
    """part / whole >= least in single precision, and false where there is nothing to divide by."""
    share = (part.cast("float") / F.when(whole > 0, whole).cast("float")).cast("float")
    return F.coalesce(share >= F.lit(least).cast("float"), F.lit(False))


def symbol(n1: Column, n2: Column) -> Column:
    """X where one nucleotide is predicted (n2 null), X/Y in alphabetical order where two are, N with an N."""
    pair = F.concat_ws("/", F.least(n1, n2), F.greatest(n1, n2))
    return F.when(n2.isNull(), n1).when((n1 == "N") | (n2 == "N"), F.lit("N")).otherwise(pair)
