"""Strands: + and -, and . where none is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REVERSED, FIRST = 0x10, 0x40
#: Library designs: unstranded; same, flipped; and for pairs, read 1 / read 2.
DESIGNS = ("u", "s", "f", "s/f", "f/s")


def of_read(flags: Column) -> Column:
    return F.when(flags.bitwiseAND(F.lit(REVERSED)) != 0, "-").otherwise("+")


def flip(strand: Column) -> Column:
    return F.translate(strand, "+-", "-+")


def deduce(flags: Column, design: str) -> Column:
    """The transcript's strand by the library's design; reads that aren't paired count as read 2."""
    if design not in DESIGNS:
        raise ValueError(f"design must be one of {', '.join(DESIGNS)}")
    own, first = of_read(flags), flags.bitwiseAND(F.lit(FIRST)) != 0
    if design == "u":
        return F.lit(".")
    if design in ("s", "f"):
        return own if design == "s" else flip(own)
    return F.when(first if design == "s/f" else ~first, own).otherwise(flip(own))
