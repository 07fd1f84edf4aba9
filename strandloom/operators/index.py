"""The editing index: one row of conditional frequencies over all regions of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nucleotides import ACGT, COMPLEMENT
from .filters import cell

#: The order of the index's columns.
PAIRS = ["A->A", "T->T", "G->G", "C->C", "A->T", "T->A", "A->G", "T->C", "A->C", "T->G", "G->C", "C->G", "G->A", "C->T", "G->T", "C->A"]


def sums(table: DataFrame) -> DataFrame:
    """Counts by reference and observed base on the forward strand: reverse regions are complemented, unknown ones only counted."""
    plus, minus = F.col("trstrand") == "+", F.col("trstrand") == "-"
    zero = F.lit(0).cast("bigint")
    cells = [
        F.coalesce(F.sum(F.when(plus, F.col(cell(a, b))).when(minus, F.col(cell(COMPLEMENT[a], COMPLEMENT[b])))), zero).alias(cell(a, b))
        for a in ACGT
        for b in ACGT
    ]
    return table.agg(F.count_if(F.col("trstrand") == ".").alias("unstranded"), *cells)


def editing_index(table: DataFrame, experiment: str = "NA", roi_file: str = "NA") -> DataFrame:
    """All regions count, passed or forced or not. A reference base that none has gives null."""
    total = sums(table)

    def share(pair: str):
        a, b = pair.split("->")
        whole = sum((F.col(cell(a, x)) for x in ACGT[1:]), F.col(cell(a, ACGT[0])))
        return (F.col(cell(a, b)) / F.when(whole > 0, whole)).alias(pair)

    return total.select(F.lit(experiment).alias("experiment"), F.lit(roi_file).alias("ROI-file"), F.col("unstranded").alias("#unstranded"), *map(share, PAIRS))
