"""The strand of transcription of sites and regions: by annotated features, then by A-to-I editing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nucleotides import frequent
from .intervals import BUCKET, bucketed

CLASSES = ("exon", "gene", "utr3")
LEAST_MISMATCHES, LEAST_FREQ = 50, 0.05


def features(gff: DataFrame, utr3: int = 0) -> DataFrame:
    """(contig, start_, end_, strand, class): exons and genes, and with ``utr3`` an extension behind each gene."""
    base = gff.select("contig", "start_", "end_", "strand", F.lower("type").alias("class"))
    return base.unionByName(utr3_extension(gff, utr3)) if utr3 > 0 else base


def utr3_extension(gff: DataFrame, length: int) -> DataFrame:
    """The ``length`` bases behind each gene in its own direction; starts may be negative."""
    forward = F.col("strand") == "+"
    start = F.when(forward, F.col("end_")).otherwise(F.col("start_") - length)
    end = F.when(forward, F.col("end_") + length).otherwise(F.col("start_"))
    return gff.where(F.lower("type") == "gene").select("contig", start.alias("start_"), end.alias("end_"), "strand", F.lit("utr3").alias("class"))


def _verdict() -> Column:
    """Of the counts by class and strand: the first class with any feature decides."""

    def one(c: str) -> Column:
        plus, minus = F.col(f"{c}+") > 0, F.col(f"{c}-") > 0
        return F.when(plus & minus, ".").when(plus, "+").when(minus, "-")

    return F.coalesce(*[one(c) for c in CLASSES])


def annotate(rows: DataFrame, annotated: DataFrame, start: str, end: str) -> DataFrame:
    """``rows`` (distinct) with by_features: + or - where the first class with any overlapping feature has one
    strand only, . where it has both, null where no class has any. Classes come exon, gene, 3'UTR.

    One pass over ``rows``: they are joined with the features of their buckets and grouped again.
    """
    left = bucketed(rows, start, end).alias("l")
    names = {"start_": "f_start", "end_": "f_end", "strand": "f_strand", "class": "f_class", "contig": "f_contig", "bucket": "f_bucket"}
    right = bucketed(annotated.select("contig", "start_", "end_", "strand", "class"), "start_", "end_").withColumnsRenamed(names)
    first = F.floor(F.greatest(F.col(f"l.{start}"), F.col("f_start")) / F.lit(BUCKET)).cast("bigint")
    on = (
        (F.col("l.contig") == F.col("f_contig"))
        & (F.col("l.bucket") == F.col("f_bucket"))
        & (F.col(f"l.{start}") < F.col("f_end"))
        & (F.col("f_start") < F.col(f"l.{end}"))
        & (F.col("l.bucket") == first)
    )
    counts = [F.count_if((F.col("f_class") == c) & (F.col("f_strand") == s)).alias(f"{c}{s}") for c in CLASSES for s in "+-"]
    grouped = left.join(right, on, "left").groupBy(*[F.col(f"l.{c}") for c in rows.columns]).agg(*counts)
    return grouped.select(*rows.columns, _verdict().alias("by_features"))


def by_annotation(rows: DataFrame, annotated: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, strand) of the rows that meet a feature."""
    own = rows.select(*dict.fromkeys([*keys, "contig", start, end]))
    return annotate(own, annotated, start, end).where("by_features is not null").select(*keys, F.col("by_features").alias("strand"))


def edited(matches: Column, mismatched: Column, least: int = LEAST_MISMATCHES, least_freq: float = LEAST_FREQ) -> Column:
    return (mismatched >= least) & frequent(mismatched, matches + mismatched, least_freq)


def by_editing_site(least: int = LEAST_MISMATCHES, least_freq: float = LEAST_FREQ) -> Column:
    """A read as G in number tells +, T read as C tells -. Alleles that disagree tell nothing."""

    def one(n: Column) -> Column:
        return F.when((n == "A") & edited(F.col("A"), F.col("G"), least, least_freq), "+").when(
            (n == "T") & edited(F.col("T"), F.col("C"), least, least_freq), "-"
        )

    a, b = one(F.col("n1")), one(F.col("n2"))
    return F.when(a.isNull() | b.isNull() | (a == b), F.coalesce(a, b, F.lit("."))).otherwise(".")


def by_editing_roi(least: int = LEAST_MISMATCHES, least_freq: float = LEAST_FREQ) -> Column:
    """As for sites, over a region's sums; where both hold the higher frequency wins, and a tie tells nothing."""
    plus, minus = edited(F.col("a_to_a"), F.col("a_to_g"), least, least_freq), edited(F.col("t_to_t"), F.col("t_to_c"), least, least_freq)

    def share(part: str, whole: str) -> Column:
        total = F.col(part) + F.col(whole)
        return (F.col(part).cast("float") / F.when(total > 0, total).cast("float")).cast("float")

    a, t = share("a_to_g", "a_to_a"), share("t_to_c", "t_to_t")
    return (
        F.when(plus & ~minus, "+")
        .when(minus & ~plus, "-")
        .when(plus & minus & (F.col("a_to_g") > 0) & (a > t), "+")
        .when(plus & minus & (F.col("t_to_c") > 0) & (t > a), "-")
        .otherwise(".")
    )


def predict(rows: DataFrame, annotated: DataFrame | None, editing: Callable[[], Column], start: str, end: str) -> DataFrame:
    """``rows`` (distinct) with trstrand: what is unknown goes by annotation, if there is one, and then by editing."""
    unknown = F.col("trstrand") == "."
    out = rows
    if annotated is not None:
        found = annotate(rows, annotated, start, end)
        out = found.withColumn("trstrand", F.when(unknown, F.coalesce("by_features", "trstrand")).otherwise(F.col("trstrand"))).drop("by_features")
    return out.withColumn("trstrand", F.when(unknown, editing()).otherwise(F.col("trstrand")))
