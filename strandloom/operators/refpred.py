"""The sample's reference base: from the assembly, from the reads themselves, or from variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nucleotides import ACGT, coverage, frequent, most_frequent


def filled(places: DataFrame, counts: DataFrame) -> DataFrame:
    """``places`` (contig, pos, ...) with counts; those that nothing covers have zeros. Both are partitioned by (contig, pos)."""
    names = [c for c in counts.columns if c not in ("contig", "pos")]
    joined = places.join(counts, ["contig", "pos"], "left")
    return joined.select(*places.columns, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in names])


def infer(assembly: Column, least_cov: int = 20, least_freq: float = 0.95, hyperedit: bool = False) -> Column:
    """The most frequent base where coverage and its frequency suffice, else the assembly's.

    With ``hyperedit`` A read as G and T read as C keep the assembly: such sites may be edited in full.
    """
    top, cov = most_frequent(), coverage()
    sure = (cov >= least_cov) & frequent(F.greatest(*[F.col(n) for n in ACGT]), cov, least_freq)
    if hyperedit:
        sure = sure & ~(((assembly == "A") & (top == "G")) | ((assembly == "T") & (top == "C")))
    return F.when(sure, top).otherwise(assembly)


def autoref(sites: DataFrame, least_cov: int = 20, least_freq: float = 0.95, hyperedit: bool = False) -> DataFrame:
    """``sites`` (refnuc and counts pooled over strands) with n1 predicted and n2 null."""
    return sites.withColumn("n1", infer(F.col("refnuc"), least_cov, least_freq, hyperedit)).withColumn("n2", F.lit(None).cast("string"))


def assembly_only(sites: DataFrame) -> DataFrame:
    return sites.withColumn("n1", F.col("refnuc")).withColumn("n2", F.lit(None).cast("string"))


def genotypes(vcf: DataFrame) -> DataFrame:
    """(contig, pos, n1, n2) of single-nucleotide calls in ``vcf`` (contig, pos, ref, alt, filter_, gt); n2 null: homozygous.

    Records that didn't pass are dropped (``.`` counts as passed). Missing alleles are dropped and a
    single one left counts twice; no alleles, more than two, and two reference alleles are no calls.
    """
    passed = vcf.where(F.col("filter_").isin("PASS", "."))
    alleles = F.concat(F.array("ref"), F.split("alt", ","))
    called = F.filter(F.split("gt", r"[/|]"), lambda a: a.rlike(r"^\d+$"))
    numbers = F.transform(called, lambda a: a.cast("int"))
    numbered = passed.select("contig", "pos", alleles.alias("alleles"), numbers.alias("k")).where("size(k) between 1 and 2")
    pair = numbered.select("contig", "pos", "alleles", F.try_element_at("k", F.lit(1)).alias("a"), F.try_element_at("k", F.lit(-1)).alias("b")).where("a <> 0 or b <> 0")
    named = pair.select("contig", "pos", *[F.try_element_at("alleles", F.col(c) + 1).alias(c) for c in ("a", "b")])
    snv = named.where(F.col("a").rlike("^[ACGTacgt]$") & F.col("b").rlike("^[ACGTacgt]$"))
    a, b = F.upper("a"), F.upper("b")
    return snv.select("contig", "pos", F.when(a == b, a).otherwise(F.least(a, b)).alias("n1"), F.when(a != b, F.greatest(a, b)).alias("n2"))


def with_variants(sites: DataFrame, calls: DataFrame) -> DataFrame:
    """``sites`` with n1 and n2 from ``calls``, elsewhere from the assembly. Of several calls at one position a heterozygous one counts, else the least."""
    one = calls.groupBy("contig", "pos").agg(F.min_by(F.struct("n1", "n2"), F.struct(F.col("n2").isNull().alias("hom"), "n1", F.coalesce("n2", F.lit("")).alias("n2"))).alias("call"))
    joined = sites.join(one, ["contig", "pos"], "left")
    n2 = F.when(F.col("call").isNotNull(), F.col("call.n2"))
    return joined.withColumn("n1", F.coalesce("call.n1", "refnuc")).withColumn("n2", n2).drop("call")
