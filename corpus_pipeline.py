"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes what the one before it kept, as a table, and all but the last return the columns of
documents: rows that a filter rejects are gone, secrets are replaced in the texts that hold them
(``n_chars`` follows), and the last gives the pieces with their places in the sequences.

Every stage takes nulls in any column (a null text counts as empty, and stays null where it is kept), empty and very long texts,
repeated rows and ids, and empty tables; further columns of any name come through all stages but the last as they are. What each stage
makes of them is said at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, packing, secrets, simhash, toxicity
from strandloom.llm.common import cut, release, table
from strandloom.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among them, calls toxic go; one at the threshold goes.

    Repeated rows are judged alike. Without labels of both kinds all have one score, the share of toxic labels.
    """
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), ["toxic"])
    found, name = toxicity.classify(docs, chain)
    return found.where(~F.col(name)["toxic"]).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id: of fingerprints within two bits, and of texts that share 0.8 of their five-word shingles.

    Repeated rows are one; rows with one id but unlike texts all stay; rows without an id stay. Null and empty texts are copies of each other.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window within a fifth of a benchmark item's words of it in edit distance go, each row by its own text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced: all of the three base kinds, copied or live, and other tokens that look live.

    A source stands for an owner, its rows of one language for a repository; n_chars of a null text stays.
    """
    clean = secrets.redact_secrets(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces of up to 4096 tokens with their places in sequences; a row without text is one piece of its closing id."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: SQL has no classifier, no XXH64 and no tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it wrote is deleted once the next has read it."""
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, before = cut(stage(spark, docs, sf_dir)), written
        if before is not None:
            release(before)
        written = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written by now, and only they are read on
    release(docs)
    return packed
