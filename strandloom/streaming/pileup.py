"""Pileups of a stream of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import filters, pileup


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Alignments from Parquet files as they are added to ``path``."""
    return spark.readStream.schema(schema).parquet(path)


def counts(reads: DataFrame, design: str = "u", **bases) -> DataFrame:
    """Running counts by contig, position and strand."""
    return pileup.stranded_pileup(pileup.bases(reads.where(filters.reads()), design, **bases))


def start(reads: DataFrame, checkpoint: str, table: str, design: str = "u", mode: str = "complete") -> StreamingQuery:
    """Keeps a memory table of the counts up to date. For other sinks use ``counts(...).writeStream``."""
    return counts(reads, design).writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).start()
