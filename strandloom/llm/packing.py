"""Best-fit packing by minimum bin slack.

Texts become pieces of at most ``capacity`` tokens. Pieces of one length are alike, so the
packing needs the histogram of lengths only: at most ``capacity`` rows, whatever the corpus.
For each bin the driver fixes the longest length left, finds by a bitset subset-sum programme the
fullest combination with the lengths available, and removes it as often as the counts allow (the
fullest combination stays the fullest while it is available, so this is the same as one bin at a
time). The plan has a row for each combination and length; the pieces find their bin by their rank
among the pieces of their length.

Null texts count as empty, and a text without tokens is a piece of its closing id. An empty table gives an empty one. Ids may repeat or be null:
rows are told apart by a number of their own, and repeated rows are packed each. Pieces of one length are alike, so which of them
takes which place follows from their rows' numbers. Very long texts are tokenized whole, in blocks of about ``BLOCK_CHARS`` characters with others.
Only the id and the text are read, so extra columns of any name don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, give_back
from .wordbpe import WordBPE

CAPACITY = 4096
END_ID = 1
#: Pieces of one length that are ranked together; a length with more is split into so many groups.
RANK_GROUP = 256
#: Characters that are tokenized at a time.
BLOCK_CHARS = 8_000_000


def _piece_schema(kind: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]
    )


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` of about BLOCK_CHARS characters."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= BLOCK_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per piece: its row's number, document, number, start, length and the CRC-32 of its ids."""
    schema = _piece_schema(docs.schema[id_column].dataType)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordBPE(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in _blocks(texts):
                rows, out = [], []
                for row, ids in enumerate(tokenizer.ids(texts[lo:hi]), lo):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(row)
                        out.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
                numbers = np.array(out, dtype=np.int64).reshape(-1, 4).T
                taken = [batch.column(k).take(pa.array(rows, pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array(numbers[0].astype(np.int32)), *map(pa.array, numbers[1:])],
                    names=["row", "doc_id", "piece", "start", "length", "ids_crc32"],
                )
        del tokenizer
        give_back()

    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return named.mapInArrow(make, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination of available lengths with the least slack that holds the longest of them."""
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    first = lengths[0]
    room = capacity - first
    chosen = {first: 1}
    if room == 0:
        return chosen
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        left = min(counts[n] - (n == first), room // n)
        k = 1
        while left > 0 and not reach >> room & 1:
            take = min(k, left)
            steps.append((n, take, reach))
            reach |= reach << n * take & full
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            at -= n * take
            chosen[n] = chosen.get(n, 0) + take
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, bins, copies, first bin, offset) that cover every rank of every length."""
    counts, used, bins, plan = dict(histogram), dict.fromkeys(histogram, 0), 0, []
    while any(counts.values()):
        chosen = fullest(counts, capacity)
        times = min(counts[n] // c for n, c in chosen.items())
        offset = 0
        for n, c in sorted(chosen.items(), reverse=True):
            plan.append((n, used[n], times, c, bins, offset))
            used[n] += times * c
            counts[n] -= times * c
            offset += n * c
        bins += times
    return plan


def _place(plan: list[tuple]) -> object:
    by_length: dict[int, tuple[list, list]] = {}
    for n, first, times, copies, bin_, offset in plan:
        starts, rows = by_length.setdefault(n, ([], []))
        starts.append(first)
        rows.append((times, copies, bin_, offset))

    tables = {n: (np.array(s), np.array(r)) for n, (s, r) in by_length.items()}

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            starts, rows = tables[int(n)]
            k = np.searchsorted(starts, ranks[at], side="right") - 1
            inner = ranks[at] - starts[k]
            sequence[at] = rows[k, 2] + inner // rows[k, 1]
            offset[at] = rows[k, 3] + inner % rows[k, 1] * n
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return place


def ranked(parts: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``parts`` with ``rank``, from 0 within each length; lengths with many pieces are ranked in groups."""
    spark = parts.sparkSession
    groups = spark.createDataFrame([(int(n), max(1, -(-c // RANK_GROUP))) for n, c in histogram.items()], "length long, g long")
    spread = parts.join(F.broadcast(groups), "length").withColumn("g", F.pmod(F.xxhash64("row", "piece"), F.col("g")))
    sizes = spread.groupBy("length", "g").agg(F.count("*").alias("n"))
    # before: rows of a length in the groups below; in blocks of groups, so that no task sums all groups of a length
    blocks = sizes.withColumn("block", F.floor(F.col("g") / RANK_GROUP))
    inner = Window.partitionBy("length", "block").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = blocks.groupBy("length", "block").agg(F.sum("n").alias("n")).withColumn("top", F.coalesce(F.sum("n").over(outer), F.lit(0)))
    before = blocks.join(tops.select("length", "block", "top"), ["length", "block"]).select(
        "length", "g", (F.col("top") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("before")
    )
    own = Window.partitionBy("length", "g").orderBy("row", "piece")
    return (
        spread.withColumn("own", F.row_number().over(own))
        .join(before, ["length", "g"])
        .withColumn("rank", F.col("before") + F.col("own") - 1)
    )


def pack_pieces(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (with row, piece and length) with sequence_id and offset."""
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = _place(plan_bins(histogram, capacity))
    placed = ranked(parts, histogram).withColumn("at", place("length", "rank"))
    return placed.select(*[c for c in parts.columns if c != "row"], "at.sequence_id", "at.offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All of ``docs`` in as few sequences of ``capacity`` tokens as minimum bin slack finds."""
    return pack_pieces(cut(pieces(docs, tokenizer_path, capacity, id_column, text_column)), capacity)
