"""URL rules by a sort-merge range join.

A url's key is its host reversed label by label, each label closed by ``LABEL_END``.
A rule's host, keyed alike, is the prefix of the keys of that host and all its subdomains: an
interval of keys, and the intervals of nested hosts nest. Keys are dealt by range to parts whose
bounds come from a sample of the keys (with a hash of the row, so that one key that very many rows
share is split too); a rule goes to every part that its interval meets. Each part is sorted and
swept once, with a stack of the hosts whose intervals are open; a row asks the open hosts for the
longest rule whose path its own starts with.

Null urls and those without ``://`` have empty host and path and fit no rule. Rules without rows
and rows without rules are fine; of equal rules the one that sorts first wins, ``allow`` before
``block``. Ties between rules of one length go to the longer host.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions

#: Below every character of a host label, so that a host's subdomains follow it at once.
LABEL_END = "\x01"
#: Bounds on what the driver holds of the keys: parts, and sampled keys a part.
MOST_PARTS = 4096
SAMPLED_KEYS = 32
ROWS_A_PART = 100_000
#: Parts are dealt to partitions by hash: with several a partition, their sums are even.
PARTS_A_PARTITION = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.substring_index(_after_scheme(url), "#", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "/", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; may be empty."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "#", 1), "?", 1)
    at = F.locate("/", rest)
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, LABEL_END), F.lit(LABEL_END)))


def _bounds(keyed: DataFrame, rows: int) -> list[tuple[str, int]]:
    """Upper bounds of all parts but the last, from a sample of (key, salt) of a set size."""
    parts = min(MOST_PARTS, max(-(-rows // ROWS_A_PART), PARTS_A_PARTITION * shuffle_partitions(keyed.sparkSession)))
    wanted = parts * SAMPLED_KEYS
    taken = keyed.select("key", "salt")
    if rows > wanted:
        taken = taken.where(F.pmod(F.xxhash64("salt"), F.lit(rows)) < wanted)
    sample = sorted((r[0], r[1]) for r in taken.collect())
    return [sample[k * len(sample) // parts] for k in range(1, parts)] if sample else []


class _Open:
    """A host whose interval is open, with its rules by path."""

    __slots__ = ("host", "key", "paths", "sizes")

    def __init__(self, key: str) -> None:
        self.key, self.paths, self.sizes = key, {}, []
        self.host = ".".join(reversed(key.split(LABEL_END)[:-1]))

    def add(self, path: str, verdict: str) -> None:
        self.paths.setdefault(path, verdict)
        if len(path) not in self.sizes:
            self.sizes.append(len(path))
            self.sizes.sort(reverse=True)

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.sizes if n <= len(path) and path[:n] in self.paths), None)


def sweep(rows: Iterator[tuple]) -> Iterator[tuple[str | None, str | None]]:
    """(rule, verdict) of each url row among (part, key, is_url, path, verdict), sorted by the first three.

    Rules come as rows with their host's key; those of one part come before its urls with that key.
    """
    stack: list[_Open] = []
    part = None
    for here, key, is_url, path, verdict in rows:
        if here != part:
            stack, part = [], here
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        if not is_url:
            if not stack or stack[-1].key != key:
                stack.append(_Open(key))
            stack[-1].add(path, verdict)
            continue
        fits = [(o, p) for o in stack if (p := o.longest(path)) is not None]
        if not fits:
            yield None, None
            continue
        best, p = max(fits, key=lambda f: (len(f[0].host) + len(f[1]), len(f[0].host)))
        yield best.host + p, best.paths[p]


def judge(pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has host, path and verdict (block or allow).

    Columns of ``pages`` with those names, in any case, are replaced.
    """
    spark: SparkSession = pages.sparkSession
    made = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in made]
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    keyed = pages.select(
        F.struct(*kept).alias("own"), host_of(url).alias("host"), path_of(url).alias("path")
    ).withColumn("key", host_key(F.col("host"))).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    bounds = _bounds(keyed.select("key", "salt"), keyed.count())
    schema = pages.select(F.struct(*kept).alias("own")).schema
    part_of = _part_column(bounds)
    urls = keyed.select(
        part_of("key", "salt").alias("part"), "key", F.lit(1).alias("is_url"), "path", F.lit(None).cast("string").alias("verdict"), "host", "own"
    )
    listed = rules.select(
        host_key(F.lower("host")).alias("key"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).where("key <> ''").distinct()
    meets = _meeting_column(bounds)
    spread = listed.select(F.explode(meets(F.col("key"))).alias("part"), "key", F.lit(0).alias("is_url"), "path", "verdict", F.lit(None).cast("string").alias("host"), F.lit(None).cast(schema["own"].dataType).alias("own"))
    both = urls.unionByName(spread).repartition(max(shuffle_partitions(spark), (len(bounds) + 1) // PARTS_A_PARTITION), "part").sortWithinPartitions("part", "key", "is_url", "path", "verdict")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                waiting.append(batch)
                yield from zip(*(batch.column(k).to_pylist() for k in range(5)))

        out: list[tuple] = []
        for answer in sweep(rows()):
            out.append(answer)
            while len(waiting) > 1:
                yield from _answered(waiting.pop(0), out)
        for batch in waiting:
            yield from _answered(batch, out)

    out_schema = T.StructType([schema["own"], *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])
    judged = both.mapInArrow(run, out_schema)
    return judged.select("own.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _answered(batch: pa.RecordBatch, out: list[tuple]) -> Iterator[pa.RecordBatch]:
    urls = batch.filter(pc.equal(batch.column("is_url"), 1))
    n = urls.num_rows
    if n:
        mine = out[:n]
        del out[:n]
        rule, verdict = (pa.array([a[k] for a in mine], pa.string()) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([urls.column("own"), urls.column("host"), urls.column("path"), rule, verdict], names=["own", "host", "path", "rule", "verdict"])


def _part_column(bounds: list[tuple[str, int]]):
    @F.pandas_udf("int")
    def part(keys: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, (k, s)) for k, s in zip(keys, salts)], dtype="int32")

    return part


def _meeting_column(bounds: list[tuple[str, int]]):
    keys = [b[0] for b in bounds]

    @F.pandas_udf("array<int>")
    def meets(prefixes: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(keys, p), bisect_right(keys, p[:-1] + chr(ord(LABEL_END) + 1)) + 1)) for p in prefixes])

    return meets
