"""SimHash near-duplicates, found by pigeonring filtering.

Fingerprints differ in at most ``TAU`` bits. With the 64 bits cut into ``SEGMENTS`` segments on
a ring, some segment starts a chain whose first l segments differ in at most
``l * TAU / SEGMENTS`` bits together, for every l. For 2 bits and 5 segments the budgets are
0, 0, 1, 1, 2: the first two segments of the chain agree exactly, and of the next two, which differ in one
bit together, one does. Such three segments, 38 or 39 bits, are the join key, so that buckets hold
other fingerprints than near ones only beyond some 10^12 of them; the whole chain is checked
on the pairs of a bucket before the full distance.

Equal fingerprints are one node before any join. Buckets of up to ``SMALL_BUCKET`` nodes are
compared in blocks and give a spanning forest of their links. More nodes that agree in 38 bits are
a dense cluster; there two nodes within two bits of each other share a point within one bit of both, so every
node is joined to the points around it: at most 27 rows a node and key, whatever the bucket's size.

Nulls and empty texts: fingerprint zero, linked like any other. Null ids: kept, never a
component's name unless all its ids are null. Repeated rows: each gets its own result row. Ties don't arise:
links are symmetric and a component has one smallest id. Empty tables give empty ones. Columns are read by
the names given and results have their own, so extra columns of any name are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import shingles
from .common import cut, free_name, give_back, release, spread_join
from .graph import components

TAU = 2
SHINGLE = 3
SEED = 42
SEGMENTS = 5
SMALL_BUCKET = 64
#: Words that are turned to shingles at a time, so that a very long text needs no more memory.
BLOCK = 100_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of one text: bit by bit, the majority of its shingles' XXH64."""
    return fingerprint_of(words_of(text), width)


def fingerprint_of(words: list[bytes], width: int = SHINGLE) -> int:
    if not words:
        return 0
    width = min(width, len(words))
    total, ones = len(words) - width + 1, np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, BLOCK):
        part = words[at : min(at + BLOCK, total) + width - 1]
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(part[k:] for k in range(width)))]
        lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        if len(hashes) < 2000:
            ones += np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            for lane in range(8):
                seen = np.bincount(lanes[:, lane], minlength=256)
                ones[8 * lane : 8 * lane + 8] += seen @ _BITS
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


@F.pandas_udf(T.LongType())
def fingerprint_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def segments(count: int = SEGMENTS) -> list[int]:
    """Bit masks of the ring's segments, unsigned."""
    edges = [64 * k // count for k in range(count + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keys(count: int = SEGMENTS, tau: int = TAU) -> list[tuple[int, int]]:
    """(chain's first segment, mask of segments that agree) of every way in which a chain within its budgets can begin.

    The segments whose budget is below one bit, and one of those after them whose budget is below two.
    """
    masks, budgets = segments(count), [length * tau // count for length in range(1, count + 1)]
    lead, more = budgets.count(0), budgets.count(1)
    ways = range(lead, lead + more) if more > 1 else [None]
    at = lambda start, k: masks[(start + k) % count]
    return [(start, sum(at(start, k) for k in range(lead)) | (at(start, way) if way is not None else 0)) for start in range(count) for way in ways]


def chain_links(values: np.ndarray, start: int, tau: int = TAU) -> list[tuple[int, int]]:
    """Spanning forest of the links in one bucket: chains from segment ``start``, then the distance."""
    masks, n = segments(), len(values)
    values = values.view(np.uint64)
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(n - 1):
        apart, spent = values[i + 1 :] ^ values[i], 0
        keep = np.ones(len(apart), dtype=bool)
        for length in range(1, len(masks) + 1):
            spent = spent + np.bitwise_count(apart & np.uint64(masks[(start + length - 1) % len(masks)]))
            keep &= spent <= length * tau // len(masks)
        for j in np.flatnonzero(keep):
            x, y = top(i), top(i + 1 + int(j))
            if x != y:
                root[x] = y
                links.append((i, i + 1 + int(j)))
    return links


_LINKS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


@F.pandas_udf(_LINKS)
def _bucket_links(start: pd.Series, nodes: pd.Series, values: pd.Series) -> pd.Series:
    out = []
    for i, ids, prints in zip(start, nodes, values):
        found = chain_links(np.asarray(prints, dtype=np.int64), int(i))
        out.append([{"a": int(ids[x]), "b": int(ids[y])} for x, y in found])
    return pd.Series(out)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that connect the same ``nodes`` (node, fp) as all pairs within ``TAU`` bits do."""
    ways = keys()
    starts = F.array(*[F.lit(start) for start, _ in ways])
    signed = nodes.select(
        "node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for _, m in ways])).alias("i", "key")
    )
    sizes = signed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(signed.join(sizes, ["i", "key"]))
    small = (
        shared.where(F.col("n") <= SMALL_BUCKET)
        .groupBy("i", "key")
        .agg(F.collect_list(F.struct("node", "fp")).alias("m"))
        .select(F.explode(_bucket_links(starts[F.col("i")], F.col("m.node"), F.col("m.fp"))).alias("e"))
        .select("e.a", "e.b")
    )
    flips = F.array(
        F.lit(0).cast("long"), *[F.lit(_signed(1 << bit)) for bit in range(64)]
    )
    free = F.array(*[F.lit(_signed(~m & (1 << 64) - 1)) for _, m in ways])
    around = (
        shared.where(F.col("n") > SMALL_BUCKET)
        .withColumn("flip", F.explode(flips))
        .where(F.col("flip").bitwiseAND(free[F.col("i")]) == F.col("flip"))
        .select("i", "node", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    )
    first = around.groupBy("i", "point").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    large = around.join(first, ["i", "point"]).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return small.union(large)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp, component): one row for every row of ``docs``; component is the smallest id reachable."""
    prints = cut(docs.select(F.col(id_column).alias("id"), fingerprint_column(F.col(text_column).cast("string")).alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("n")))
    # Fingerprints are the graph's nodes: an id that is there twice doesn't link its texts.
    reach = components(links(nodes.select(F.col("fp").alias("node"), "fp")))
    reached = nodes.join(reach.withColumnsRenamed({"node": "fp", "component": "class"}), "fp", "left")
    classes = cut(reached.select("fp", "node", "n", F.coalesce("class", "fp").alias("class")))
    named = classes.groupBy("class").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    found = cut(spread_join(classes, named, "class", "size", F.col("fp")).select("fp", "n", "component"))
    release(nodes, classes)
    return spread_join(prints, found, "fp", "n", F.col("id")).select("id", "fp", "component")


#: Texts that are sketched before their rows are handed on.
SKETCHED = 256


def _sketches(texts: DataFrame) -> DataFrame:
    """(id, fp) of ``texts`` (id, text) and what ``shingles`` needs: one Python worker a task reads each text once."""
    schema = T.StructType([texts.schema["id"], T.StructField("fp", T.LongType()), *shingles.SKETCH.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SKETCHED):
                part = batch.slice(at, SKETCHED)
                words = [words_of(t) for t in part.column(1).to_pylist()]
                prints = [fingerprint_of(w) for w in words]
                *plain, bands, hashes = zip(*(shingles.sketch_row(w) for w in words))
                plain, lists = [part.column(0), prints, *plain], (bands, hashes)
                columns = [pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(plain, arrow)]
                for each, field in zip(lists, list(arrow)[len(plain) :]):
                    ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each), field.type.value_type)).cast(field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        give_back()

    return texts.mapInArrow(run, schema)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of every group of near-duplicates the one with the smallest id.

    Near-duplicates are within ``TAU`` bits of each other's fingerprint, or share ``shingles.SIMILAR`` of their five-word shingles
    (``shingles``). Rows without an id stay: no group can be named by them, so none is known to be a
    copy. Rows that share an id are one row only where they are of one shingle set. Null and empty texts are
    copies of each other. All columns come back as they were.
    """
    text = F.col(text_column).cast("string")
    named = docs.where(F.col(id_column).isNotNull())
    prints = cut(_sketches(named.select(F.col(id_column).alias("id"), text.alias("text"))))
    texts = cut(prints.groupBy("node").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in shingles.SUMMARY]))
    of_print = F.xxhash64("fp", F.lit("fingerprint"))
    held = cut(prints.select(of_print.alias("a"), F.col("node").alias("b")).distinct())
    bits = cut(links(prints.select("fp").distinct().select(of_print.alias("node"), "fp")))
    alike = cut(shingles.links(prints.select("node", "bands", "hashes"), texts.select("node", *shingles.SUMMARY), held.union(bits)))
    groups = cut(components(held.union(bits).union(alike)))
    firsts = cut(texts.join(groups, "node").groupBy("component").agg(F.min(F.struct("id", "node")).alias("first")).select("first.*"))
    again = prints.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").join(firsts, "id", "left_semi").limit(1).count()
    release(prints, texts, held, bits, alike, groups)
    key, node = free_name(docs, "kept"), free_name(docs, "node")
    if again:  # an id that is there twice
        named = named.withColumn(node, shingles.name_column(text))
        wanted = firsts.select(F.col("id").alias(key), F.col("node").alias(f"{key}_node"))
        kept = named.join(wanted, (F.col(id_column) == F.col(key)) & (F.col(node) == F.col(f"{key}_node")), "left_semi")
        kept = kept.dropDuplicates([id_column, node]).drop(node)
    else:
        kept = named.join(firsts.select(F.col("id").alias(key)), F.col(id_column) == F.col(key), "left_semi")
    return kept.union(docs.where(F.col(id_column).isNull()))
