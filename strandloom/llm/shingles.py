"""Near-duplicates by the words they share: Jaccard similarity of word-shingle sets.

Each text is sketched once where it is: MinHash bands, a bit of each MinHash value, and the set of its
``WIDTH``-word shingles as 32-bit hashes. Texts that agree on a band are in a bucket together (at a similarity
of 0.8 a pair has one of ``BANDS`` bands of ``ROWS`` with a probability of 0.997, at 0.85 of 0.99996). Sizes and bits
that rule the similarity out are passed over (bits: wrongly once in a million), and the rest is
verified on the sets. Texts aren't moved, and sets only those of texts that some other may be similar to.

Equal sets are one node. First every node of a bucket is compared with the bucket's smallest one: as many pairs
as nodes. Then only buckets matter in which what is known leaves several components, and in those only pairs
of different components: pairs inside one can't change it. Nothing is capped: each such pair that sizes and bits
allow is verified, in the join's own condition, so that others make no rows.

A bucket may hold any share of all nodes: its nodes are dealt over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, release, spread_join
from .graph import components

WIDTH = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 8
#: Bits of the MinHash values that may differ: at 0.8 each does once in ten, so this is five deviations off.
MOST_BITS = 50
#: Pairs that one copy of a node's set serves; nodes of a bucket on either side of a task that compares them; shingles sketched at a time.
SERVED, DEALT, BLOCK = 64, 1024, 4096
BITS = [f"bits_{k}" for k in range(BANDS * ROWS // 64)]
SUMMARY = ["size", *BITS]
_RANDOM = np.random.default_rng(20160).integers(1, 2**32, (2, BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of a text's words, in order."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    width, digest = min(width, len(words)), xxhash.xxh64_intdigest
    each = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        total = (total ^ each[k : k + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def sketch(hashes: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(the bits in signed 64-bit words, a signed key for each band)."""
    if not len(hashes):
        return [0] * len(BITS), np.zeros(0, dtype=np.int64)
    short = hashes.astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(short), BLOCK):
        least = np.minimum(least, ((short[at : at + BLOCK] ^ _RANDOM[0]) * _RANDOM[1]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return np.packbits(least >> np.uint32(7) & np.uint32(1), bitorder="little").view(np.int64).tolist(), key.view(np.int64)


SKETCH = T.StructType(
    [T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in BITS]]
    + [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("hashes", T.ArrayType(T.IntegerType()))]
)


def name_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), 1) - (1 << 63)


def sketch_row(words: list[bytes]) -> tuple:
    """The values of SKETCH of one text's words."""
    hashes = shingle_set(words)
    bits, bands = sketch(hashes)
    return name_of(hashes), len(hashes), *bits, bands, np.unique(hashes.astype(np.uint32)).view(np.int32)


@F.pandas_udf(T.LongType())
def name_column(texts: pd.Series) -> pd.Series:
    """``node`` of texts."""
    return pd.Series([name_of(shingle_set((t or "").encode("utf-8", "surrogatepass").lower().split())) for t in texts], dtype="int64")


def may_link(a: str, b: str) -> Column:
    """False where sizes or bits, columns with these prefixes, rule the similarity out."""
    apart = [F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in BITS]
    sizes = F.col(f"{a}size"), F.col(f"{b}size")
    return (F.least(*sizes) >= F.lit(SIMILAR) * F.greatest(*sizes)) & (sum(apart[1:], apart[0]) <= MOST_BITS)


def named(prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in SUMMARY]


def similar(x: Column, y: Column) -> Column:
    shared, total = F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)
    return shared >= F.lit(SIMILAR) * (total - shared)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar. A node of many pairs as ``a`` has a copy of its set for each SERVED of them."""
    pairs = cut(pairs.distinct())
    ends = pairs.select("a").union(pairs.select("b")).toDF("node").distinct()
    mine = cut(sets.join(ends, "node", "left_semi"))
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SERVED)).cast("int").alias("copies"))
    left = mine.join(copies, F.col("node") == F.col("a")).select("a", F.col("hashes").alias("x"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    dealt = pairs.join(copies.where("copies > 1"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1)).cast("long")).cast("int").alias("copy"))
    both = dealt.join(left, ["a", "copy"]).join(mine.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    found = cut(both.where(similar(F.col("x"), F.col("y"))).select("a", "b"))
    release(pairs, mine)
    return found


def _across(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the similar nodes of one bucket (key) in different components (c), one of them outside the largest (top).

    Both the nodes outside the largest (``minor``) and all ``n`` are dealt in parts of ``DEALT``, and each part meets
    each in a task of its own; what isn't similar makes no row.
    """
    full = open_.join(sets, "node")
    part = lambda n: F.ceil(F.col(n) / F.lit(DEALT)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), part(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), part(n))
    one = full.where("c <> top").select("key", F.col("node").alias("a"), *named("a_"), F.col("c").alias("ca"), F.col("hashes").alias("x"), own("minor").alias("i"), every("n").alias("j"))
    other = full.select("key", F.col("node").alias("b"), *named("b_"), "c", "top", F.col("hashes").alias("y"), own("n").alias("j"), every("minor").alias("i"))
    new = (F.col("ca") != F.col("c")) & ((F.col("c") == F.col("top")) | (F.col("a") < F.col("b")))
    found = one.join(other, ["key", "i", "j"]).where(new & may_link("a_", "b_") & similar(F.col("x"), F.col("y")))
    return cut(found.select("a", "b").distinct())


def links(sketches: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): links that, with those ``known``, connect the same ``nodes`` (node and SUMMARY, one row each) as all similar candidates do.

    ``sketches``: (node, bands, hashes), at least one row for every node. Keys move with their node's number only; the rest
    follows for buckets that hold several nodes.
    """
    keyed = sketches.select("node", F.explode("bands").alias("key"))
    stats = cut(keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n"))
    pairs = cut(spread_join(keyed, stats, "key", "n", F.col("node")).select("key", "node").distinct())
    sets = cut(sketches.join(pairs.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")))
    shared = cut(pairs.join(nodes, "node"))
    pivots = shared.groupBy("key").agg(F.min(F.struct("size", "node")).alias("p"), F.count("*").alias("n")).select("key", F.col("p.node").alias("pivot"), "n")
    starred = spread_join(shared, pivots, "key", "n", F.col("node")).where("node <> pivot")
    centres = nodes.join(pivots.select(F.col("pivot").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("pivot"), *named("p_"))
    held = cut(starred.groupBy("pivot").agg(F.count("*").alias("m")).join(centres, "pivot"))
    near = spread_join(starred.drop("n"), held, "pivot", "m", F.col("node")).where(may_link("", "p_"))
    first = verified(near.select(F.col("pivot").alias("a"), F.col("node").alias("b")), sets)
    reach = cut(components(known.union(first)))
    placed = cut(shared.join(reach, "node", "left").select("key", "node", *SUMMARY, F.coalesce("component", "node").alias("c")))
    counts = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    main = main.select("key", F.col("most.c").alias("top"), (F.col("n") - F.col("most.n")).alias("minor"), "n")
    open_ = cut(spread_join(placed, main, "key", "n", F.col("node")))
    rest = _across(open_, sets)
    release(stats, pairs, sets, shared, held, reach, placed, open_)
    return first.union(rest)
