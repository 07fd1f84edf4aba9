import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import simhash
from strandloom.llm.graph import components


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def slow_components(pairs, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "two Words", "A b C d", "É é \x85 x\xa0y z", "w " * 5000 + "end", "x y z " * 120_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def test_fingerprint_of_blocks(monkeypatch):
    text = " ".join(f"w{k % 700}" for k in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 17)
    assert simhash.fingerprint(text) == whole


def test_keys_hold_three_segments_and_no_near_pair_misses_all():
    ways = simhash.keys()
    assert len(ways) == 10 and {mask.bit_count() for _, mask in ways} <= {38, 39}
    assert sum(simhash.segments()) == (1 << 64) - 1
    for i in range(64):
        for j in range(i + 1):
            apart = (1 << i) | (1 << j)
            assert any(not apart & mask for _, mask in ways)


@pytest.mark.parametrize("limit", [64, 3])
def test_links_connect_what_pairs_do(spark, monkeypatch, limit):
    """Random fingerprints, and dense balls of them, in small buckets and beyond the limit."""
    monkeypatch.setattr(simhash, "SMALL_BUCKET", limit)
    rnd = random.Random(limit)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for centre in list(values)[:4] + [0, (1 << 64) - 1]:
        for _ in range(40):
            values.add(centre ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ (1 << rnd.randrange(64) if rnd.random() < 0.5 else 0))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    got = {r["node"]: r["component"] for r in components(simhash.links(nodes)).collect()}
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    want = slow_components(pairs, range(len(values)))
    assert all(got.get(n, n) == c for n, c in want.items())


def test_near_duplicates_with_odd_rows(spark, make_docs):
    texts = [None, "", "a b c d", "A B  c d", "something else entirely", None]
    docs = make_docs(texts).union(make_docs(texts[2:3], 2)).withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 7
    by = {}
    for r in rows:
        by.setdefault(r["id"], set()).add(r["component"])
    assert by == {0: {0}, 1: {0}, 5: {0}, 2: {2}, 3: {2}, 4: {4}}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4]


def test_null_ids_and_empty_table(spark, make_docs):
    docs = make_docs(["x y z"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.near_duplicates(docs).first()["component"] is None
    assert simhash.keep_one(docs).count() == 1
    empty = make_docs(["x"]).where("false")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    order = np.random.default_rng(0).permutation(n)
    edges = spark.createDataFrame([(int(order[k]), int(order[k + 1])) for k in range(n - 1)] + [(5, 5)], "a long, b long")
    found = components(edges).collect()
    assert len(found) == n and {r["component"] for r in found} == {0}
