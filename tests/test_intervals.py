"""Interval operators against position-by-position versions."""

import random

import pytest

from strandloom.operators import intervals as iv

SCHEMA = "k long, contig string, start_ long, end_ long"


def made(spark, n, seed, low=-20, high=60):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice("ab"), s := rnd.randrange(low, high), s + rnd.randrange(1, 25)) for k in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("width", [1, 7, 256])
def test_overlaps(spark, width):
    (a, left), (b, right) = made(spark, 40, 1), made(spark, 40, 2)
    renamed = right.toDF("rk", "contig", "rs", "re")
    got = sorted((r["k"], r["rk"]) for r in iv.overlaps(left, renamed, ("start_", "end_"), ("rs", "re"), width).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_points(spark, how):
    rows, table = made(spark, 20, 3)
    points = [(c, p) for c in "abz" for p in range(-25, 90)]
    frame = spark.createDataFrame(points, "contig string, pos long")
    got = sorted((r["contig"], r["pos"]) for r in iv.points_in(frame, table, "pos", "start_", "end_", how, 8).collect())
    hits = [(c, p) for c, p in points for x in rows if x[1] == c and x[2] <= p < x[3]]
    assert got == sorted({"inner": hits, "left_semi": set(hits), "left_anti": set(points) - set(hits)}[how])


@pytest.mark.parametrize("seed", range(4))
def test_subtract(spark, seed):
    (a, left), (b, right) = made(spark, 30, seed), made(spark, 15 * seed, seed + 50)
    got = {r["k"]: [(p["start_"], p["end_"]) for p in r["pieces"]] for r in iv.subtract(left, right, "k").collect()}
    want = {}
    for k, c, s, e in a:
        rest = [p for p in range(s, e) if not any(y[1] == c and y[2] <= p < y[3] for y in b)]
        pieces = []
        for p in rest:
            if pieces and pieces[-1][1] == p:
                pieces[-1] = (pieces[-1][0], p + 1)
            else:
                pieces.append((p, p + 1))
        if pieces:
            want[k] = pieces
    assert got == want


def test_split(spark):
    table = spark.createDataFrame([(1, "c", 0, 284), (2, "c", 5, 5)], SCHEMA)
    assert sorted((r["start_"], r["end_"]) for r in iv.split(table, 100).collect()) == [(0, 100), (100, 200), (200, 284)]


@pytest.mark.parametrize(("seed", "chunk"), [(0, 1 << 20), (1, 1 << 20), (2, 16), (3, 5), (4, 64)])
def test_greedy_bins(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(iv, "CHUNK", chunk)
    rows, table = made(spark, 40, seed, 0, 300)
    want, limit = [], None
    for _, c, s, e in sorted(rows, key=lambda r: (r[1], r[2], -r[3])):
        if want and want[-1][0] == c and e <= limit:
            want[-1] = (c, want[-1][1], max(want[-1][2], e), want[-1][3] + 1)
        else:
            want.append((c, s, e, 1))
            limit = max(e, s + 30)
    assert sorted(tuple(r) for r in iv.greedy_bins(table, 30).collect()) == sorted(want)


def test_segments(spark):
    rows = spark.createDataFrame([(1, "c", 0, 20), (2, "c", 50, 60), (3, "z", 0, 5)], SCHEMA)
    features = spark.createDataFrame([("c", -5, 3), ("c", 3, 8), ("c", 8, 30), ("c", 8, 30)], "contig string, start_ long, end_ long")
    got = sorted((r["k"], r["start_"], r["end_"]) for r in iv.segments(rows, features, "k").collect())
    assert got == [(1, 0, 3), (1, 3, 8), (1, 8, 20), (2, 50, 60), (3, 0, 5)]


def test_segments_hold_no_borders_in_a_hash_table(spark):
    """Equal borders of several features, and features that end where an interval does, cut once; and nothing is aggregated on the way."""
    rows = spark.createDataFrame([(1, "c", 0, 600), (2, "c", 0, 600)], SCHEMA)
    features = spark.createDataFrame([("c", 5, 300)] * 3 + [("c", 0, 300), ("c", 300, 600), ("c", 5, 700)], "contig string, start_ long, end_ long")
    found = iv.segments(rows, features, "k")
    got = sorted((r["k"], r["start_"], r["end_"]) for r in found.collect())
    assert got == [(k, *x) for k in (1, 2) for x in ((0, 5), (5, 300), (300, 600))]
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
