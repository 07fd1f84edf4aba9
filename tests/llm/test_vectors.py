import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {r[0]: set() for r in rows}
    for a in ok:
        for b in ok:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.asarray(v, dtype=np.float32).astype(float) for v in (a[1], b[1]))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[a[0]].add(b[0])
    least = {}
    for start in links:
        seen, todo = {start}, [start]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        least[start] = min(seen)
    return {i: (len(links[i]), least[i], least[i] == i) for i in links}


def clustered(n, seed=0, size=16):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.normal(size=(max(1, n // 12), size))
    for k in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(size=size) * rng.choice([0.02, 0.1, 0.3, 2.0])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 2))))
    return rows


def run(spark, rows, **more):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("clash")).withColumn("n", F.lit(0))
    return {r["id"]: (r["n_links"], r["component"], r["kept"]) for r in vectors.near_duplicates(table, **more).collect()}


@pytest.mark.parametrize(("shard", "block"), [(600, 1200), (40, 60), (30, 12)])
def test_recall_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = clustered(300)
    got, want = run(spark, rows), brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())


def test_the_last_round_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROUNDS", ((0, 0),))
    monkeypatch.setattr(vectors, "BLOCK", 25)
    rows = clustered(150, 3)
    assert run(spark, rows) == brute(rows)


def test_audit_sees_what_is_missing(spark):
    rows = clustered(120, 4)
    nodes = spark.createDataFrame([(r[2], r[0], 1, r[1]) for r in rows], "label int, node long, n long, v array<float>")
    want = brute(rows)
    none, some, all_ = (spark.createDataFrame([(r[0], 0, int(want[r[0]][0] * f), r[0]) for r in rows], vectors._FOUND) for f in (0, 0.5, 1))
    links = sum(w[0] for w in want.values())
    assert vectors.audit(nodes, none) == (0.0, links) and vectors.audit(nodes, all_) == (1.0, links)
    linked = [int(w[0] * 0.5) / w[0] for w in want.values() if w[0]]
    assert abs(vectors.audit(nodes, some)[0] - np.mean(linked)) < 1e-9


def test_one_dense_cluster_does_not_hide_lost_links(spark):
    """A node with many links found and many nodes with all of theirs lost."""
    rows = [(k, [1.0, 0.001 * k, 0.0], 0) for k in range(60)] + [(100 + 2 * k + j, [0.0, float(np.cos(k)), float(np.sin(k)) + 0.001 * j], k + 1) for k in range(30) for j in (0, 1)]
    nodes = spark.createDataFrame([(r[2], r[0], 1, r[1]) for r in rows], "label int, node long, n long, v array<float>")
    found = spark.createDataFrame([(r[0], 0, 59 if r[0] < 100 else 0, r[0]) for r in rows], vectors._FOUND)
    recall, links = vectors.audit(nodes, found)
    assert recall == 0.5 and links == 60 * 59 + 60


def test_repeated_ids_are_separate_rows(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0)]
    found = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["id"], r["n_links"], r["component"]) for r in found) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_two_levels_of_centroids(spark, monkeypatch):
    for name, value in (("FLAT", 4), ("SHARD", 20), ("BLOCK", 40)):
        monkeypatch.setattr(vectors, name, value)
    rows = clustered(400, 6)
    got, want = run(spark, rows), brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
        (7, [nan, 1.0], 1), (8, [inf, 0.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e30, 1e29], 1), (13, [1e-30, 1e-31], 1),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == {}


def test_copies_count_as_links(spark):
    rows = [(k, [1.0, 2.0], 0) for k in range(50)] + [(50, [1.0, 2.01], 0)]
    assert run(spark, rows) == {k: (50, 0, k == 0) for k in range(51)}


def test_graph_search_finds_a_dense_cluster():
    rng = np.random.default_rng(1)
    x = vectors.unit(np.concatenate([rng.normal(size=(1, 32)) + rng.normal(size=(300, 32)) * 0.05, rng.normal(size=(300, 32))]))
    a, b = np.nonzero((adjacency := vectors.build(x)) >= 0)
    linked = vectors.search(x, vectors.united([np.column_stack([a, adjacency[a, b]])], len(x)))
    exact = x @ x.T >= vectors.THRESHOLD
    np.fill_diagonal(exact, False)
    assert not (linked & ~exact).any() and linked.sum() >= 0.99 * exact.sum()
