import random

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import quality


def corpus(n, seed=0):
    rnd = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words = ["".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 9))) for _ in range(60)]
        good = k % 4 != 0
        texts.append(" ".join(words) + "." if good else rnd.choice(["Buy!! ".upper() * 30, f"{words[0]} " * 60, " ".join(w + "$$$" for w in words)]))
        labels.append(int(good))
    return texts, labels


def test_held_out(spark, make_docs):
    texts, labels = corpus(200)
    docs = make_docs(texts)
    voter = quality.train(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int"), "quality")
    more, truth = corpus(80, 5)
    scores = {r["doc_id"]: r["s"] for r in make_docs(more).select("doc_id", quality.score_udf(voter)("text").alias("s")).collect()}
    assert np.mean([(scores[k] >= 0.3) == bool(y) for k, y in enumerate(truth)]) > 0.97


def test_blocks_equal_one_by_one(monkeypatch):
    texts, labels = corpus(120)
    raw = np.stack([quality.measure(t) for t in texts])
    voter = quality.fit(raw.copy(), np.array(labels))
    whole = voter.score(raw)
    monkeypatch.setattr(quality, "BLOCK", 7)
    assert np.allclose(voter.score(raw), whole)
    brute = []
    for v in voter.project(raw):
        cosine = voter.vectors @ v
        near = np.flatnonzero(cosine >= np.sort(cosine)[-quality.NEIGHBOURS] - 1e-7)
        weight = np.maximum(cosine[near], 1e-2) ** quality.SHARPNESS
        brute.append((weight * voter.labels[near]).sum() / weight.sum())
    assert np.allclose(whole, brute, atol=1e-3)


def test_long_texts_are_measured_whole(monkeypatch):
    text = "".join(random.Random(3).choices("ab C.1\n", k=5000))
    whole = quality.measure(text)
    monkeypatch.setattr(quality, "CHUNK", 37)
    assert np.allclose(quality.measure(text), whole)


def test_odd_rows(spark, make_docs):
    docs = make_docs([None, "", " ", "\x00", "é" * 10_000])
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"), "quality")
    assert {r[0] for r in docs.select(quality.score_udf(none)("text")).collect()} == {0.5}
    some = quality.train(docs, spark.createDataFrame([(0, 1), (1, None), (4, 0), (77, 1)], "doc_id long, quality int"), "quality")
    assert len(some.labels) == 2
    found = docs.withColumn("score", F.lit(3)).select(quality.score_udf(some)("text").alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in found)
    assert docs.where("false").select(quality.score_udf(some)("text")).count() == 0


def test_axes_span_what_a_full_decomposition_does():
    texts, labels = corpus(90)
    raw = np.stack([quality.measure(t) for t in texts]).astype(np.float64)
    found, (_, values, rows) = quality.leading_axes(raw, 5), np.linalg.svd(raw, full_matrices=False)
    assert np.allclose(np.linalg.norm(raw @ found, axis=0), values[:5], rtol=1e-3)
    assert np.allclose(np.abs((found.T @ rows[:3].T)[:3].diagonal()), 1, atol=1e-2)


def test_terms_enter_the_space():
    a, b = quality.measure("the cat sat on the mat"), quality.measure("tfe cbt sbt om tfe mbt")
    assert np.allclose(a[: quality.BUCKETS + quality.EXTRA], b[: quality.BUCKETS + quality.EXTRA]) and a @ b < a @ a
    assert np.isclose(np.linalg.norm(a[quality.BUCKETS + quality.EXTRA :]), quality.TERM_WEIGHT, atol=0.05)


def test_all_that_are_as_near_vote():
    """Thirty labelled copies of one text: whichever come first, the share of all of them counts."""
    raw = np.stack([quality.measure("one two three")] * 30 + [quality.measure("4 5 6!!")] * 10)
    labels = np.array([1] * 15 + [0] * 15 + [1] * 10)
    assert np.allclose(quality.fit(raw, labels).score(np.stack([quality.measure("one two three")])), 0.5)
