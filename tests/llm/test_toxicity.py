import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import toxicity

CLEAN = ["river", "stone", "garden", "winter", "letter", "music", "bread", "window"]
BAD = ["scumbag", "scumlord", "vilething"]


def corpus(n, seed=0):
    rnd = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words = rnd.choices(CLEAN, k=30)
        if k % 5 == 0:
            words[3:6] = rnd.choices(BAD, k=3)
        texts.append(" ".join(words))
        labels.append(int(k % 5 == 0))
    return texts, labels


@pytest.fixture
def trained(spark, make_docs):
    texts, labels = corpus(300)
    docs = make_docs(texts)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(labels)], "doc_id long, toxic int")
    return toxicity.train(docs, rows, ["toxic"])


def test_held_out_accuracy(spark, make_docs, trained):
    texts, labels = corpus(100, 7)
    found, name = toxicity.classify(make_docs(texts), trained)
    got = {r["doc_id"]: r[name]["toxic"] for r in found.collect()}
    assert np.mean([got[k] == bool(y) for k, y in enumerate(labels)]) > 0.97
    assert len(trained.models) == 3


def test_column_equals_features_one_by_one(spark, make_docs, trained):
    texts = [None, "", "scumbag " * 9, "river", "Scumlord,VILETHING!", "x" * 100_000, "stone " * 50_000 + "scumbag"]
    found, name = toxicity.classify(make_docs(texts).withColumn("toxicity", F.lit(1)).withColumn("scores", F.lit(2)), trained)
    got = {r["doc_id"]: r[name]["probabilities"] for r in found.collect()}
    want = trained.predict(trained.rows([toxicity.features(t) for t in texts]))
    assert np.allclose([got[k] for k in range(len(texts))], want)
    assert want[4, -1] > 0.5 > want[3, -1] and {"toxicity", "scores"} <= set(found.columns)


def test_out_of_fold_predictions_do_not_see_their_fold():
    """A feature that is unique to each row tells a model of all rows its label, and a model of the others nothing."""
    y = np.array([0.0, 1.0] * 20)
    texts = [np.array([k], dtype=np.int32) for k in range(40)]
    folds = np.arange(40) % 5
    rows = toxicity.Rows(np.arange(40), np.arange(40), (40, 40))
    full = toxicity.fit_linear(rows, np.zeros((40, 0)), y).predict(rows, np.zeros((40, 0)))
    out = folds == 0
    held = toxicity.fit_linear(rows.take(~out), np.zeros((int((~out).sum()), 0)), y[~out]).predict(rows.take(out), np.zeros((8, 0)))
    assert ((full > 0.5) == y).all() and np.ptp(held) < 1e-9
    assert toxicity.fit_chain(np.arange(40), texts, np.column_stack([y, y]), folds).models[1].dense.shape == (1,)


@pytest.mark.parametrize("labels", [[], [(0, 1), (1, 1)], [(0, None), (9, 1)]])
def test_without_both_classes(spark, make_docs, labels):
    rows = spark.createDataFrame(labels, "doc_id long, toxic int")
    chain = toxicity.train(make_docs(["a b", None]), rows, ["toxic"])
    found, name = toxicity.classify(make_docs(["a b", None, ""]), chain)
    assert len({tuple(r[name]["probabilities"]) for r in found.collect()}) == 1


def test_given_categories_and_the_bound(spark, make_docs):
    texts, labels = corpus(60)
    rows = spark.createDataFrame([(k, y, y) for k, y in enumerate(labels)], "doc_id long, insult int, toxic int")
    chain = toxicity.train(make_docs(texts), rows, ["insult", "toxic"], sample=40)
    assert len(chain.models) == 2
    assert toxicity.classify(make_docs(["x"]).where("false"), chain)[0].count() == 0


def test_features_are_chosen_without_the_fold(spark):
    """Against chi-squares counted one by one on the rows outside each fold."""
    rnd = random.Random(3)
    rows = [([f for f in range(40) if rnd.random() < (0.6 if y and f < 6 else 0.3)], float(y), k % toxicity.FOLDS) for k in range(400) for y in [rnd.random() < 0.4]]
    counts = toxicity.count_features(spark.createDataFrame(rows, "f array<int>, y double, fold int"))
    for without in (None, 0, 3):
        left = [(set(f), y) for f, y, fold in rows if fold != without]
        n, p = len(left), sum(y for _, y in left)
        want = []
        for f in range(40):
            a = sum(y for have, y in left if f in have)
            b = sum(1 - y for have, y in left if f in have)
            chi = n * (a * (n - p - b) - b * (p - a)) ** 2 / (p * (n - p) * (a + b) * (n - a - b))
            if a + b >= toxicity.LEAST_ROWS and chi > toxicity.LEAST_CHI:
                want.append((-chi, f, a * (n - p) > b * p))
        got = toxicity.choose_features(counts, float(n), float(p), without)
        assert got == [(f, tells) for _, f, tells in sorted(want)] and got


def test_linear_fit_against_newton():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 4)) < 0.4).astype(float)
    dense = rng.random((300, 1))
    y = (rng.random(300) < toxicity.sigmoid(2 * x[:, 0] - x[:, 1] + dense[:, 0] - 1)).astype(float)
    row, column = np.nonzero(x)
    found = toxicity.fit_linear(toxicity.Rows(row, column, x.shape), dense, y, steps=4000)
    z, theta = np.column_stack([x, dense, np.ones(300)]), np.zeros(6)
    weight, decay = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), 0.0005 * np.array([1, 1, 1, 1, 1, 0])
    for _ in range(30):
        p = toxicity.sigmoid(z @ theta)
        grad = z.T @ (weight * (p - y)) / 300 + decay * theta
        theta -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z / 300 + np.diag(decay), grad)
    assert np.allclose(np.concatenate([found.sparse, found.dense, [found.bias]]), theta, atol=0.02)


def test_earlier_probabilities_do_not_depend_on_labels_of_their_fold():
    rng = np.random.default_rng(2)
    texts = [np.flatnonzero(rng.random(12) < 0.4).astype(np.int32) for _ in range(100)]
    folds, every = np.arange(100) % 5, np.arange(12, dtype=np.int32)
    y = (rng.random(100) < 0.5).astype(float)
    other = np.where(folds == 2, 1 - y, y)
    a, b = (toxicity.out_of_fold(texts, np.zeros((100, 0)), folds, 0, {f: (every, np.column_stack([v, v])[folds != f]) for f in range(5)}) for v in (y, other))
    assert (a[folds == 2] == b[folds == 2]).all() and not np.allclose(a[folds != 2], b[folds != 2])


def test_the_sample_reaches_the_driver_without_a_python_object_for_each_feature(spark, make_docs, monkeypatch):
    rnd, rows = random.Random(3), 600
    words = [["".join(rnd.choices("abcdefghij", k=9)) for _ in range(250)] for _ in range(2)]
    texts = [" ".join(rnd.sample(words[k % 2], 200)) for k in range(rows)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(rows)], "doc_id long, toxic int").repartition(3)
    docs = make_docs(texts).repartition(3)
    monkeypatch.setattr(toxicity, "fit_chain", lambda chosen, held, categories, folds, by_fold: (tracemalloc.get_traced_memory()[1], held, categories, folds))
    choose = toxicity.choose_features

    def chosen(*args):
        found = choose(*args)
        tracemalloc.reset_peak()
        return found

    monkeypatch.setattr(toxicity, "choose_features", chosen)
    tracemalloc.start()
    try:
        peak, held, categories, folds = toxicity.train(docs, labels, ["toxic"])
    finally:
        tracemalloc.stop()
    counts = sum(map(len, held))
    assert len(held) == len(folds) == len(categories) == rows and counts > 400 * rows
    own = {tuple(sorted(h)): int(y) for h, y in zip(held, categories[:, -1])}
    every = np.unique(np.concatenate(held))
    assert own == {tuple(np.intersect1d(toxicity.features(t), every)): k % 2 for k, t in enumerate(texts)}
    assert peak < 25 * counts
