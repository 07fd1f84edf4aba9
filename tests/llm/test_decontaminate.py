import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import decontaminate as dc

VOCABULARY = [f"word{k}" for k in range(400)] + ["the", "of", "and"] * 20


def slow_distance(item, text):
    """Least edit distance of ``item`` to any part of ``text``."""
    above = list(range(len(item) + 1))
    best = above[-1]
    for w in text:
        now = [0]
        for i, x in enumerate(item):
            now.append(min(above[i] + (x != w), above[i + 1] + 1, now[i] + 1))
        best, above = min(best, now[-1]), now
    return best


def edited(words, edits, rnd):
    words = list(words)
    for _ in range(edits):
        at = rnd.randrange(len(words))
        match rnd.randrange(3):
            case 0:
                del words[at]
            case 1:
                words.insert(at, rnd.choice(VOCABULARY))
            case _:
                words[at] = rnd.choice(VOCABULARY)
    return words


@pytest.fixture
def items():
    rnd = random.Random(0)
    return [(k, " ".join(rnd.choices(VOCABULARY, k=rnd.randrange(12, 60)))) for k in range(60)]


def test_best_distance(items):
    rnd = random.Random(1)
    for _, text in items[:10]:
        words = text.split()
        hay = rnd.choices(VOCABULARY, k=20) + edited(words, 4, rnd) + rnd.choices(VOCABULARY, k=20)
        ids = {w: k for k, w in enumerate(sorted({*words, *hay}))}
        got, _ = dc.best_distance(np.array([ids[w] for w in words]), np.array([ids[w] for w in hay]))
        assert got == slow_distance(words, hay)


def test_recall_and_precision_against_brute_force(items):
    rnd = random.Random(2)
    known = dc.prepare(items)
    texts = []
    for k in range(150):
        words = items[k % len(items)][1].split()
        middle = edited(words, rnd.randrange(0, dc.allowed(len(words)) + 3), rnd)
        texts.append(", ".join([*rnd.choices(VOCABULARY, k=rnd.randrange(0, 200)), *middle, *rnd.choices(VOCABULARY, k=rnd.randrange(0, 200))]))
    got = {(t, known.ids[n]): d for t, n, _, d in dc.matches(texts, known)}
    want = {}
    for t, text in enumerate(texts):
        words = text.replace(",", "").split()
        for i, item in items:
            own = item.split()
            if i == t % len(items):
                d = slow_distance(own, words)
                if d <= dc.allowed(len(own)):
                    want[t, i] = d
    assert got.items() <= want.items() | {(k, v) for k, v in got.items() if k[1] != k[0] % len(items)}
    assert len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert all(k in got for k, d in want.items() if d == 0)


@pytest.mark.parametrize("crowd", [0.0, 0.5, 1.0])
def test_recall_where_edits_crowd(items, crowd):
    """Every word of a run as long as the edits allowed is replaced, at the head, in the middle or at the tail."""
    rnd = random.Random(3)
    known, held, want = dc.prepare(items), [], 0
    for i, item in items:
        words = item.split()
        most = dc.allowed(len(words))
        at = int(crowd * (len(words) - most))
        words[at : at + most] = rnd.choices(VOCABULARY, k=most)
        around = [rnd.choices(VOCABULARY, k=30) for _ in range(2)]
        text = " ".join([*around[0], *words, *around[1]])
        want += 1
        held.append(any(known.ids[n] == i for _, n, _, _ in dc.matches([text], known)))
    assert sum(held) >= dc.RECALL * want


def test_blocks_change_nothing(items, monkeypatch):
    known = dc.prepare(items)
    texts = [items[k % 60][1] + " x" * (k % 7) for k in range(90)]
    whole = dc.matches(texts, known)
    monkeypatch.setattr(dc, "CHUNK", 50)
    assert dc.matches(texts, known) == whole and len({t for t, *_ in whole}) == 90


def test_case_and_punctuation(items):
    known = dc.prepare(items)
    assert [k[:2] for k in dc.matches([items[5][1].upper().replace(" ", "; ")], known)] == [(0, next(n for n, i in enumerate(known.ids) if i == 5))]


def test_short_items_are_exact():
    known = dc.prepare([(1, "one two three"), (2, ""), (3, None), (4, "..."), (5, "solo")])
    assert sorted((t, known.ids[n]) for t, n, *_ in dc.matches(["one two three four", "one two", "SOLO", None, ""], known)) == [(0, 1), (2, 5)]


def test_tables(spark, make_docs, items, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 25)
    bench = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    texts = [None, "", "clean text of nothing", f"before {items[0][1]} after", f"{items[1][1]} {items[2][1]}", "very long " * 50_000 + items[3][1]]
    docs = make_docs(texts).withColumn("leak", F.lit("clash")).withColumn("distance", F.lit(1)).withColumn("item_id", F.lit(2))
    docs = docs.union(docs.where("doc_id = 3"))
    found = dc.find_leaks(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in found) == [(3, 0, 0), (3, 0, 0), (4, 1, 0), (4, 2, 0), (5, 3, 0)]
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2]


def test_empty_tables(spark, make_docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert dc.find_leaks(make_docs(["x"]).where("false"), bench).count() == 0
    assert dc.find_leaks(make_docs([items[0][1]]), bench.where("false")).count() == 0
    assert dc.drop_contaminated(make_docs([items[0][1]]), bench.where("false")).count() == 1


def with_edits(words, crowd, rnd):
    """The most edits allowed: anywhere, or insertions, deletions and replacements in a run that begins at ``crowd``."""
    out, most = list(words), dc.allowed(len(words))
    for _ in range(most):
        at = rnd.randrange(len(out)) if crowd is None else min(len(out) - 1, int(crowd * (len(words) - most)) + rnd.randrange(most))
        match rnd.randrange(3):
            case 0:
                del out[at]
            case 1:
                out.insert(at, rnd.choice(VOCABULARY))
            case _:
                out[at] = rnd.choice(VOCABULARY)
    return out


@pytest.mark.parametrize("size", [15, 30, 60, 100, 300])
def test_recall_at_every_size_wherever_the_edits_are(size):
    rnd = random.Random(size)
    items = [(k, " ".join(rnd.choices(VOCABULARY, k=size))) for k in range(30)]
    known = dc.prepare(items)
    for crowd in (None, 0.0, 0.25, 0.5, 0.75, 1.0):
        texts = [" ".join([*rnd.choices(VOCABULARY, k=30), *with_edits(items[k % 30][1].split(), crowd, rnd), *rnd.choices(VOCABULARY, k=30)]) for k in range(150)]
        found = {(t, known.ids[n]) for t, n, _, _ in dc.matches(texts, known)}
        assert sum((t, t % 30) in found for t in range(150)) >= dc.RECALL * 150, crowd


def test_the_exact_way_where_samples_do_not_reach_the_recall(monkeypatch):
    """A recall that no number of samples reaches: every copy is found, as by brute force."""
    rnd = random.Random(8)
    items = [(k, " ".join(rnd.choices(VOCABULARY, k=rnd.randrange(10, 40)))) for k in range(30)]
    monkeypatch.setattr(dc, "MOST_SAMPLES", 2)
    known = dc.prepare(items, recall=1.01)
    assert all(c.samples[-1][0] == dc.STRAIGHT for c in known.classes)
    texts = [" ".join(["odd", *with_edits(items[k % 30][1].split(), None, rnd), "odd"]) for k in range(300)]
    found = {(t, known.ids[n]) for t, n, _, _ in dc.matches(texts, known)}
    assert all((t, t % 30) in found for t in range(300))


def test_rows_without_ids_and_very_long_texts(spark, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, items[7][1]), (1, "filler words here " * 60_000 + items[8][1] + " filler" * 1000), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in dc.find_leaks(docs, bench).collect()) == [("1", 8), ("None", 7)]
    assert [tuple(r) for r in dc.drop_contaminated(docs, bench).collect()] == [(None, None)]
