import random

import pytest

from strandloom.llm import shingles, simhash


def similar(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(a & b) >= 0.8 * len(a | b)


def copies(rnd, count, groups):
    out = []
    for _ in range(groups):
        words = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        for _ in range(count):
            edited = list(words)
            for _ in range(rnd.randrange(0, 7)):
                edited[rnd.randrange(300)] = f"x{rnd.randrange(5000)}"
            out.append(" ".join(edited))
    return out


@pytest.mark.parametrize("limit", [64, 3])
def test_kept_as_by_brute_force(spark, make_docs, monkeypatch, limit):
    """Copies at 0.8 to 1, in small buckets and beyond the limit; two bits link few of them."""
    monkeypatch.setattr(shingles, "DEALT", limit)
    texts = copies(random.Random(limit), 12, 6)
    bits = [simhash.fingerprint(t) & (1 << 64) - 1 for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if similar(texts[i], texts[j]) or (bits[i] ^ bits[j]).bit_count() <= 2]
    root = list(range(len(texts)))
    for _ in root:
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    want = sorted(set(root))
    assert sorted(r["doc_id"] for r in simhash.keep_one(make_docs(texts)).collect()) == want and len(want) < 15


def test_unlike_texts_with_one_id_stay(spark):
    rows = [(1, "a text of its own about one thing"), (1, "another that shares nothing but the number"), (1, "another that shares nothing but the number")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["text"] for r in kept.collect()) == sorted({t for _, t in rows})
