import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import packing
from strandloom.llm.queries import tokenizer_path
from strandloom.llm.wordbpe import WordBPE

WORDS = ["the", "Thntblere", "don't", "WE'LL", "été", "ñandú", "42", "a1b2", "...", "x" * 40, "aaaaaaaa", "日本語", "ΣΑΣ", "!?", "İx"]


@pytest.fixture(scope="module")
def bpe():
    return WordBPE(tokenizer_path())


def direct(bpe, text):
    return np.array(bpe.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(WORDS), st.text(max_size=12)), max_size=15), st.sampled_from([" ", "\n", "\x1c", " ", "<|endoftext|>"]))
def test_words_give_the_librarys_ids(parts, gap):
    bpe = test_words_give_the_librarys_ids.bpe
    text = gap.join(parts)
    assert bpe.ids([text]) == [direct(bpe, text)]


@pytest.fixture(autouse=True)
def _hand_over(bpe):
    test_words_give_the_librarys_ids.bpe = bpe


def test_cache_limit_changes_nothing(bpe, monkeypatch):
    from strandloom.llm import wordbpe

    monkeypatch.setattr(wordbpe, "KNOWN_PARTS", 3)
    texts = [" ".join(random.Random(k).choices(WORDS, k=9)) for k in range(20)]
    assert [bpe.ids([t])[0] for t in texts] == [direct(bpe, t) for t in texts]


def fullest_by_force(counts, capacity):
    first = max(n for n, c in counts.items() if c)
    sums = {first}
    for n, c in counts.items():
        for _ in range(c - (n == first)):
            sums |= {s + n for s in sums if s + n <= capacity}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), min_size=1, max_size=10))
def test_fullest_combination(counts):
    chosen = packing.fullest(counts, 40)
    assert all(c <= counts[n] for n, c in chosen.items())
    assert sum(n * c for n, c in chosen.items()) == fullest_by_force(counts, 40)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
def test_plan_equals_one_bin_at_a_time(counts):
    plan = packing.plan_bins(counts, 30)
    left, bins = dict(counts), 0
    while any(left.values()):
        for n, c in packing.fullest(left, 30).items():
            left[n] -= c
        bins += 1
    assert bins == max([0, *(b + t for _, _, t, _, b, _ in plan)])
    for n, c in counts.items():
        assert sum(t * k for m, _, t, k, _, _ in plan if m == n) == c


def check(rows, texts, bpe, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc, text in texts.items():
        ids = direct(bpe, text or "") + np.array([1], dtype="<u4").tobytes()
        mine = sorted(by[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(ids) // 4 // capacity)))
        for r in mine:
            part = ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
            assert r["start"] == r["piece"] * capacity and r["ids_crc32"] == zlib.crc32(part)
        assert sum(r["length"] for r in mine) == len(ids) // 4
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max([0, *at.values()]) <= capacity
    return len(at)


@pytest.mark.parametrize("group", [256, 2])
def test_pack(spark, make_docs, bpe, monkeypatch, group):
    monkeypatch.setattr(packing, "RANK_GROUP", group)
    rnd = random.Random(1)
    texts = [None, "", "same words here", "same words here", "<|endoftext|>"] + [" ".join(rnd.choices(WORDS, k=rnd.randrange(1, 60))) for _ in range(40)] + ["long " * 1000]
    docs = make_docs(texts).withColumn("row", F.lit("clash")).withColumn("length", F.lit(1))
    rows = packing.pack(docs, tokenizer_path(), 128).collect()
    bins = check(rows, dict(enumerate(texts)), bpe, 128)
    assert bins <= -(-sum(r["length"] for r in rows) // 128) + 1


def test_pack_nothing_and_null_ids(spark, make_docs):
    assert packing.pack(make_docs(["x"]).where("false"), tokenizer_path()).count() == 0
    rows = packing.pack(make_docs(["x y", "z"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, 2**60 + 1)), tokenizer_path()).collect()
    assert sorted([str(r["doc_id"]) for r in rows]) == [str(2**60 + 1), "None"]
