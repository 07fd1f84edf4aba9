"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of its terms (words, hashed to ``TERMS`` buckets), counts of its character-class trigrams and a few measures
of repetition; weighted by inverse document frequency and reduced together by a truncated singular value decomposition it is a short
vector. The labelled vectors, at most ``SAMPLE``, are broadcast; every text's cosine with every
labelled vector is computed, in blocks, and its ``NEIGHBOURS`` nearest, with all that are as near as the last of them, vote with their similarity as
weight. The score is the weighted share of label 1.

Labels are fitted on the rows that the caller hands over and no others. Null and empty texts have
no trigrams and no terms; they are all alike and are scored by their nearest labelled texts like any other. With
no labelled rows at all every score is 0.5. Rows without an id or a label teach nothing and are scored. Repeated rows are scored
alike, and a labelled text that is there twice votes twice, up to the sample's size. Very long texts are counted in parts.
Columns are read by the names given, so extra columns of any name don't matter; an empty table has no scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most labelled rows that are kept; chosen by a hash of their id.
SAMPLE = 4_000
NEIGHBOURS = 25
RANK = 48
BUCKETS = 1024
#: Texts whose products with all labelled vectors are in memory at a time.
BLOCK = 1024
#: Votes weigh as the similarity to this power, so that the nearest count most.
SHARPNESS = 4
EXTRA = 5
EXTRA_WEIGHT = 0.7
#: Buckets of terms, and how much all terms weigh beside all trigrams.
TERMS = 4096
TERM_WEIGHT = 0.2
WIDTH = BUCKETS + EXTRA + TERMS

_MARKS = b"\n.,!?#$%&*|-:;\"'"
CLASSES = np.zeros(256, dtype=np.int64)
for _b in range(256):
    _c = chr(_b)
    CLASSES[_b] = (
        4 + _MARKS.index(_b) if _b in _MARKS else 1 if _b >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 0
    )
KINDS = 4 + len(_MARKS)
SENTENCE = re.compile(r"[.!?\n]+\s*")
#: Characters that are counted at a time.
CHUNK = 4_000_000


def _repeated(parts: list[str]) -> float:
    return 1 - len(set(parts)) / len(parts) if parts else 0.0


LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
#: Weights of a word's bytes in its hash, by their place; a longer word's go round.
PLACES = np.random.default_rng(20160).integers(1, 2**32, 64, dtype=np.uint32) | np.uint32(1)


def _word_buckets(raw: bytes) -> np.ndarray:
    """The bucket of every run of letters, in order, hashed all at once: most words of a corpus come too seldom to be kept."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = LETTER[data]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(inside)
    word = np.searchsorted(starts, at, side="right") - 1
    first = np.searchsorted(at, starts)
    mixed = (data[at].astype(np.uint32) + np.uint32(1)) * PLACES[at - starts[word] & 63]
    mixed = np.add.reduceat((mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA6B), first)
    return ((mixed ^ mixed >> np.uint32(13)) % np.uint32(TERMS)).astype(np.int64)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of one text's terms: damped counts of length TERM_WEIGHT together."""
    raw, at, total = (text or "").lower().encode("utf-8", "replace"), 0, np.zeros(TERMS)
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        gaps = np.flatnonzero(~LETTER[np.frombuffer(raw, dtype=np.uint8, offset=at, count=end - at)]) if end < len(raw) else []
        end = at + int(gaps[-1]) + 1 if len(gaps) else end  # no word is cut, but for one longer than a part
        total += np.bincount(_word_buckets(raw[at:end]), minlength=TERMS)
        at = end
    held = np.flatnonzero(total)
    weight = 1 + np.log(total[held])
    norm = np.linalg.norm(weight)
    return held.astype(np.int32), (weight * (TERM_WEIGHT / norm) if norm else weight).astype(np.float32)


def measure(text: str | None) -> np.ndarray:
    """The unreduced vector of one text: what ``shape`` gives, then terms."""
    out = np.zeros(WIDTH, dtype=np.float32)
    out[: BUCKETS + EXTRA] = shape(text)
    at, weight = terms(text)
    out[BUCKETS + EXTRA + at] = weight
    return out


def shape(text: str | None) -> np.ndarray:
    """Root shares of trigram buckets, then measures of repetition."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(BUCKETS + EXTRA, dtype=np.float64)
    for at in range(0, max(0, len(raw) - 2), CHUNK):
        classes = CLASSES[np.frombuffer(raw, dtype=np.uint8, offset=at, count=min(CHUNK + 2, len(raw) - at))]
        codes = (classes[:-2] * KINDS + classes[1:-1]) * KINDS + classes[2:]
        out[:BUCKETS] += np.bincount(codes * 40503 % 65521 % BUCKETS, minlength=BUCKETS)
    if total := out.sum():
        out[:BUCKETS] = np.sqrt(out[:BUCKETS] / total)
    words = (text or "").split()
    if words:
        pairs = sum(map(str.__eq__, words, words[1:])) / len(words)
        upper = sum(map(str.isupper, words)) / len(words)
        scale = min(1.0, 200 / len(words))  # long texts repeat words anyway
        out[BUCKETS:] = [pairs, upper, _repeated(words) * scale, _repeated([s for s in SENTENCE.split(text) if s]), 1 / len(words)]
        out[BUCKETS:] *= EXTRA_WEIGHT
    return out


@dataclass
class Voter:
    """Feature weights, the projection, and the labelled unit vectors with their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, raw: np.ndarray) -> np.ndarray:
        made = (raw * self.weights) @ self.axes
        norm = np.linalg.norm(made, axis=1, keepdims=True)
        return (made / np.where(norm > 0, norm, 1)).astype(np.float32)

    def score(self, raw: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(raw), 0.5)
        mine, out = self.project(raw), np.empty(len(raw))
        k = min(neighbours, len(self.labels))
        for at in range(0, len(mine), BLOCK):
            cosine = mine[at : at + BLOCK] @ self.vectors.T
            last = np.partition(cosine, -k, axis=1)[:, -k, None]
            weight = np.where(cosine >= last, np.maximum(cosine, 1e-2), 0) ** SHARPNESS
            out[at : at + BLOCK] = weight @ self.labels / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def leading_axes(rows: np.ndarray, rank: int, rounds: int = 8) -> np.ndarray:
    """The first ``rank`` right singular vectors of ``rows``, as columns, by subspace iteration (Halko, Martinsson and Tropp, 2011)."""
    width = min(rank + 16, *rows.shape)
    basis = np.random.default_rng(20160).normal(size=(rows.shape[1], width)).astype(rows.dtype)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :rank]


def fit(raw: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Voter:
    """``raw``: ``measure`` of each labelled text; its rows are weighted in place."""
    n = len(raw)
    weights = np.ones(WIDTH, dtype=np.float32)
    if not n:
        return Voter(weights, np.eye(WIDTH, rank, dtype=np.float32), np.zeros((0, rank), np.float32), np.zeros(0))
    held = np.count_nonzero(raw, axis=0)
    weights[:] = np.log((1 + n) / (1 + held)) + 1
    weights[BUCKETS : BUCKETS + EXTRA] = 1
    raw *= weights
    axes = leading_axes(raw, rank)
    voter = Voter(np.ones(WIDTH, dtype=np.float32), axes, np.zeros((0, axes.shape[1]), np.float32), labels.astype(np.float64))
    voter.vectors, voter.weights = voter.project(raw), weights
    return voter


_MEASURED = T.StructType([T.StructField("shape", T.ArrayType(T.FloatType())), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("weight", T.ArrayType(T.FloatType()))])


@F.pandas_udf(_MEASURED)
def _measure_column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([(shape(t).astype(np.float32), *terms(t)) for t in texts], columns=["shape", "at", "weight"])


def train(docs: DataFrame, labels: DataFrame, label_column: str, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> Voter:
    """Fits on at most ``sample`` of the rows of ``labels``."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("double").alias("y")).dropna()
    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = (
        texts.join(F.broadcast(picked), "id")
        .select("id", "y", _measure_column("text").alias("raw"))
        .select("id", "y", "raw.*")
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
        .toArrow()
    )
    raw = np.zeros((rows.num_rows, WIDTH), dtype=np.float32)
    for k, (own, at, weight) in enumerate(zip(*(rows.column(c) for c in ("shape", "at", "weight")))):
        raw[k, : BUCKETS + EXTRA] = own.values.to_numpy()
        raw[k, BUCKETS + EXTRA + at.values.to_numpy()] = weight.values.to_numpy()
    return fit(raw, rows.column("y").to_numpy())


def score_udf(voter: Voter, neighbours: int = NEIGHBOURS):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = []
            for at in range(0, len(texts), BLOCK):
                parts.append(voter.score(np.stack([measure(t) for t in texts.iloc[at : at + BLOCK]]), neighbours))
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score
