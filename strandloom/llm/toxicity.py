"""Toxicity by a classifier chain.

The chain predicts one category after the other with linear models; each model after the first
also sees the probabilities of the categories before it. In training these are out-of-fold
predictions: a row's earlier probabilities come from models that were fitted without its fold, on features that
were chosen and categories that were derived without it too.

Categories are 0/1 columns of the labelled rows, in chain order; the last is the verdict. Where the
labels have one ``toxic`` column only, ``derived_categories`` makes two earlier ones from it: toxic
rows with several different strong terms (``varied``), and those in which they are a large share of
all words (``dense``); strong terms are those that the labels themselves tell apart.

Features are words and their beginnings of 3 to 6 letters, hashed, once more where they are frequent; the fit keeps the
``MOST_FEATURES`` that depend most on the verdict. Languages, sources and ids are never features.

Labelled rows are fitted on a sample of at most ``SAMPLE`` rows, chosen by a hash of the id; their
features are counted and chosen on the cluster, and the driver gets the chosen ones of each row, however
long its text. Every text is scored, whole. Null and empty texts have no features and get the model's
probability for that. Without both classes among the labelled rows every score is their mean.

Null ids and labels teach nothing; a row without an id is scored like any other. Repeated rows are scored each, and each
of a labelled text's rows counts in the fit, up to the sample's size. Features of one chi-square are taken by their number, lower ones first, and a
score at the threshold is toxic. Result columns have free names, so extra columns of any name come back as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, give_back, release

SAMPLE = 10_000
MOST_FEATURES = 4_000
FOLDS = 5
DIMENSIONS = 1 << 22
BEGINNINGS = (3, 4, 5, 6)
#: A feature counts anew when it is there so many times.
LEVELS = (1, 2, 4)
THRESHOLD = 0.5
#: A feature counts if at least so many sampled rows have it.
LEAST_ROWS = 3
#: Least chi-square of a feature (chance alone exceeds it once in a hundred times), and most features of derived categories.
LEAST_CHI = 6.6
MOST_STRONG = 400
WORDS = re.compile(r"[^\W\d_]+").findall
#: Distinct words whose features a worker keeps.
KNOWN_WORDS = 300_000


def word_features(word: str) -> list[int]:
    made = [zlib.crc32(f"{word}$".encode())] + [zlib.crc32(word[:n].encode()) for n in BEGINNINGS if len(word) >= n]
    return [h % DIMENSIONS for h in made]


def often(feature: int, level: int) -> int:
    """The number that stands for a feature found at least LEVELS[level] times."""
    return feature if not level else (feature * 0x9E3779B1 + level * 0x85EBCA77) % DIMENSIONS


def leveled(counts: Counter) -> set[int]:
    return {often(f, k) for f, n in counts.items() for k, least in enumerate(LEVELS) if n >= least}


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of one text."""
    counts: Counter = Counter()
    for word, n in Counter(WORDS((text or "").lower())).items():
        for f in word_features(word):
            counts[f] += n
    return np.array(sorted(leveled(counts)), dtype=np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Sparse 0/1 rows: row and column of each entry; and the number of rows and columns."""

    row: np.ndarray
    column: np.ndarray
    shape: tuple[int, int]

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.shape[0])

    def transposed_times(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, values[self.row], self.shape[1])

    def take(self, keep: np.ndarray) -> Rows:
        number = np.cumsum(keep) - 1
        mine = keep[self.row]
        return Rows(number[self.row[mine]], self.column[mine], (int(keep.sum()), self.shape[1]))


@dataclass
class Linear:
    """A logistic model of sparse 0/1 features and a few dense ones."""

    sparse: np.ndarray
    dense: np.ndarray
    bias: float

    def predict(self, rows: Rows, dense: np.ndarray) -> np.ndarray:
        return sigmoid(rows.times(self.sparse) + dense @ self.dense + self.bias)


def fit_linear(rows: Rows, dense: np.ndarray, y: np.ndarray, steps: int = 250, decay: float = 0.0005) -> Linear:
    """Weighted logistic regression by Adam on all rows; both classes weigh the same."""
    n = len(y)
    if n == 0 or y.min() == y.max():
        mean = float(np.clip(y.mean() if n else 0.0, 0.01, 0.99))
        return Linear(np.zeros(rows.shape[1]), np.zeros(dense.shape[1]), float(np.log(mean / (1 - mean))))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    theta = np.zeros(rows.shape[1] + dense.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        error = weight * (sigmoid(rows.times(theta[: rows.shape[1]]) + dense @ theta[rows.shape[1] : -1] + theta[-1]) - y)
        grad = np.concatenate([rows.transposed_times(error), dense.T @ error, [error.sum()]]) / n
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Linear(theta[: rows.shape[1]], theta[rows.shape[1] : -1], float(theta[-1]))


@dataclass
class Chain:
    """Linear models in chain order over the chosen features."""

    chosen: np.ndarray
    models: list[Linear] = field(default_factory=list)

    def rows(self, texts: list[np.ndarray]) -> Rows:
        column = [np.array([], dtype=np.int64)]
        for found in texts:
            at = np.searchsorted(self.chosen, found)
            at = at[(at < len(self.chosen))]
            hit = at[np.isin(self.chosen[at], found)] if len(at) else at
            column.append(np.unique(hit))
        row = np.repeat(np.arange(len(texts)), [len(c) for c in column[1:]])
        return Rows(row, np.concatenate(column), (len(texts), len(self.chosen)))

    def predict(self, rows: Rows) -> np.ndarray:
        """A column of probabilities for each category."""
        earlier = np.zeros((rows.shape[0], 0))
        for model in self.models:
            earlier = np.column_stack([earlier, model.predict(rows, earlier)])
        return earlier


def chi_square(held: Column, toxic: Column, rows: float, positive: float) -> Column:
    """How much a feature, held by ``held`` rows of which ``toxic`` are positive, depends on the label."""
    a, b = toxic, held - toxic
    pos, neg = F.lit(float(positive)), F.lit(float(rows - positive))
    below = pos * neg * held * (F.lit(float(rows)) - held)
    return F.when(below > 0, F.lit(float(rows)) * F.pow(a * (neg - b) - b * (pos - a), 2) / below).otherwise(0.0)


def count_features(rows: DataFrame) -> DataFrame:
    """(feature, held, toxic, and both for every fold) of ``rows`` (f, y, fold), counted on the cluster."""
    each = rows.select("y", "fold", F.explode("f").alias("feature"))
    own = [F.col("fold") == k for k in range(FOLDS)]
    sums = [s for k in range(FOLDS) for s in (F.count_if(own[k]).cast("double").alias(f"held_{k}"), F.coalesce(F.sum(F.when(own[k], F.col("y"))), F.lit(0.0)).alias(f"toxic_{k}"))]
    return each.groupBy("feature").agg(F.count("*").cast("double").alias("held"), F.sum("y").alias("toxic"), *sums)


def choose_features(counts: DataFrame, n: float, positive: float, without: int | None = None, most: int = MOST_FEATURES) -> list[tuple[int, bool]]:
    """(feature, whether it tells positives) of at most ``most`` features, most dependent first.

    ``counts``: of ``count_features``; ``without``: a fold whose rows don't count; ``n`` and ``positive``: of the rows that do.
    The driver gets the chosen ones only.
    """
    held, toxic = F.col("held"), F.col("toxic")
    if without is not None:
        held, toxic = held - F.col(f"held_{without}"), toxic - F.col(f"toxic_{without}")
    left = counts.select("feature", held.alias("held"), toxic.alias("toxic")).where(F.col("held") >= LEAST_ROWS)
    scored = left.withColumn("chi", chi_square(F.col("held"), F.col("toxic"), n, positive))
    top = scored.where(F.col("chi") > LEAST_CHI).orderBy(F.desc("chi"), "feature").limit(most).collect()
    return [(r["feature"], r["toxic"] * (n - positive) > (r["held"] - r["toxic"]) * positive) for r in top]


def derived_categories(texts: list[np.ndarray], sizes: np.ndarray, y: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Columns varied, dense, toxic, from the toxic column and the features that tell it (``strong``)."""
    hits = np.array([np.isin(t, strong).sum() for t in texts], dtype=float)
    share, toxic = hits / np.maximum(1, sizes), y == 1
    some = toxic & (hits > 0)
    middle, level = (np.median(x[some]) if some.any() else 1.0 for x in (hits, share))
    return np.column_stack([toxic & (hits > middle), some & (share > level), toxic]).astype(float)


def out_of_fold(texts: list[np.ndarray], earlier: np.ndarray, folds: np.ndarray, k: int, by_fold: dict) -> np.ndarray:
    """Probabilities of category ``k``: each row's by a model of the other folds, on their features and categories."""
    held = np.zeros(len(texts))
    for fold, (chosen, categories) in by_fold.items():
        out = folds == fold
        if not out.any():
            continue
        own = lambda keep: Chain(chosen).rows([texts[at] for at in np.flatnonzero(keep)])
        model = fit_linear(own(~out), earlier[~out], categories[:, k], steps=120)
        held[out] = model.predict(own(out), earlier[out])
    return held


def fit_chain(chosen: np.ndarray, texts: list[np.ndarray], categories: np.ndarray, folds: np.ndarray, by_fold: dict | None = None) -> Chain:
    """``categories``: a 0/1 column each, in chain order; ``folds``: the fold of each row; ``chosen``: features, ascending.

    ``by_fold``: of each fold, the features and the categories as the other folds' rows alone give them.
    """
    by_fold = {f: (chosen, categories[folds != f]) for f in np.unique(folds)} if by_fold is None else by_fold
    chain = Chain(chosen)
    rows = chain.rows(texts)
    earlier = np.zeros((len(texts), 0))
    for k in range(categories.shape[1]):
        chain.models.append(fit_linear(rows, earlier, categories[:, k]))
        if k + 1 < categories.shape[1]:
            earlier = np.column_stack([earlier, out_of_fold(texts, earlier, folds, k, by_fold)])
    return chain


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _feature_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([features(t) for t in texts])


def train(docs: DataFrame, labels: DataFrame, label_columns: list[str], id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE) -> Chain:
    """Fits the chain on at most ``sample`` labelled rows; one label column gets derived categories before it."""
    names = [f"y{k}" for k in range(len(label_columns))]
    known = labels.select(F.col(id_column).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(label_columns, names)]).dropna()
    picked = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    fold = (F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS).cast("int").alias("fold")
    rows = cut(texts.join(F.broadcast(picked), "id").select("id", *names, fold, _feature_column("text").alias("f")))
    verdict = F.col(names[-1])
    counts = cut(count_features(rows.select("f", "fold", verdict.alias("y"))))
    totals = {r["fold"]: (r["n"], r["p"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(verdict).alias("p")).collect()}
    n, positive = (sum(t[k] for t in totals.values()) for k in (0, 1))
    top = {None: choose_features(counts, n, positive)}
    for k, (held, toxic) in totals.items():
        top[k] = choose_features(counts, n - held, positive - toxic, k)
    chosen = {k: np.array(sorted(f for f, _ in t), dtype=np.int32) for k, t in top.items()}
    every = np.unique(np.concatenate(list(chosen.values())))
    wanted = F.array(*map(F.lit, every.tolist())) if len(every) else F.array().cast("array<int>")
    first = rows.select("id", *names, "fold", F.size("f").alias("size"), F.array_intersect("f", wanted).alias("f")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # As columns: a Python number for each feature of each row would take several times the memory.
    found = first.select(*names, "fold", "size", "f").toArrow()
    held = [part.values.to_numpy()[lo:hi] for part in found["f"].chunks for lo, hi in zip(part.offsets.to_pylist(), part.offsets.to_pylist()[1:])]
    sizes, folds = found["size"].to_numpy(), found["fold"].to_numpy().astype(int)
    y = np.column_stack([found[n].to_numpy() for n in names])

    def categories(fold: int | None) -> np.ndarray:
        """Of the rows outside ``fold``, as they alone give them."""
        own = np.flatnonzero(folds != fold) if fold is not None else np.arange(len(found))
        if len(names) > 1:
            return y[own]
        strong = np.array([f for f, positive in top[fold] if positive][:MOST_STRONG], dtype=np.int32)
        return derived_categories([held[k] for k in own], sizes[own], y[own, 0], strong)

    by_fold = {fold: (chosen[fold], categories(fold)) for fold in totals}
    release(rows, counts)
    chain = fit_chain(chosen[None], held, categories(None), folds, by_fold)
    give_back()
    return chain


def score_udf(chain: Chain):
    """text -> probabilities in chain order."""
    chosen = chain.chosen.tolist()

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number = {f: k for k, f in enumerate(chosen)}
        known: dict[str, tuple[int, ...]] = {}

        def useful(word: str) -> tuple[int, ...]:
            return tuple(f for f in word_features(word) if any(often(f, k) in number for k in range(len(LEVELS))))

        for texts in batches:
            row, column = [], []
            for k, text in enumerate(texts):
                counts: Counter = Counter()
                for word, n in Counter(WORDS((text or "").lower())).items():
                    mine = known.get(word)
                    if mine is None:
                        mine = known[word] = useful(word)
                    for f in mine:
                        counts[f] += n
                found = sorted(number[f] for f in leveled(counts) if f in number)
                row += [k] * len(found)
                column += found
                if len(known) > KNOWN_WORDS:
                    known.clear()
            rows = Rows(np.array(row, dtype=np.int64), np.array(column, dtype=np.int64), (len(texts), len(chosen)))
            yield pd.Series(list(chain.predict(rows)))
        known.clear()
        give_back()

    return score


def classify(docs: DataFrame, chain: Chain, text_column: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (probabilities, toxic), and that column's name."""
    name, scores = free_name(docs, "toxicity"), free_name(docs, "scores")
    scored = docs.withColumn(scores, score_udf(chain)(F.col(text_column).cast("string")))
    verdict = F.element_at(scores, -1)
    made = F.struct(F.col(scores).alias("probabilities"), (verdict >= threshold).alias("toxic"))
    return scored.withColumn(name, made).drop(scores), name
