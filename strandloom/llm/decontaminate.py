"""Benchmark decontamination under edit distance.

Texts and benchmark items are words (letters and digits, lower case). A text is contaminated by an
item if one of its windows is within ``EDIT_SHARE`` of the item's words in edit distance (word by
word: insertions, deletions, replacements).

Candidates: the CGK embedding (Chakraborty, Goldenberg and Koucky, 2016) walks over a window and
emits a word a step, moving on or staying by a random bit of (step, word); windows at a small edit
distance get embeddings at a small Hamming distance. A walk that has met many edits is lost for good, so an
item-sized window is embedded block by block: a new walk begins about every ``BLOCK_STEPS / 2`` words, which is what
``BLOCK_STEPS`` steps read, so that the walks together read the whole item whatever its size, and edits anywhere
leave some of them alone. A text is walked from every word, so blocks needn't be aligned.
Per walk, repeated samples of ``BITS`` steps are hashed; a text's walk and an item's that agree on one
sample make a candidate. Walks depend only on where they start, so items of all sizes of one class
share them: samples of a class are taken from the steps that its smallest item fills. The number of
samples follows from ``RECALL``, as measured on copies of the items themselves with the most edits
allowed: it is reached with the edits spread, and crowded at the head, the middle and the tail. Where ``MOST_SAMPLES``
samples don't reach it, the class gets an exact way beside them: k edits leave one of k + 1 parts of
an item whole, so a run of that many equal words makes a candidate too and none is missed.

Before walking, positions are passed over where no item can match for certain: of any window within
distance k of an item at most k words are in no item at all, so a place counts if such a window holds it.

Verification: the exact distance of the item to the best part of the text around the candidate.

The items are a stated query set: they are read in blocks of at most ``BLOCK_ITEMS``, and each
block's table goes to all texts, so nothing that is broadcast grows beyond a block; with several blocks each one's matches
are written before the next is sent. Null and empty texts and items match nothing, null ids are kept. Items of fewer than
``LEAST_WORDS`` words are compared exactly (distance 0). Repeated rows give repeated result rows; of several places of an item
in a text the first at the least distance is given. Very long texts are handled in parts of ``CHUNK`` words' walks. Columns are read
by the names given, and results have names of their own, so extra columns of any name are passed over. Empty tables give
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, free_name, release

EDIT_SHARE = 0.2
RECALL = 0.97
BITS = 4
LEAST_WORDS = 5
BLOCK_ITEMS = 5_000
#: Independent walks; each serves many samples.
WALKS = 12
#: Steps of the walk over one block of an item.
BLOCK_STEPS = 24
#: Places of an item that walks start from, at least where it has as many words.
ANCHORS = 12
#: Where a measured copy's edits are: anywhere, or in a run that begins at this share of what is before its last place.
CROWDS = (None, 0.0, 0.5, 1.0)
MOST_SAMPLES = 64
#: Edited copies on which the number of samples is measured.
TRIALS = 200
FILTER_BITS = 16
#: Class sizes grow by this factor.
CLASS_GROWTH = 1.3
#: ASCII characters that separate words; all others belong to them.
BREAKS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
#: Words that are compared at a time, and survivors of the first pass that walk at a time.
CHUNK = 400_000
SEED = 20160
#: Stand for words of no item, and for the end of a text, where every walk stays.
STRANGE, END = -1, -2
#: The walk that moves on at every step.
STRAIGHT = WALKS


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(BREAKS).split()


def allowed(size: int, share: float = EDIT_SHARE) -> int:
    return 0 if size < LEAST_WORDS else math.floor(share * size)


def walk_bits(vocabulary: int, step: int, walk: int) -> np.ndarray:
    """The random bit of each word number, from END on, in one step of one walk."""
    numbers = np.arange(END, vocabulary).astype(np.uint64)
    mixed = (numbers + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((step * 1_000_003 + walk * 7_919 + SEED) * 0xD6E8FEB86659FD93 & 2**64 - 1)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    bits = (mixed >> np.uint64(63)).astype(np.int32)
    bits[0] = 0
    return bits


def emitted(ids: np.ndarray, starts: np.ndarray, samples: list, bits: dict[int, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """By (walk, step): the word numbers that the walks from ``starts`` emit, for the steps that samples need.

    ``ids`` ends in END.
    """
    wanted: dict[int, set[int]] = {}
    for walk, steps in samples:
        wanted.setdefault(walk, set()).update(map(int, steps))
    out = {}
    for walk, steps in wanted.items():
        at, table = starts.astype(np.int32), bits[walk]
        for step in range(max(steps) + 1):
            now = ids[at]
            if step in steps:
                out[walk, step] = now
            at = at + table[step][now + 2]
    return out


def best_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(distance, end) of the part of ``text`` nearest to ``item`` (Sellers, 1980)."""
    above = np.arange(len(item) + 1)
    best, end = int(above[-1]), 0
    column = np.arange(len(item) + 1)
    for j, word in enumerate(text):
        base = np.minimum(above[:-1] + (item != word), above[1:] + 1)
        now = np.minimum.accumulate(np.concatenate([[0], base]) - column) + column
        if now[-1] < best:
            best, end = int(now[-1]), j + 1
        above = now
    return best, end


@dataclass
class SizeClass:
    """Items of about one size, with the samples of their walks and each sample's table of keys."""

    size: int
    largest: int
    known: np.ndarray
    samples: list[tuple[int, np.ndarray]]
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by sample: keys in order, and each one's item and anchor
    filters: list[np.ndarray]


@dataclass
class Items:
    """A block of items, ready for texts to be compared with."""

    ids: list
    words: dict[bytes, int]
    items: list[np.ndarray]
    share: float
    bits: dict[int, np.ndarray]
    classes: list[SizeClass]
    exact: dict[int, dict[tuple, list[int]]]


def anchors(size: int) -> range:
    """Where an item's walks begin: no word lies between one walk's reach and the next walk."""
    return range(0, size, max(1, min(size // ANCHORS, BLOCK_STEPS // 2)))


def whole_part(size: int, share: float) -> int:
    """Words of an item's parts, one of which any allowed edits leave whole."""
    return size // (allowed(size, share) + 1)


def _edited(item: np.ndarray, edits: int, random: np.random.Generator, vocabulary: int, crowd: float | None) -> np.ndarray:
    out = item.tolist()
    for _ in range(edits):
        at, kind = int(random.integers(0, max(1, len(out)))), int(random.integers(0, 3))
        if crowd is not None:
            at = min(len(out) - 1, int(crowd * (len(item) - edits)) + int(random.integers(0, edits)))
        if kind == 0 and len(out) > 1:
            del out[at]
        elif kind == 1:
            out.insert(at, int(random.integers(0, vocabulary)))
        else:
            out[at] = int(random.integers(0, vocabulary))
    return np.array(out, dtype=np.int32)


def _keys(made: dict[tuple[int, int], np.ndarray], sample: tuple[int, np.ndarray]) -> np.ndarray:
    walk, steps = sample
    key = np.zeros(len(made[walk, int(steps[0])]), dtype=np.uint64)
    for step in steps:
        key = (key ^ (made[walk, int(step)] + 3).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _walked(parts: list[np.ndarray], starts: list[range], samples: list, bits: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(part, start in it, keys by sample) of the walks from ``starts`` of each of ``parts``, which are kept apart by END."""
    ids = np.concatenate([x for part in parts for x in (part, [END])]).astype(np.int32)
    first = np.cumsum([0, *(len(part) + 1 for part in parts[:-1])])
    part = np.repeat(np.arange(len(parts)), [len(s) for s in starts])
    start = np.concatenate([np.array(s, dtype=np.int64) for s in starts])
    made = emitted(ids, first[part] + start, samples, bits)
    return part, start, [_keys(made, sample) for sample in samples]


def choose_samples(items: list[np.ndarray], bits: dict, vocabulary: int, share: float, recall: float, width: int) -> tuple[list[tuple[int, np.ndarray]], bool]:
    """As many samples as reach ``recall`` on copies of ``items`` with the most edits allowed, wherever they crowd; and whether they do."""
    random = np.random.default_rng(SEED)
    steps = max(width, min(BLOCK_STEPS, *map(len, items), len(items[0])))  # a walk of n steps reads about n / 2 words
    pool = [(k % WALKS, np.sort(random.choice(steps, width, replace=False))) for k in range(MOST_SAMPLES)]
    reached = np.ones(len(pool))
    for crowd in CROWDS:
        chosen = [items[int(k)] for k in random.integers(0, len(items), TRIALS)]
        copies = [_edited(item, allowed(len(item), share), random, vocabulary, crowd) for item in chosen]
        around = np.full(steps, STRANGE, dtype=np.int32)  # a copy in a text has words behind it
        mine, _, own = _walked(chosen, [anchors(len(item)) for item in chosen], pool, bits)
        theirs, _, other = _walked([np.append(c, around) for c in copies], [range(len(c)) for c in copies], pool, bits)
        hit = np.zeros((TRIALS, len(pool)), dtype=bool)
        for n in range(len(pool)):
            apart = np.uint64(0xD6E8FEB86659FD93)
            same = np.isin(other[n] ^ theirs.astype(np.uint64) * apart, own[n] ^ mine.astype(np.uint64) * apart)
            hit[theirs[same], n] = True
        reached = np.minimum(reached, np.maximum.accumulate(hit, axis=1).mean(axis=0))
    enough = np.flatnonzero(reached[: len(pool) // 2] >= recall)
    # What is measured is one draw of copies: twice the samples keep chance from deciding.
    return pool[: 2 * int(enough[0]) + 2 if len(enough) else len(pool)], bool(len(enough))


def _tables(made: list[np.ndarray], number: np.ndarray, start: np.ndarray) -> tuple[list, list]:
    """By sample: (keys in order, each one's item and place in it), and which low bits of a key there are."""
    tables, filters = [], []
    for keys in made:
        order = np.argsort(keys, kind="stable")
        tables.append((keys[order], number[order].astype(np.int32), start[order].astype(np.int32)))
        passed = np.zeros(1 << FILTER_BITS, dtype=bool)
        passed[(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        filters.append(passed)
    return tables, filters


def prepare(rows: list[tuple], share: float = EDIT_SHARE, recall: float = RECALL, width: int = BITS) -> Items:
    """``rows``: (item id, text)."""
    listed = sorted(((i, w) for i, t in rows if (w := words_of(t))), key=lambda x: (len(x[1]), str(x[0])))
    words: dict[bytes, int] = {}
    items = [np.array([words.setdefault(w, len(words)) for w in ws], dtype=np.int32) for _, ws in listed]
    longest = max([LEAST_WORDS, *map(len, items)])
    bits = {w: np.stack([walk_bits(len(words), step, w) for step in range(min(longest, BLOCK_STEPS))]) for w in range(WALKS)}
    known = Items([i for i, _ in listed], words, items, share, bits, [], {})
    k = 0
    while k < len(items):
        size = len(items[k])
        if size < LEAST_WORDS:
            known.exact.setdefault(size, {}).setdefault(tuple(items[k].tolist()), []).append(k)
            k += 1
            continue
        last = k
        while last < len(items) and len(items[last]) <= size * CLASS_GROWTH:
            last += 1
        block = items[k:last]
        samples, reached = choose_samples(block, bits, len(words), share, recall, width)
        inside = np.zeros(len(words) + 2, dtype=bool)
        inside[np.concatenate(block)] = True
        number, start, made = _walked(block, [anchors(len(item)) for item in block], samples, bits)
        tables, filters = _tables(made, number + k, start)
        if not reached:
            size_ = min(whole_part(len(item), share) for item in block)
            straight = np.ones((size_, len(words) + 2), dtype=np.int32)
            straight[:, 0] = 0
            bits[STRAIGHT] = straight if len(bits.get(STRAIGHT, ())) < size_ else bits[STRAIGHT]
            samples = [*samples, (STRAIGHT, np.arange(size_))]
            number, start, made = _walked(block, [range(len(item) - size_ + 1) for item in block], samples[-1:], bits)
            more = _tables(made, number + k, start)
            tables, filters = tables + more[0], filters + more[1]
        known.classes.append(SizeClass(size, len(items[last - 1]), inside, samples, tables, filters))
        k = last
    return known


def _numbered(texts: list[str | None], words: dict[bytes, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts: (first, last, word numbers with END after each text, where each text starts and the end)."""
    get, first, ids, starts = words.get, 0, [], [0]
    for k, text in enumerate(texts):
        ids += [get(w, STRANGE) for w in words_of(text)]
        ids.append(END)
        starts.append(len(ids))
        if len(ids) >= CHUNK or k + 1 == len(texts):
            yield first, k + 1, np.array(ids, dtype=np.int32), np.array(starts)
            first, ids, starts = k + 1, [], [0]


def matches(texts: list[str | None], known: Items) -> list[tuple[int, int, int, int]]:
    """(text's place, item number, first word's place, distance) of every item that a text holds, at its least distance."""
    out: list[tuple[int, int, int, int]] = []
    for first, _, ids, bounds in _numbered(texts, known.words):
        places: dict[int, list[np.ndarray]] = {}
        for c in known.classes:
            least = c.size - allowed(c.size, known.share)
            if len(ids) <= least:
                continue
            cost = np.where(c.known[ids], 0, 1)
            cost[ids == END] = len(ids)
            spent = np.concatenate([[0], np.cumsum(cost)])
            good = np.flatnonzero((spent[least:] - spent[:-least]) <= allowed(c.largest, known.share))
            held = np.zeros(len(ids) + 1, dtype=np.int32)
            held[good] += 1
            held[good + least] -= 1
            starts = np.flatnonzero(np.cumsum(held[:-1]))
            for at in range(0, len(starts), CHUNK):
                part = starts[at : at + CHUNK]
                made = emitted(ids, part, c.samples, known.bits)
                for sample, (listed, number, anchor), passed in zip(c.samples, c.tables, c.filters):
                    keys = _keys(made, sample)
                    hit = np.flatnonzero(passed[(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
                    low, high = (np.searchsorted(listed, keys[hit], side=side) for side in ("left", "right"))
                    where = np.repeat(part[hit], high - low)
                    entry = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(len(where))
                    own = bounds[np.searchsorted(bounds, where, side="right") - 1]
                    begun = np.maximum(where - anchor[entry], own)
                    order = np.argsort(number[entry], kind="stable")
                    ns, cuts = np.unique(number[entry][order], return_index=True)
                    for n, group in zip(ns.tolist(), np.split(begun[order], cuts[1:])):
                        places.setdefault(n, []).append(group)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for n, at in places.items():
            _verify(ids, bounds, known, n, np.unique(np.concatenate(at)), found)
        for size, table in known.exact.items():
            for start in range(len(ids) - size):
                for n in table.get(tuple(ids[start : start + size].tolist()), ()):
                    doc = int(np.searchsorted(bounds, start, side="right")) - 1
                    found.setdefault((doc, n), (0, start))
        out += [(first + doc, n, place - int(bounds[doc]), distance) for (doc, n), (distance, place) in sorted(found.items())]
    return out


def _verify(ids: np.ndarray, bounds: np.ndarray, known: Items, n: int, places: np.ndarray, found: dict) -> None:
    """Places whose surroundings overlap are compared once, together; only where enough of the item's words are."""
    item = known.items[n]
    most, inside = allowed(len(item), known.share), np.zeros(len(known.words) + 2, dtype=bool)
    inside[item] = True
    docs = np.searchsorted(bounds, places, side="right") - 1
    low = np.maximum(bounds[docs], places - most)
    high = np.minimum(bounds[docs + 1] - 1, places + len(item) + most)
    k = 0
    while k < len(places):
        a, b, doc = int(low[k]), int(high[k]), int(docs[k])
        while k < len(places) and docs[k] == doc and low[k] <= b:
            b = int(high[k])
            k += 1
        if np.count_nonzero(inside[ids[a:b]]) < len(item) - most:
            continue
        if not found.get((doc, n), (1, 0))[0]:
            continue
        distance, end = best_distance(item, ids[a:b])
        if distance <= most and distance < found.get((doc, n), (most + 1, 0))[0]:
            found[doc, n] = (distance, max(int(bounds[doc]), a + end - len(item)))


def _item_blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[tuple[list[tuple], bool]]:
    """The benchmark's rows in blocks of at most about BLOCK_ITEMS, by a hash of the id; and whether there is one block only."""
    items = benchmark.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    for b in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()], blocks == 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE, recall: float = RECALL) -> DataFrame:
    """(id column, item_id, place, distance) for every document and every item that it holds."""
    kind, item_kind = docs.schema[id_column].dataType, benchmark.schema[item_id].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("item", item_kind), T.StructField("place", T.LongType()), T.StructField("distance", T.IntegerType())])
    texts = docs.select(F.col(id_column).alias("doc"), F.col(text_column).cast("string").alias("text")).where("text is not null")
    arrow_item = to_arrow_type(item_kind)

    def part(known) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = matches(batch.column(1).to_pylist(), known.value)
                at = [k for k, _, _, _ in found]
                rows = [(known.value.ids[n], place, distance) for _, n, place, distance in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array([r[0] for r in rows], arrow_item),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int32()),
                    ],
                    names=["doc", "item", "place", "distance"],
                )

        return texts.mapInArrow(run, schema)

    parts = []
    for rows, alone in _item_blocks(benchmark, item_id, item_text):
        known = docs.sparkSession.sparkContext.broadcast(prepare(rows, share, recall))
        parts.append(part(known) if alone else cut(part(known)))
        if not alone:
            known.destroy()
    out = reduce(DataFrame.union, parts)
    return out.select(F.col("doc").alias(id_column), F.col("item").alias("item_id"), "place", "distance")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns, texts unchanged.

    Rows are judged where they are, and nothing is shuffled where the items are one block. With several, the
    digests of the texts that hold one are written, and rows leave by them. Rows without a text stay.
    """
    flag, text = free_name(docs, "leak"), F.col(text_column).cast("string")
    parts = []
    for rows, alone in _item_blocks(benchmark, item_id, item_text):
        known = docs.sparkSession.sparkContext.broadcast(prepare(rows))
        if alone:
            return docs.withColumn(flag, _leak_udf(known)(text)).where(~F.col(flag)).drop(flag)
        parts.append(cut(docs.select(F.md5(text).alias(flag), _leak_udf(known)(text).alias("held")).where("held").select(flag).distinct()))
        known.destroy()
    leaked = cut(reduce(DataFrame.union, parts).distinct())
    release(*parts)
    return docs.withColumn(flag, F.md5(text)).join(leaked, flag, "left_anti").select(*docs.columns)


def _leak_udf(known):
    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            held = np.zeros(len(texts), dtype=bool)
            held[[k for k, _, _, _ in matches(list(texts), known.value)]] = True
            yield pd.Series(held)

    return leaks
