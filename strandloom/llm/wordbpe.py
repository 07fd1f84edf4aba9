"""Ids of a word-level BPE tokenizer file, in blocks of distinct words.

Covers files whose normaliser lower-cases (after NFC, with runs of white space as one space), whose
split pattern drops white space, and whose BPE marks word ends: there a text's ids are those of its
white-space separated parts one after the other, and each part's are those of its matches. What the
vectorised path doesn't surely treat alike (characters above U+017F, long words, added tokens'
strings, control separators) is encoded by the library itself; so is everything with other files.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Parts of a text whose ids a worker keeps; beyond that it starts anew.
KNOWN_PARTS = 700_000
#: Words of more bytes than this are encoded by the library.
LONGEST = 32
#: Characters up to here have one lower case and no composition.
PLAIN = re.compile("[^\x00-ſ]|[İŉ]")
CONTROL = re.compile("[\x1c-\x1f]")
NONE = np.int32(2**31 - 1)


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    stand_in = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [stand_in[b] for b in range(256)]


class WordBPE:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            self.plain = self._load(json.load(f))

    def _load(self, file: dict) -> bool:
        """Whether the file is of the kind that this class covers; then with its tables."""
        try:
            steps = [n["type"] for n in file["normalizer"]["normalizers"]]
            split, level = file["pre_tokenizer"]["pretokenizers"]
            model = file["model"]
            if (
                steps != ["NFC", "Replace", "Lowercase"]
                or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True)
                or (level["type"], level["add_prefix_space"], level["use_regex"]) != ("ByteLevel", False, False)
                or model["type"] != "BPE"
                or model["dropout"]
                or model["ignore_merges"]
                or model["continuing_subword_prefix"]
                or file["post_processor"]
            ):
                return False
            self.split = regex.compile(split["pattern"]["Regex"] + r"|\n").findall
            vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            letters = _byte_alphabet()
            self.first = np.array([vocab[c] for c in letters], dtype=np.int32)
            self.last = np.array([vocab[c + end] for c in letters], dtype=np.int32)
            self.base = 1 + max(vocab.values())
            keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], dtype=np.int64)
            self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        except (KeyError, TypeError, ValueError):
            return False
        self._table(keys)
        return True

    def _table(self, keys: np.ndarray) -> None:
        """Open addressing by key, 16 slots a key: nearly every probe ends at its first slot."""
        size = 1 << int(16 * len(keys)).bit_length()
        self.mask = np.int64(size - 1)
        self.slot_key = np.full(size, -1, dtype=np.int64)
        self.slot_rank = np.full(size, NONE, dtype=np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at] == -1
            put, first = np.unique(at[free], return_index=True)
            rows = np.flatnonzero(free)[first]
            self.slot_key[put], self.slot_rank[put] = keys[left[rows]], left[rows]
            stay = np.ones(len(left), dtype=bool)
            stay[rows] = False
            left, at = left[stay], at[stay] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.int64(0x2545F4914F6CDD1D)
        return (mixed ^ mixed >> np.int64(29)) & self.mask

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE without one; a negative symbol pairs with nothing."""
        keys = a.astype(np.int64) * self.base + b
        at = self._slot(keys)
        rank = np.full(len(keys), NONE, dtype=np.int32)
        for _ in range(self.probes):
            hit = self.slot_key[at] == keys
            rank[hit] = self.slot_rank[at[hit]]
            if not (self.slot_key[at] != -1)[~hit].any():
                break
            at = at + 1 & self.mask
        rank[(a < 0) | (b < 0)] = NONE
        return rank

    def _merge(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols (-1: none, at the end) after all merges: lowest rank first, leftmost first."""
        done, live = symbols, np.arange(len(symbols))
        width = symbols.shape[1]
        work = symbols.copy()
        ranks = np.full(symbols.shape, NONE, dtype=np.int32)
        ranks[:, :-1] = self._rank(work[:, :-1].ravel(), work[:, 1:].ravel()).reshape(len(work), -1)
        columns = np.arange(width)
        while len(live):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(live))
            best = ranks[rows, at]
            go = best != NONE
            if not go.all():
                done[live[~go]] = work[~go]
                live, work, ranks, at, best = live[go], work[go], ranks[go], at[go], best[go]
                rows = np.arange(len(live))
                if not len(live):
                    break
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            ended = work[:, -1].copy()
            work, ranks = np.take_along_axis(work, source, 1), np.take_along_axis(ranks, source, 1)
            work[:, -1] = np.where(at < width - 1, -1, ended)
            ranks[:, -1] = NONE
            work[rows, at] = self.merged[best]
            right = np.minimum(at + 1, width - 1)
            ranks[rows, at] = np.where(at + 1 < width, self._rank(work[rows, at], work[rows, right]), NONE)
            left = np.maximum(at - 1, 0)
            ranks[rows, left] = np.where(at > 0, self._rank(work[rows, left], work[rows, at]), ranks[rows, left])
        return done

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        by_width: dict[int, tuple[list[str], list[bytes]]] = {}
        for word in words:
            raw = word.encode()
            width = min(LONGEST + 1, 1 << max(2, (len(raw) - 1).bit_length()))
            names, raws = by_width.setdefault(width, ([], []))
            names.append(word)
            raws.append(raw)
        for width, (names, raws) in by_width.items():
            if width > LONGEST:
                self.words.update((w, self._encode(w)) for w in names)
                continue
            sizes = np.array(list(map(len, raws)))
            flat = np.frombuffer(b"".join(raws), dtype=np.uint8)
            inside = np.arange(width) < sizes[:, None]
            symbols = np.full(inside.shape, -1, dtype=np.int32)
            symbols[inside] = self.first[flat]
            symbols[np.arange(len(names)), sizes - 1] = self.last[flat[np.cumsum(sizes) - 1]]
            symbols = self._merge(symbols)
            kept = symbols >= 0
            ids, ends = symbols[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
            self.words.update(zip(names, [ids[a:b] for a, b in zip([0, *ends], ends)]))

    def _learn(self, parts: list[str]) -> None:
        """Parts are a word, a word and one mark, or anything else; only that is split by the pattern."""
        if not self.plain:
            made = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
            self.known.update((p, np.array(e.ids, dtype="<u4").tobytes()) for p, e in zip(parts, made))
            return
        words: list[str] = []
        marked: list[str] = []
        other: list[str] = []
        for p in parts:
            (words if p.isalpha() else marked if p[:-1].isalpha() else other).append(p)
        lower = [w.lower() for w in words]
        heads, marks = [p[:-1].lower() for p in marked], [p[-1] for p in marked]
        found = self.split("\n".join(other).lower() + "\n")
        new = {*lower, *heads, *marks, *found}
        new.discard("\n")
        if len(self.words) > KNOWN_PARTS:
            self.words.clear()
        self._learn_words([w for w in new if w not in self.words])
        get, known = self.words.__getitem__, self.known
        known.update(zip(words, map(get, lower)))
        known.update(zip(marked, map(bytes.__add__, map(get, heads), map(get, marks))))
        start = 0
        for p in other:
            end = found.index("\n", start)
            known[p] = b"".join(map(get, found[start:end]))
            start = end + 1

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        The texts are cut at white space and their distinct parts numbered outside Python; what the cut
        leaves inside a part, the pattern drops.
        """
        whole = {k for k, t in enumerate(texts) if "<|" in t and any(a in t for a in self.added) or CONTROL.search(t)}
        cut = pc.utf8_split_whitespace(pa.array([None if k in whole else t for k, t in enumerate(texts)], pa.large_string()))
        coded = pc.dictionary_encode(cut.flatten())
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > KNOWN_PARTS:
            self.known.clear()
        known = self.known
        missing = [p for p in parts if p not in known]
        if self.plain:
            for p in missing:
                if not p.isascii() and PLAIN.search(p):
                    known[p] = self._encode(p)
            missing = [p for p in missing if p not in known] if missing else missing
        if missing:
            self._learn(missing)
        made = [known[p] for p in parts]
        places = list(map(made.__getitem__, coded.indices.to_numpy(zero_copy_only=False).tolist()))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False)).tolist()
        return [self._encode(t) if k in whole else b"".join(places[a:b]) for k, (t, a, b) in enumerate(zip(texts, [0, *ends], ends))]
