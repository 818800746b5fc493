"""Byte-level BPE of many words at once, with the merges of a tokenizer's file; the ids are the tokenizers library's.

All words of one length are a matrix of symbols.  Each step merges every word's pair of the lowest rank, the leftmost of
equal ones; the ranks of its two new neighbour pairs are looked up in an open hash table, the others stay.
"""

from __future__ import annotations

import json

import numpy as np

from tidekeep.llm.table import Table

NONE = np.iinfo(np.int32).max


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """None of words but runs of letters that the tokenizer keeps together may be passed: see supported()."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocabulary, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.fine = model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges") and '"ByteLevel"' in json.dumps(whole["pre_tokenizer"]) and end != ""
        names = byte_names()
        self.fine = self.fine and all(n in vocabulary and n + end in vocabulary for n in names)
        if not self.fine:
            return
        self.inner, self.last = (np.array([vocabulary[n + x] for n in names], np.int64) for x in ("", end))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocabulary[x] for x in part], np.int64) for part in (*zip(*pairs, strict=True), [a + b for a, b in pairs]))
        self.made, self.ranks = made, Table(left << 32 | right, np.arange(len(pairs), dtype=np.int32), NONE)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, NONE where there is no merge (or no symbol: -1)."""
        return np.where((left >= 0) & (right >= 0), self.ranks.get(left << 32 | right & 0xFFFFFFFF), NONE)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has.  Words are lower-cased runs of letters, none of them empty."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(x) for x in raw], np.int64)
        flat, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
        counts, out = np.zeros(len(words), np.int64), np.zeros(len(flat), np.uint32)
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            data = flat[starts[rows][:, None] + np.arange(size)]
            symbols = self.inner[data]
            symbols[:, -1] = self.last[data[:, -1]]
            counts[rows] = self._merge(symbols)
            keep = np.arange(size) < counts[rows][:, None]
            out[(starts[rows][:, None] + np.arange(size))[keep]] = symbols[keep]
        return out[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())], counts

    def _merge(self, symbols: np.ndarray) -> np.ndarray:
        """Merges the symbols of each row in place, to the left; returns how many are left."""
        n, size = symbols.shape
        left = np.full(n, size, np.int64)
        if size == 1:
            return left
        live, now = np.arange(n), symbols.copy()
        ranks = self.rank(now[:, :-1].reshape(-1), now[:, 1:].reshape(-1)).reshape(n, size - 1)
        while len(live):
            at = ranks.argmin(axis=1)
            each = np.arange(len(live))
            best = ranks[each, at]
            on = best != NONE
            symbols[live[~on], : now.shape[1]] = now[~on]
            live, now, ranks, at, best = live[on], now[on], ranks[on], at[on], best[on]
            if not len(live):
                break
            each = np.arange(len(live))
            left[live] -= 1
            width = now.shape[1]
            now[each, at] = self.made[best]
            # the column after the pair goes; a row that merges its last pair ends with no symbol
            pick = np.arange(width) + (np.arange(width) > at[:, None])
            now = np.take_along_axis(np.concatenate([now, np.full((len(live), 1), -1, np.int64)], axis=1), pick, axis=1)
            pick = pick[:, : width - 1]
            ranks = np.take_along_axis(np.concatenate([ranks, np.full((len(live), 2), NONE, np.int32)], axis=1), pick, axis=1)
            ranks[each, at] = self.rank(now[each, at], now[each, np.minimum(at + 1, width - 1)])
            ranks[each[at + 1 >= width - 1], at[at + 1 >= width - 1]] = NONE
            back = at > 0
            ranks[each[back], at[back] - 1] = self.rank(now[each[back], at[back] - 1], now[each[back], at[back]])
        return left
