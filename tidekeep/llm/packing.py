"""Sequence packing as a cutting-stock problem, solved by column generation.

Tokenised documents are cut into full sequences and one remainder each.  The remainders' lengths form a histogram of
classes (UNIT tokens wide, so its size is bounded); a linear program chooses patterns (which classes share one
sequence), with new patterns priced by a knapsack dynamic program over the duals.  Patterns are rounded down, what is
left is packed first-fit by decreasing length over the same histogram, and the ranked pieces take the patterns' slots.

Ranks are dealt without gathering a class in one task: rows are counted per class and slice of a hash, and ranked
within a slice.  Each text is tokenised once, and only lengths and checksums leave that step.

Defined cases: null and empty texts are the end token alone; repeated rows are packed each on their own; null doc_id
rows are packed like others; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidekeep.llm.bpe import Merges
from tidekeep.sources.shared import stored

#: Tokens of a sequence, width of a length class, and slices in which a class is ranked.
CAPACITY, UNIT, SLICES = 4096, 16, 64
#: Words whose tokens a worker holds (some 80 MB), those that it keeps beyond a task or when there are more (the most
#: frequent ones), and bytes of texts that are encoded at once (one text at least).
HELD_WORDS, KEPT_WORDS, BYTES = 400_000, 100_000, 4 << 20
#: Marks that combine with ASCII letters under NFC: texts with them aren't lower-cased ahead.
_MARK = "[\u0300-\u036f]"
#: Words that the tokenizer never splits before its merges: Latin letters that stay letters when lower-cased.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch


class WordCache:
    """Token ids of whole texts, from a tokenizer that never joins across white space and lower-cases.

    A text is the concatenation of its words' ids, and a final full stop or comma after a letter is a token run of
    its own; so each distinct word is encoded once for a worker, and texts are put together from their words' numbers.
    """

    def __init__(self, path: str, held: int = HELD_WORDS, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.encoder, self.held, self.kept, self.merges = Tokenizer.from_file(path), held, kept, Merges(path)
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.pool, self.starts, self.used = np.zeros(1 << 16, np.uint32), np.zeros((1 << 14) + 1, np.int64), 0
        self.times = np.zeros(1 << 14, np.int64)

    def trim(self) -> None:
        """Forgets all but the words that were seen most often."""
        if len(self.numbers) <= self.kept:
            return
        words, times = list(self.numbers), self.times[: len(self.numbers)]
        chosen = np.sort(np.argpartition(-times, self.kept)[: self.kept])
        low, high = self.starts[chosen], self.starts[chosen + 1]
        ids, counts = np.concatenate([self.pool[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]), high - low
        self._clear()
        self._add([words[k] for k in chosen.tolist()], ids, counts)
        self.times[: len(chosen)] = times[chosen] // 2

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Keeps words with their ids, which stand one after another."""
        n, end = len(self.numbers), self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(end, len(self.pool)), np.uint32)])
        if n + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts[: n + 1], np.zeros(n + len(words), np.int64)])
            self.times = np.concatenate([self.times[:n], np.zeros(n + len(words), np.int64)])
        self.pool[self.used : end] = ids
        self.starts[n + 1 : n + len(words) + 1] = self.used + np.cumsum(counts)
        self.numbers.update(zip(words, range(n, n + len(words)), strict=True))
        self.used = end

    def _encode(self, words: list[str]) -> None:
        plain = [w for w in words if _LETTERS(w)] if self.merges.fine else []
        if plain:
            self._add(plain, *self.merges.encode([w.lower() for w in plain]))
        rest = [w for w in words if w not in self.numbers]
        for at in range(0, len(rest), 2000):
            found = [e.ids for e in self.encoder.encode_batch_fast(rest[at : at + 2000], add_special_tokens=False)]
            self._add(rest[at : at + 2000], np.array([i for ids in found for i in ids], np.uint32), np.array([len(x) for x in found], np.int64))

    def _learn(self, new: list[str]) -> None:
        known = self.numbers
        ends = [w for w in new if w[-1:] in (".", ",") and w[-2:-1].isascii() and w[-2:-1].isalpha() and "<|" not in w]
        need = set(new).difference(ends)
        need.update([w[:-1] for w in ends], ".,")
        self._encode([w for w in need if w not in known])
        if ends:
            number = np.array([[known[w[:-1]], known[w[-1]]] for w in ends], np.int64).reshape(-1)
            places, counts = self._places(number)
            self._add(ends, self.pool[places], counts[::2] + counts[1::2])

    def _places(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of words stand, and how many each has."""
        first = self.starts[number]
        counts = self.starts[number + 1] - first
        ahead = np.cumsum(counts)
        return np.repeat(first - ahead + counts, counts) + np.arange(ahead[-1] if len(ahead) else 0), counts

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (and the last one's end)."""
        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, _MARK))
        split = pc.ascii_split_whitespace(pc.if_else(whole, texts, pc.ascii_lower(texts)))
        words = pc.list_flatten(split).dictionary_encode()
        vocabulary, at = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        number = list(map(self.numbers.get, vocabulary))
        if None in number:
            if len(self.numbers) + number.count(None) > self.held:
                self.trim()
                number = list(map(self.numbers.get, vocabulary))
            new = [k for k, n in enumerate(number) if n is None]
            self._learn([vocabulary[k] for k in new])
            for k in new:
                number[k] = self.numbers[vocabulary[k]]
        number = np.array(number, np.int64)
        self.times[number] += np.bincount(at, minlength=len(number))
        places, counts = self._places(number[at])
        after = np.concatenate([[0], np.cumsum(counts)])
        each = pc.list_value_length(split).to_numpy()
        return self.pool[places], after[np.concatenate([[0], np.cumsum(each)])]


@cache
def _words(path: str) -> WordCache:
    return WordCache(path)


def pieces(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document its full sequences and its remainder: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = _words(tokenizer), np.array([end], "<u4").tobytes()
        for big in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(big.column(1)), 0).to_numpy()) // BYTES
            for at, n in zip(*np.unique(size, return_index=True, return_counts=True)[1:], strict=True):
                b = big.slice(int(at), int(n))
                ids, bounds = words.ids(b.column(1))
                view = memoryview(ids.astype("<u4")).cast("B")
                out: list[tuple] = []
                for doc, low, high in zip(b.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    total = high - low + 1
                    for s in range(0, total, capacity):
                        crc = zlib.crc32(view[4 * (low + s) : 4 * min(high, low + s + capacity)])
                        out.append((doc, s, min(capacity, total - s), zlib.crc32(tail, crc) if s + capacity >= total else crc, total))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        words.trim()  # workers wait between tasks, and other stages need the memory
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern (count of each class) of the most dual value."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for space in range(1, room + 1):
        fit = np.flatnonzero(sizes <= space)
        best[space] = best[space - 1]
        if len(fit):
            value = best[space - sizes[fit]] + duals[fit]
            k = int(value.argmax())
            if value[k] > best[space] + 1e-12:
                best[space], pick[space] = value[k], fit[k]
    pattern, space = np.zeros(len(sizes), dtype=np.int64), room
    while space > 0:
        if pick[space] < 0:
            space -= 1
        else:
            pattern[pick[space]] += 1
            space -= int(sizes[pick[space]])
    return float(best[room]), pattern


def patterns(demand: dict[int, int], room: int, rounds: int = 2000) -> list[tuple[int, dict[int, int]]]:
    """(times, {class size: count}) that cover the demand with close to the fewest sequences of room units.

    Revised simplex over generated columns: minimise the number of sequences, one row for each class.
    """
    sizes = np.array(sorted(k for k, v in demand.items() if v > 0), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(k)] for k in sizes], dtype=float)
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = inverse @ need
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, pattern = price(np.maximum(duals, 0), sizes, room)
        if value <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        theta = ratio[out]
        x = np.maximum(x - theta * step, 0)
        x[out] = theta
        basis[:, out] = pattern
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    chosen: list[tuple[int, dict[int, int]]] = []
    left = need.astype(np.int64)
    for k in np.argsort(-x, kind="stable"):
        p = basis[:, k].astype(np.int64)
        used = np.flatnonzero(p)
        times = int(min(np.floor(x[k] + 1e-6), (left[used] // p[used]).min()))
        if times > 0:
            left[used] -= times * p[used]
            chosen.append((times, {int(sizes[i]): int(p[i]) for i in used}))
    # the rest, at most a few rows for each class: first fit by decreasing length, whole rounds of one pattern at once
    while left.any():
        space, p = room, np.zeros_like(left)
        for i in range(len(sizes) - 1, -1, -1):
            p[i] = min(left[i], space // sizes[i])
            space -= int(p[i] * sizes[i])
        used = np.flatnonzero(p)
        times = int((left[used] // p[used]).min())
        left[used] -= times * p[used]
        chosen.append((times, {int(sizes[i]): int(p[i]) for i in used}))
    return chosen


def pack(parts: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces()."""
    spark = parts.sparkSession
    parts = stored(parts, "pieces")
    full = F.col("length") == capacity
    size = F.ceil(F.col("length") / unit).cast("int")
    slice_ = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SLICES)).cast("int")
    rows = parts.select("*", F.when(full, 0).otherwise(size).alias("size"), slice_.alias("slice"))
    # at most (capacity / unit + 1) * SLICES rows
    counts = rows.groupBy("size", "slice").agg(F.count("*").alias("n")).collect()
    demand: dict[int, int] = {}
    before: list[tuple[int, int, int]] = []
    for c in sorted(counts, key=lambda c: (c["size"], c["slice"])):
        before.append((c["size"], c["slice"], demand.get(c["size"], 0)))
        demand[c["size"]] = demand.get(c["size"], 0) + c["n"]
    base, slots = demand.pop(0, 0), []
    taken: dict[int, int] = {}
    for times, pattern in patterns(demand, capacity // unit):
        for k, n in pattern.items():
            slots.append((k, taken.get(k, 0), taken.get(k, 0) + times * n, base, n))
            taken[k] = taken.get(k, 0) + times * n
        base += times
    start = F.broadcast(spark.createDataFrame(before, "size int, slice int, before long"))
    slot = F.broadcast(spark.createDataFrame(slots, "size int, lo long, hi long, base long, each long"))
    rank = F.row_number().over(Window.partitionBy("size", "slice").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = rows.join(start, ["size", "slice"]).withColumn("rank", F.col("before") + rank)
    whole = ranked.where("size = 0").select(*parts.columns, F.col("rank").alias("sequence_id"))
    within = ranked.where("size > 0").join(slot, "size").where("rank >= lo and rank < hi")
    shared = within.select(*parts.columns, F.expr("base + (rank - lo) div each").alias("sequence_id"))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    return whole.withColumn("offset", F.lit(0).cast("long")).unionByName(shared)


def packing(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    return pack(pieces(docs, tokenizer, end)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, tokens and padding: a sequence is padded to capacity unless its length is a power of two."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    free = F.when(F.col("used").bitwiseAND(F.col("used") - 1) == 0, 0).otherwise(capacity - F.col("used"))
    return used.agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"), F.sum(free).alias("padding"))
