"""Near-duplicate lines by a segment-partition edit join.

Lines are compared without the white space at their ends.  Equal lines are one class, whatever their length; lines of at
least MIN_CHARS characters are also linked if at most `errors` single-character edits lie between them.  A line is indexed by
errors + 1 segments, one of which survives any such edits; it probes the segments of its own and of smaller lengths at the
places that a match may have shifted to.  Lines that share a segment are candidates if their parity signatures allow it (an
edit flips at most two bits), and are then verified by banded bit-parallel edit distance.

A line is known by 128 bits, two hashes of its text (h, g).  Candidates are named by the first, which only costs a needless
comparison where two lines share it.

Candidates of a key with more than RUN lines aren't listed in pairs.  All its lines are compared with one of them, the
pivot; lines near it are linked to it, so only pairs with a line that isn't near it remain: blocks of those lines meet
blocks of all, each two blocks in a task, and only a spanning set of links leaves a task.

Defined cases: null texts and blank lines have no class; the first line of a class by (doc_id, line_no) is kept (null ids
come last); classes() calls rows that repeat a doc_id by that id and number, so lines are taken out of texts by a unique key
only; lines of any length pass whole; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.llm.common import components, sifted
from tidekeep.llm.simhash import run_pairs, runs
from tidekeep.sources.shared import stored

MIN_CHARS, ERRORS = 20, 2
#: Lines of a key whose pairs are listed, and lines of a block beyond that.
RUN, BLOCK = 128, 512
BLANK = " \t\r\x0b\x0c"
#: Lines that a task remembers to have emitted, and characters that are indexed at once.
SEEN, CHARS = 100_000, 1 << 19


def distance(a: str, b: str, most: int) -> int:
    """Edit distance of a and b, or most + 1 if it is larger: one machine word that slides along the band (Hyyro 2003)."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    lead, least = 0, len(b)
    while lead < least and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < least - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if not b:
        return len(a)
    if len(a) <= most:
        return _whole(a, b, most)
    bits = 2 * most + 2
    ones, top = (1 << bits) - 1, 1 << (bits - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    plus, minus, now = ones << (bits - most - 1) & ones, 0, most
    start, side, limit = most + 1 - bits, top >> 1, most + len(b) - (len(a) - most)
    for i, c in enumerate(b):
        found = places.get(c, 0)
        x = (found >> start if start >= 0 else found << -start) & ones
        d = ((((x & plus) + plus) ^ plus) | x | minus) & ones
        up, down = (minus | ~(d | plus)) & ones, d & plus
        if i < len(a) - most:
            now += not d & top
        else:
            now += bool(up & side) - bool(down & side)
            side >>= 1
        if now > limit:
            return most + 1
        plus, minus = (down | ~(d >> 1 | up)) & ones, d >> 1 & up
        start += 1
    return now if now <= most else most + 1


def _whole(a: str, b: str, most: int) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], most + 1)


def segments(length: int, errors: int) -> list[tuple[int, int]]:
    """(start, characters) of the errors + 1 segments of a line: even, the longer ones last."""
    n = errors + 1
    short, longer = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        size = short + (i >= n - longer)
        out.append((at, size))
        at += size
    return out


def probes(sizes: np.ndarray, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool, np.ndarray]]:
    """Columns (start, characters, tag, own, fine) of the substrings that lines of these sizes have in the index.

    The tag is the indexed length and the segment's number; own: whether it is one of the lines' own segments; fine: which
    lines have it.
    """
    count = errors + 1
    for shift in range(errors + 1):
        other = sizes - shift
        short, longer = np.divmod(other, count)
        for i in range(count):
            at, n = i * short + np.maximum(0, i - (count - longer)), short + (i >= count - longer)
            for d in range(max(-i, shift - (errors - i)), min(i, shift + (errors - i)) + 1):
                p = at + d
                yield p, n, other << 3 | i, shift == 0 and d == 0, (other >= count) & (p >= 0) & (p + n <= sizes)


_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    full = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full((1 << bits) - 1, x, np.uint64)]))
    return full(_BASE), full(_UNBASE)


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all lines one after another, and each line's size and start."""
    sizes = np.array([len(x) for x in lines], np.int64)
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4"), sizes, np.cumsum(sizes) - sizes


def _parity(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduceat(np.uint64(1) << (codes & 63).astype(np.uint64), starts)


def line_index(lines: list[str], errors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which, key, own, parity signature of each line) of the substrings of lines: polynomial hashes from prefix sums, all at once."""
    codes, sizes, starts = _codes(lines)
    signs = _parity(codes, starts) if lines else np.zeros(0, np.uint64)
    up, down = _powers(max(CHARS, len(codes) + 1).bit_length())
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * up[: len(codes)], out=sums[1:])
    which, keys, own = [], [], []
    for p, n, tag, mine, fine in probes(sizes, errors):
        rows = np.flatnonzero(fine)
        low = (starts + p)[rows]
        x = (sums[low + n[rows]] - sums[low]) * down[low]
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xFF51AFD7ED558CCD) + tag[rows].astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
        which.append(rows)
        keys.append(x ^ x >> np.uint64(29))
        own.append(np.full(len(rows), mine, np.int64))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(which, np.int64), join(keys, np.uint64), join(own, np.int64), signs


def signatures(lines: list[str]) -> np.ndarray:
    """64 parity bits for each line, of the characters by their code modulo 64; 0 for an empty one."""
    out = np.zeros(len(lines), np.uint64)
    some = [k for k, x in enumerate(lines) if x]
    if some:
        codes, starts = _codes([lines[k] for k in some])[::2]
        out[some] = _parity(codes, starts)
    return out


def lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, line_no (from 0), line, h, g: the lines that aren't blank."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text).cast("string"), "\n", -1)).alias("line_no", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(BLANK))).where("line <> ''")
    return rows.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit("line"), F.col("line"))})


def links(docs: DataFrame, min_chars: int = MIN_CHARS, errors: int = ERRORS, text: str = "text", run: int = RUN, block: int = BLOCK) -> DataFrame:
    """Links (a, b), each struct<h, g>, of distinct lines: they connect just what lines within `errors` edits connect."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def out(fresh: list[str], names: list[int]) -> pa.RecordBatch:
            which, keys, own, signs = line_index(fresh, errors)
            mark = ((signs ^ signs >> np.uint64(32)) & np.uint64(0xFFFFFFFF)).astype(np.int64) << 1
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.array(names, np.uint64).view(np.int64)[which]), pa.array(mark[which] | own)], ["key", "h", "mark"])

        for b in batches:
            fresh, names, size = [], [], 0
            for t in b.column(0):
                for raw in (t.as_py() or "").split("\n"):
                    line = raw.strip(BLANK)
                    if len(line) < min_chars:
                        continue
                    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
                    if h in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(h)
                    fresh.append(line)
                    names.append(h)
                    size += len(line)
                    if size >= CHARS:
                        yield out(fresh, names)
                        fresh, names, size = [], [], 0
            if fresh:
                yield out(fresh, names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for long, (key, h, mark) in runs(batches, run):
            if long:
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(h), pa.array(key)], ["a", "b", "key"])
                continue
            fine = lambda i, j: ((mark[i] | mark[j]) & 1 == 1) & (h[i] != h[j]) & (np.bitwise_count((mark[i] ^ mark[j]) >> 1) <= 2 * errors)  # noqa: B023, E731
            i, j = run_pairs(key, fine)
            pairs = np.unique(np.stack([np.minimum(h[i], h[j]), np.maximum(h[i], h[j])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], ["a", "b", "key"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine = [distance(x, y, errors) <= errors for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(fine, pa.bool_())], [*b.schema.names[:-2], "near"])

    def cell(_, some, every):
        import pandas as pd

        h, g, own = every["h"].to_numpy(), every["g"].to_numpy(), every["line"].tolist()
        n, sign = len(own), signatures(own)
        up = list(range(n))

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        place = {x: i for i, x in enumerate(zip(h.tolist(), g.tolist(), strict=True))}
        found = []
        for x, y, line, bits in zip(some["h"].tolist(), some["g"].tolist(), some["line"].tolist(), signatures(some["line"].tolist()), strict=True):
            at = place.get((x, y))
            if at is None:  # a line that isn't in this block of all lines takes part for now
                at = len(up)
                up.append(at)
            for j in np.flatnonzero(np.bitwise_count(sign ^ bits) <= 2 * errors).tolist():
                if find(at) != find(j) and distance(line, own[j], errors) <= errors:
                    up[find(at)] = find(j)
                    found.append((x, y, h[j], g[j]))
        return pd.DataFrame(found, columns=["ah", "ag", "bh", "bg"], dtype="int64")

    body = docs.select(F.col(text).cast("string").alias("text"))
    keyed = body.mapInArrow(emit, "key long, h long, mark long")
    found = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long, key long").distinct(), "line-candidates")
    needed = found.select(F.explode(F.array("a", "b")).alias("need")).distinct()
    maybe, _ = sifted(lines(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), "text").select("h", "g", "line"), "h", needed)
    # copies are combined before they are dealt by h, and the join is the same at every size
    some = maybe.groupBy("h", "g").agg(F.min("line").alias("line"))
    texts = stored(some.join(needed.hint("merge"), F.col("h") == F.col("need"), "left_semi"), "line-texts")
    side = lambda name, text: texts.select(F.col("h").alias(name), F.col("g").alias(f"{name}g"), F.col("line").alias(text))
    four = lambda df: df.select(F.struct(F.col("ah").alias("h"), F.col("ag").alias("g")).alias("a"), F.struct(F.col("bh").alias("h"), F.col("bg").alias("g")).alias("b"))
    pairs = found.where("key is null").select(F.col("a").alias("ah"), F.col("b").alias("bh"))
    pairs = pairs.join(side("ah", "x"), "ah").join(side("bh", "y"), "bh").select("ah", F.col("ahg").alias("ag"), "bh", F.col("bhg").alias("bg"), "x", "y")
    direct = pairs.mapInArrow(near, "ah long, ag long, bh long, bg long, near boolean").where("near")
    hot = found.where("key is not null").select("key", F.col("a").alias("h")).join(texts, "h")
    pivots = hot.groupBy("key").agg(F.min(F.struct("h", "g", "line")).alias("p"), F.count("*").alias("n"))
    met = hot.join(pivots, "key").select("key", "n", "h", "g", "line", F.col("p.h").alias("ph"), F.col("p.g").alias("pg"), F.col("line").alias("x"), F.col("p.line").alias("y"))
    met = stored(met.mapInArrow(near, "key long, n long, h long, g long, line string, ph long, pg long, near boolean"), "line-pivots")
    star = met.where("near and (h <> ph or g <> pg)").select(F.col("h").alias("ah"), F.col("g").alias("ag"), F.col("ph").alias("bh"), F.col("pg").alias("bg"))
    far = met.where("not near")
    left = far.groupBy("key").agg(F.count("*").alias("m"))
    slot = lambda n: F.pmod(F.xxhash64("h", "g"), F.ceil(F.col(n) / block)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("int"), F.ceil(F.col(n) / block).cast("int") - 1))
    both = met.join(left, "key")
    some = far.join(left, "key").select("key", slot("m").alias("u"), every("n").alias("v"), "h", "g", "line")
    rest = both.select("key", slot("n").alias("v"), every("m").alias("u"), "h", "g", "line")
    some, rest = (x.toDF(*x.columns) for x in (some, rest))  # columns of their own, although both come from one table
    cells = some.groupBy("key", "u", "v").cogroup(rest.groupBy("key", "u", "v")).applyInPandas(cell, "ah long, ag long, bh long, bg long")
    return four(direct.drop("near")).union(four(star)).union(four(cells))


def classes(docs: DataFrame, min_chars: int = MIN_CHARS, errors: int = ERRORS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per line that isn't blank: doc_id, line_no, n_chars, class_doc_id and class_line_no (its class's first line), kept."""
    own = stored(lines(docs, text, key).select("doc_id", "line_no", F.length("line").cast("long").alias("n_chars"), "h", "g"), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    least = stored(own.groupBy("h", "g").agg(F.min(place).alias("first")), "line-first")
    parts = components(links(docs, min_chars, errors, text)).select(F.col("node.h").alias("nh"), F.col("node.g").alias("ng"), "root")
    named = least.join(parts, (F.col("h") == F.col("nh")) & (F.col("g") == F.col("ng")), "left").select("h", "g", "first", F.coalesce("root", F.struct("h", "g")).alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("head"))
    by_line = named.join(firsts, "root").select("h", "g", "head")
    out = own.join(by_line, ["h", "g"]).select("doc_id", "line_no", "n_chars", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("line_no") == F.col("class_line_no")))


def without_repeats(docs: DataFrame, classed: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the lines that classes() doesn't keep taken out of the text; documents without such lines stay as they are.

    The key must be that of classes(), and unique and never null (see common.rowed): lines are taken out by key and number.
    """
    drop = stored(classed.where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("_drop")).withColumnRenamed("doc_id", "_doc"), "line-drops")
    maybe, others = sifted(docs, key, drop.select("_doc"))
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_drop", i))
    joined = maybe.join(drop.hint("merge"), F.col(key).cast("long") == F.col("_doc"), "left")
    return joined.withColumn(text, F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_doc", "_drop").unionByName(others)
