"""Near-duplicate documents by SimHash, found with Golay-code fuzzy keys.

fingerprints() gives each text a 64-bit SimHash of its word shingles.  links() finds every pair of distinct
fingerprints that differ in at most two bits: a fingerprint is cut into segments of 22, 21 and 21 bits, of which at
least one holds no error; a key is one exact segment with one Golay index of the next, and two errors in that one
still share an index.  Values with a key in common are compared, and only a spanning set of links is kept.

Groups: exact copies share a fingerprint and count once.  A key with more than RUN distinct fingerprints isn't
compared pairwise; its members get 65 keys instead, themselves and every value one bit away.  Two values differ in at
most two bits just when such a key is common to both, and no such key has more than 65 holders, so this way is exact
and linear for groups of any size.

Defined cases: null text and text without words have fingerprint 0 and link like any other; repeated rows link to each
other; null doc_id rows are grouped but never name a component (a component of null ids only has a null id); an empty
table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.llm import golay
from tidekeep.llm.common import components
from tidekeep.sources.shared import stored

BITS = 64
#: Segments (first bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Distinct fingerprints of a key that are compared pairwise.
RUN = 128
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of every n-word shingle, repeats included; A-Z lower-cased, words joined by a space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, seed = xxhash.xxh64_intdigest, 42
    if len(words) <= n:
        return np.array([digest(b" ".join(words), seed)], dtype=np.uint64)
    return np.fromiter((digest(b" ".join(t), seed) for t in zip(*(words[k:] for k in range(n)), strict=False)), np.uint64, len(words) - n + 1)


def simhash(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: a bit is set if it is in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key as doc_id, fingerprint as a signed long (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(shingle_hashes(t.as_py(), shingle)) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, key) of unsigned fingerprints: for each segment, it and the Golay indices of the next one."""
    parts = [(fps >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1) for at, n in SEGMENTS]
    whiches, out = [], []
    for s in range(3):
        which, index = golay.keys(parts[(s + 1) % 3])
        whiches.append(which)
        out.append((np.int64(s) << 36) | parts[s][which] << 12 | index)
    return np.concatenate(whiches), np.concatenate(out)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of 0..n-1's component under the links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def run_pairs(group: np.ndarray, differ) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of one run of equal values of the sorted group for which differ(i, j) is true, by lag."""
    found_i, found_j, lag = [], [], 1
    at = np.flatnonzero(group[1:] == group[:-1])
    while len(at):
        ok = differ(at, at + lag)
        found_i.append(at[ok])
        found_j.append(at[ok] + lag)
        lag += 1
        at = at[at + lag < len(group)]
        at = at[group[at + lag] == group[at]]
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64),) * 2


def runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Of batches sorted by their first column: (False, columns) of whole runs of limit rows at most, and (True, columns) of rows from longer ones, as they pass."""
    carry: list[np.ndarray] | None = None
    long_key = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if long_key is not None:
            n = int(np.searchsorted(cols[0], long_key, side="right"))
            if n:
                yield True, [c[:n] for c in cols]
            cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            long_key = None
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        yield from _whole([c[:last] for c in cols], limit)
        carry = [c[last:] for c in cols]
        if len(carry[0]) > limit:
            long_key = carry[0][0]
            yield True, carry
            carry = None
    if carry is not None and len(carry[0]):
        yield from _whole(carry, limit)


def _whole(cols: list[np.ndarray], limit: int) -> Iterator[tuple[bool, list[np.ndarray]]]:
    if not len(cols[0]):
        return
    _, start, count = np.unique(cols[0], return_index=True, return_counts=True)
    many = np.repeat(count > limit, count)
    if many.any():
        yield True, [c[many] for c in cols]
        cols = [c[~many] for c in cols]
    yield False, cols


def links(fps: DataFrame, run: int = RUN) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of fps (fp): they connect just what pairs within two bits connect."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy()
            which, keys = golay_keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[which])], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for long, (key, fp) in runs(batches, run):
            if long:
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(fp)], ["a", "b"])
                continue
            near = lambda i, j: np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= 2  # noqa: B023, E731
            label = roots(len(fp), *run_pairs(key, near))
            linked = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], ["a", "b"])

    keyed = fps.select("fp").distinct().mapInArrow(emit, "key long, fp long")
    found = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long"), "simhash-links")
    near = F.array(F.lit(0).cast("long"), *[F.lit(-(1 << 63) if k == 63 else 1 << k).cast("long") for k in range(BITS)])
    ball = found.where("a = b").select(F.col("a").alias("fp")).distinct().select("fp", F.explode(near).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("w"))
    # at most 65 fingerprints share one w
    star = ball.groupBy("w").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    return found.union(star).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, itself included."""
    fps = stored(fingerprints(docs, shingle, text, key), "simhash")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = components(links(fps))
    named = least.join(parts, least.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
