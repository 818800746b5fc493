"""Near-duplicate documents at a Jaccard similarity of word shingles, on top of SimHash links.

A 64-bit SimHash within two bits (see simhash) finds few pairs whose shingle sets are 0.8 alike: such pairs differ in
about ten bits.  So its links are one source of candidates here, and MinHash bands are the other: BANDS keys of ROWS
minima each, which miss a pair at 0.8 with a chance of (1 - 0.8 ** 4) ** 22, about 1 in 100,000.  Candidates of one key are
compared by their whole signatures (a pair at the similarity falls short of the cut with a chance under 1e-8), those that
may reach the similarity are verified on the exact shingle sets, and links make components.

Documents with equal shingle sets count once.  A key with more than RUN of them isn't listed in pairs: all its sets are
compared with one of them, the pivot.  Sets as similar to it are linked to it, so only pairs with a set that isn't remain:
blocks of those meet blocks of all, each two blocks in a task, and only a spanning set of verified links leaves a task.

Defined cases: null texts and texts without words have the empty set and are copies of each other; texts of fewer words
than a shingle are one shingle; texts of any length pass whole; repeated rows are copies; an empty table gives an empty
table.  The key must be unique and never null, as texts are fetched by it: see common.rowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.llm import simhash
from tidekeep.llm.common import components, sifted
from tidekeep.sources.shared import stored

BANDS, ROWS = 22, 4
#: Sets of a key whose pairs are listed, and sets of a block beyond that.
RUN, BLOCK = 16, 256
#: Standard errors by which a signature may fall short of the similarity.
SLACK = 6.0
_RNG = np.random.default_rng(20240501)
_A, _B = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, n))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of the shingles under BANDS * ROWS multiply-shift hashes."""
    out = np.full(len(_A), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        out = np.minimum(out, ((shingles[at : at + 4096, None] * _A + _B) >> np.uint64(17)).min(axis=0))
    return out


def _mixed(rows: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each row of unsigned integers."""
    h = np.full(rows.shape[0], 0x9E3779B97F4A7C15, np.uint64)
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def sketches(docs: DataFrame, shingle: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, node (a hash of the shingle set), fp (its SimHash), keys (of the bands) and signature (a byte each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, signs = [], [], []
            for t in b.column(1).to_pylist():
                own = shingle_set(t, shingle)
                nodes.append(simhash.xxhash.xxh64_intdigest(own.tobytes(), 7))
                fps.append(simhash.simhash(own))
                signs.append(signature(own))
            sign = np.array(signs, np.uint64).reshape(-1, BANDS, ROWS)
            keys = np.stack([_mixed(np.concatenate([np.full((len(sign), 1), k, np.uint64), sign[:, k]], axis=1)) for k in range(BANDS)], axis=1)
            low = (sign.reshape(len(sign), -1) & np.uint64(0xFF)).astype(np.uint8)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), as_long(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), as_long(nodes), as_long(fps), lists, pa.array([x.tobytes() for x in low], pa.binary())], ["doc_id", "node", "fp", "keys", "sign"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, node long, fp long, keys array<long>, sign binary")


def _matrix(sign) -> np.ndarray:
    return np.frombuffer(b"".join(sign), np.uint8).reshape(-1, BANDS * ROWS)


def _least(similarity: float) -> float:
    """Equal signature bytes of sets at the similarity, less SLACK standard errors."""
    n = BANDS * ROWS
    return n * (similarity - SLACK * (similarity * (1 - similarity) / n) ** 0.5)


def candidates(sets: DataFrame, similarity: float, run: int = RUN) -> DataFrame:
    """Pairs (a, b) of nodes that share a band and whose signatures allow the similarity; (node, node, key) for each node of a larger key."""
    least = _least(similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for long, (key, node, sign) in simhash.runs(batches, run):
            if long:
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node), pa.array(key)], ["a", "b", "key"])
                continue
            _, which, count = np.unique(key, return_inverse=True, return_counts=True)
            some = count[which] > 1
            key, node, signs = key[some], node[some], _matrix(sign[some])
            i, j = simhash.run_pairs(key, lambda i, j: (signs[i] == signs[j]).sum(axis=1) >= least)  # noqa: B023
            both = np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1)
            found = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(len(found), pa.int64())], ["a", "b", "key"])

    keyed = sets.select(F.explode("keys").alias("key"), "node", "sign")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long, key long")


def _alike(x, y, similarity: float):
    common = F.size(F.array_intersect(x, y))
    return common >= F.lit(similarity) * (F.size(x) + F.size(y) - common)


def hot_links(hot: DataFrame, full: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among the nodes of each large key (key, node), verified on their sets (node, sign, shingles)."""
    least = _least(similarity)

    def cell(_, some, every):
        import pandas as pd

        node, signs = every["node"].to_numpy(), _matrix(every["sign"])
        own = [np.asarray(x) for x in every["shingles"]]
        up = list(range(len(node)))

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        place = {x: i for i, x in enumerate(node.tolist())}
        found = []
        for x, sign, mine in zip(some["node"].tolist(), _matrix(some["sign"]), some["shingles"], strict=True):
            at = place.get(x)
            if at is None:  # a set that isn't in this block of all sets takes part for now
                at = len(up)
                up.append(at)
            mine = np.asarray(mine)
            for j in np.flatnonzero((signs == sign).sum(axis=1) >= least).tolist():
                if find(at) == find(j):
                    continue
                common = len(np.intersect1d(mine, own[j], assume_unique=True))
                if common >= similarity * (len(mine) + len(own[j]) - common):
                    up[find(at)] = find(j)
                    found.append((x, node[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    hot = stored(hot.distinct(), "hot-keys")
    pivots = hot.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n"))
    of = pivots.join(full.select(F.col("node").alias("pivot"), F.col("shingles").alias("y")), "pivot")
    met = hot.join(of, "key").join(full.select("node", F.col("shingles").alias("x")), "node")
    met = stored(met.select("key", "node", "pivot", "n", _alike("x", "y", similarity).alias("near")), "hot-pivots")
    star = met.where("near and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    far = met.where("not near")
    left = far.groupBy("key").agg(F.count("*").alias("m"))
    slot = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / block)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("int"), F.ceil(F.col(n) / block).cast("int") - 1))
    some = far.join(left, "key").select("key", slot("m").alias("u"), every("n").alias("v"), "node").join(full, "node")
    rest = met.join(left, "key").select("key", slot("n").alias("v"), every("m").alias("u"), "node").join(full, "node")
    some, rest = (x.toDF(*x.columns) for x in (some, rest))  # columns of their own, although both come from one table
    return star.union(some.groupBy("key", "u", "v").cogroup(rest.groupBy("key", "u", "v")).applyInPandas(cell, "a long, b long"))


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id", run: int = RUN, block: int = BLOCK) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its group) of every row."""
    rows = stored(sketches(docs, shingle, text, key), "sketches")
    sets = stored(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sign").alias("sign")), "sets")
    heads = sets.groupBy("fp").agg(F.min("node").alias("head"))
    near = simhash.links(sets.select("fp"))
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    alike = sets.join(heads, "fp").where("node <> head").select(F.col("node").alias("x"), F.col("head").alias("y"))
    banded = stored(candidates(sets, similarity, run), "band-pairs")
    hot = banded.where("key is not null").select("key", F.col("a").alias("node"))
    pairs = near.union(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(banded.where("key is null").select("a", "b"))
    pairs = stored(pairs.where("a <> b").distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(hot.select("node")).distinct()
    needed = stored(wanted.join(sets.select("node", F.col("least").alias("need")), "node").select("need", "node"), "needed")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                own = [shingle_set(t, shingle).view(np.int64) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], ["node", "shingles"])

    bodies = docs.select(F.col(key).cast("long").alias("least"), F.col(text).cast("string").alias("body"))
    maybe, _ = sifted(bodies, "least", needed)
    full = maybe.join(needed.hint("merge"), F.col("least") == F.col("need")).select("node", "body").mapInArrow(whole, "node long, shingles array<long>").dropDuplicates(["node"])
    full = stored(full, "shingles")
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    edges = both.where(_alike("x", "y", similarity)).select("a", "b")
    edges = edges.union(hot_links(hot, full.join(sets.select("node", "sign"), "node"), similarity, block))
    parts = components(edges).withColumnRenamed("node", "_node")
    named = sets.select("node", "least").join(parts, F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(named.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
