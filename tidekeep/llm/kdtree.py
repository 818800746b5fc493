"""Exact top-k by inner product with one KD-tree for each shard.

Vectors are quantised to integers, so scores are exact.  A coarse tree, fitted on a bounded sample, deals the vectors
to cells; a cell with more than SHARD rows is dealt further by a hash, so any number of equal vectors splits.  Each
shard builds a KD-tree by median splits on its widest dimension, with tight boxes.  A box bounds a query's inner
product from above by the sum over dimensions of max(q * low, q * high).

Three steps: every query searches its own cell's shards, which gives it a k-th score; query-shard pairs whose shard box
can't reach that score are dropped; the others are searched best-first with the k-th score handed down.  Blocks of
queries meet blocks of rows; there is no join of all rows with all rows.

Defined cases: vectors that are null or empty, or hold a null or non-finite component, take no part; only vectors of a
query's dimension are its candidates; repeated ids count as separate rows (the query's own id is left out); fewer
candidates than k give fewer rows; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.llm.common import stored

#: Rows of a leaf, rows of a shard, queries of a block, and rows of the sample that fits the coarse tree.
LEAF, SHARD, BLOCK, SAMPLE = 256, 8192, 1024, 20_000


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and v, an array of floor(scale * x), of the vectors that take part."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(1e12))), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).where(fine & (F.size("x") > 0) & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


def split(points: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Leaves of a KD-tree: halves at the median of the widest dimension until most rows are left, or equal ones."""
    stack = [rows]
    while stack:
        own = stack.pop()
        spread = points[own].max(axis=0) - points[own].min(axis=0) if len(own) else np.zeros(1)
        if len(own) <= most or not spread.any():
            yield own
            continue
        half = len(own) // 2
        order = np.argpartition(points[own, int(spread.argmax())], half)
        stack += [own[order[:half]], own[order[half:]]]


class Coarse:
    """A small KD-tree of (dimension, threshold) nodes, fitted on a sample; it only deals rows to cells."""

    def __init__(self, points: np.ndarray, cells: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self._grow(points, max(1, cells))

    def _grow(self, points: np.ndarray, cells: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, at, at))
        if cells > 1 and len(points) > 1 and (spread := points.var(axis=0)).any():
            dim = int(spread.argmax())
            cut = float(np.median(points[:, dim]))
            low = points[:, dim] < cut
            if low.any() and not low.all():
                self.nodes[at] = (dim, cut, self._grow(points[low], cells // 2), self._grow(points[~low], cells - cells // 2))
        return at

    def cell(self, points: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while stack:
            at, rows = stack.pop()
            dim, cut, left, right = self.nodes[at]
            if dim < 0 or not len(rows):
                out[rows] = at
                continue
            low = points[rows, min(dim, points.shape[1] - 1)] < cut
            stack += [(left, rows[low]), (right, rows[~low])]
        return out


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries (rows) with anything in boxes (columns); exact in doubles."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, ties to smaller ids."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(queries: np.ndarray, own: np.ndarray, least: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best in one shard, at least `least`; -inf where there are fewer.

    Best-first: each query's leaves are taken in the order of their bounds, the n-th best leaf of all queries at once,
    until a query's next bound lies below its k-th score so far.
    """
    leaves = list(split(points, np.arange(len(points)), LEAF))
    low = np.array([points[x].min(axis=0) for x in leaves])
    high = np.array([points[x].max(axis=0) for x in leaves])
    upper = bounds(queries, low, high)
    order = np.argsort(-upper, axis=1, kind="stable")
    scores = np.full((len(queries), k), -np.inf)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    kth = least.astype(float).copy()
    alive = np.arange(len(queries))
    for turn in range(len(leaves)):
        leaf = order[alive, turn]
        on = upper[alive, leaf] >= kth[alive]
        alive, leaf = alive[on], leaf[on]
        if not len(alive):
            break
        for x in np.unique(leaf):
            who = alive[leaf == x]
            s = queries[who] @ points[leaves[x]].T
            i = np.broadcast_to(ids[leaves[x]], s.shape)
            s = np.where((i == own[who, None]) | (s < kth[who, None]), -np.inf, s)
            if s.shape[1] > 4 * k and k < s.shape[1]:  # a cheap cut first, which keeps all ties with the k-th
                cut = np.partition(s, -k, axis=1)[:, -k][:, None]
                keep = int((s >= cut).sum(axis=1).max())
                part = np.argsort(-s, axis=1, kind="stable")[:, :keep]
                s, i = np.take_along_axis(s, part, 1), np.take_along_axis(i, part, 1)
            scores[who], found[who] = _best(np.hstack([scores[who], s]), np.hstack([found[who], i]), k)
            kth[who] = np.maximum(kth[who], scores[who, -1])
    return scores, found


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best by integer inner product for each row whose id is divisible by every."""
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, key, vector).withColumn("dim", F.size("v")), "vectors")
    dims = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    trees: dict[int, Coarse] = {}
    for dim, n in dims.items():
        part = rows.where(F.col("dim") == dim)
        picked = part.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE + 1))) == 0) if n > SAMPLE else part
        trees[dim] = Coarse(_matrix(picked.limit(SAMPLE).toPandas()["v"]), -(-n // shard)) if n > shard else Coarse(np.zeros((0, dim)), 1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(cell=0)
            for dim, part in b.groupby("dim"):
                b.loc[part.index, "cell"] = trees[dim].cell(_matrix(part["v"]))
            yield b

    celled = stored(rows.mapInPandas(deal, "vec_id long, v array<bigint>, dim int, cell long"), "cells")
    sizes = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("salts")).cast("int")
    placed = celled.join(sizes, ["dim", "cell"]).withColumn("salt", salt)

    def boxes(b: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(b["v"])
        return pd.DataFrame([{"dim": b["dim"].iloc[0], "cell": b["cell"].iloc[0], "salt": b["salt"].iloc[0], "low": m.min(axis=0), "high": m.max(axis=0)}])

    where = ["dim", "cell", "salt"]
    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0)
    ask = queries.select("dim", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "cell", "salts")
    block = F.pmod(F.xxhash64("query_id"), F.greatest(F.lit(1), F.lit(-(-sum(dims.values()) // (every * BLOCK))))).cast("int")
    ask = stored(ask.withColumn("block", block), "queries")
    answers = "query_id long, scores array<bigint>, ids array<bigint>"

    def answer(q: pd.DataFrame, p: pd.DataFrame, kth: np.ndarray) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "scores": pd.Series(dtype=object), "ids": pd.Series(dtype=object)})
        scores, ids = [], []
        points, names = _matrix(p["v"]), p["vec_id"].to_numpy()
        for at in range(0, len(q), BLOCK):
            part = q.iloc[at : at + BLOCK]
            s, i = search(_matrix(part["q"]), part["query_id"].to_numpy(), kth[at : at + BLOCK], points, names, k)
            fine = np.isfinite(s)
            scores += [x[f].astype(np.int64) for x, f in zip(s, fine, strict=True)]
            ids += [x[f] for x, f in zip(i, fine, strict=True)]
        return pd.DataFrame({"query_id": q["query_id"].to_numpy(), "scores": scores, "ids": ids})

    def near(_, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return answer(q, p, np.full(len(q), -np.inf))

    def far(_, q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return answer(q, p, q["kth"].to_numpy(dtype=float))

    home = ask.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "query_id", "q")
    first = stored(home.groupBy(*where).cogroup(placed.groupBy(*where)).applyInPandas(near, answers), "near")
    one = first.select("query_id", F.explode(F.arrays_zip("scores", "ids")).alias("x")).select("query_id", "x.scores", "x.ids")
    # only ever the k best of a query's few shards
    kth = first.groupBy("query_id").agg(F.flatten(F.collect_list("scores")).alias("s")).select("query_id", F.get(F.sort_array("s", asc=False), F.lit(k - 1)).alias("kth"))
    known = ask.join(kth, "query_id", "left").withColumn("kth", F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))))
    known = stored(known.select("dim", "cell", "block", "query_id", "q", "kth"), "known")
    shards = placed.groupBy(*where).applyInPandas(boxes, "dim int, cell long, salt int, low array<double>, high array<double>")
    shards = stored(shards, "boxes").select("dim", F.col("cell").alias("to"), "salt", "low", "high")

    def reach(_, q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Of a block of queries and all boxes: the pairs worth a search."""
        if not len(q) or not len(b):
            return pd.DataFrame({k: [] for k in ("dim", "cell", "salt", "query_id", "q", "kth")})
        upper = bounds(_matrix(q["q"]), _matrix(b["low"]), _matrix(b["high"]))
        x, y = np.nonzero((upper >= q["kth"].to_numpy(dtype=float)[:, None]) & (q["cell"].to_numpy()[:, None] != b["to"].to_numpy()[None, :]))
        return pd.DataFrame({"dim": b["of"].to_numpy()[y], "cell": b["to"].to_numpy()[y], "salt": b["salt"].to_numpy()[y], "query_id": q["query_id"].to_numpy()[x], "q": q["q"].to_numpy()[x], "kth": q["kth"].to_numpy()[x]})

    blocks = ask.select(F.col("dim").alias("of"), F.col("block").alias("for")).distinct()
    boxed = shards.join(blocks, F.col("dim") == F.col("of")).select("of", "for", "to", "salt", "low", "high")
    pairs = known.groupBy("dim", "block").cogroup(boxed.groupBy("of", "for")).applyInPandas(reach, "dim int, cell long, salt int, query_id long, q array<bigint>, kth double")
    rest = pairs.groupBy(*where).cogroup(placed.groupBy(*where)).applyInPandas(far, answers)
    more = rest.select("query_id", F.explode(F.arrays_zip("scores", "ids")).alias("x")).select("query_id", "x.scores", "x.ids")

    merged = one.union(more).groupBy("query_id").agg(F.collect_list(F.struct((-F.col("scores")).alias("s"), F.col("ids").alias("i"))).alias("all"))
    best = merged.select("query_id", F.posexplode(F.slice(F.sort_array("all"), 1, k)).alias("pos", "x"))
    return best.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
