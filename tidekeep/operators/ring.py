"""Consistent hashing: ring points, routing, rings by node status, and what a change of nodes moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the hash by which keys meet ring segments in an equi-join.
BUCKET_BITS = 10
#: Rings that a node of each status takes part in.
RINGS = {"active": ("read", "write", "shadow"), "warming": ("shadow",), "draining": ("read",)}


def points(nodes: DataFrame, replicas: int = 50, by: list[str] | None = None, ring_hash=F.crc32) -> DataFrame:
    """hash, node: `replicas` points of each node (node, ord); where two meet, the node added last owns the point."""
    by = by or []
    each = nodes.select(*by, "node", "ord", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("i"))
    each = each.withColumn("hash", ring_hash(F.concat_ws("-", F.col("i").cast("string"), F.col("node"))))
    return each.groupBy(*by, "hash").agg(F.max_by("node", "ord").alias("node"))


def segments(ring: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(lo, hi, node): a hash in (lo, hi] belongs to node; the last stretch wraps to the first point. One window over a ring's points."""
    by = by or []
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("hash")
    whole = Window.partitionBy(*(by or [F.lit(0)])).orderBy("hash").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ring.withColumns({"lo": F.coalesce(F.lag("hash").over(order), F.lit(-1)), "top": F.last("hash").over(whole), "first": F.first("node").over(whole)})
    inner = rows.select(*by, "lo", F.col("hash").alias("hi"), "node")
    wrap = rows.where("hash = top").select(*by, F.col("top").alias("lo"), F.lit(1 << 32).alias("hi"), F.col("first").alias("node"))
    return inner.union(wrap)


def route(keys: DataFrame, ring: DataFrame, key: str = "key", owner: str = "owner", by: list[str] | None = None, ring_hash=F.crc32) -> DataFrame:
    """keys with the node that owns each: the first ring point at or after the key's hash; null on an empty ring.

    Segments are posted under the top bits of the hashes they cover, so it is an equi-join with a range test; a ring has
    replicas * nodes segments, and Spark broadcasts them where they are small.
    """
    by = by or []
    shift = 32 - BUCKET_BITS
    parts = segments(ring, by).select(*[F.col(c).alias(f"_{c}") for c in by], "lo", "hi", F.col("node").alias(owner), F.explode(F.sequence(F.shiftright(F.col("lo") + 1, shift), F.shiftright(F.least("hi", F.lit((1 << 32) - 1)), shift))).alias("_b"))
    rows = keys.withColumn("_h", ring_hash(F.col(key)))
    on = (F.shiftright("_h", shift) == F.col("_b")) & (F.col("_h") > F.col("lo")) & (F.col("_h") <= F.col("hi"))
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return rows.join(parts, on, "left").drop("_h", "_b", "lo", "hi", *[f"_{c}" for c in by])


def rings(nodes: DataFrame, replicas: int = 50) -> DataFrame:
    """ring, hash, node of the read, write and shadow rings from nodes (addr, status); other statuses are in none."""
    names = F.lit(None).cast("array<string>")
    for status, of in RINGS.items():
        names = F.when(F.col("status") == status, F.array(*map(F.lit, of))).otherwise(names)
    members = nodes.select(F.explode(names).alias("ring"), F.col("addr").alias("node"), F.col("addr").alias("ord"))
    return points(members, replicas, ["ring"])


def pick(routed: DataFrame, me: str, reachable: Column, owner: str = "owner") -> DataFrame:
    """Adds ok and is_self: no owner for empty keys and empty rings; another node counts only where it can be reached."""
    mine = F.coalesce(F.col(owner) == me, F.lit(False))
    return routed.withColumns({"is_self": mine, "ok": (F.col("key") != "") & F.col(owner).isNotNull() & (mine | reachable)})


def node_status(events: DataFrame, now_ms: int, lease_ms: int = 10_000) -> DataFrame:
    """Latest status of each addr from events (addr, status, ts_ms) whose lease still holds; a node begins warming."""
    last = events.groupBy("addr").agg(F.max_by("status", "ts_ms").alias("status"), F.max("ts_ms").alias("seen"))
    return last.where(F.col("seen") + lease_ms > now_ms).select("addr", F.coalesce("status", F.lit("warming")).alias("status"))


def membership_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """addr and change (added, removed, kept) between two sets of nodes."""
    a, b = old.select("addr", F.lit(1).alias("was")).distinct(), new.select("addr", F.lit(1).alias("is")).distinct()
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("kept")
    return a.join(b, "addr", "full").select("addr", change.alias("change"))


def without(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes after a removal; their points follow from what is left."""
    return nodes.join(gone.select("node"), "node", "left_anti")


def moved(keys: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose owner differs between two rings: key, source, target."""
    both = route(route(keys, old, owner="source"), new, owner="target")
    return both.where("source <> target")


def load(routed: DataFrame, owner: str = "owner") -> DataFrame:
    return routed.groupBy(owner).agg(F.count("*").alias("keys"))
