"""Rebalance: which keys move, in what batches, how far a transfer has come, and who may run it."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidekeep.operators import kv, ring


def tasks(nodes: DataFrame, me: str, epoch: int) -> DataFrame:
    """Transfers of an active node when others warm up: to every other node of the coming ring. None without warming ones."""
    future = nodes.where("status in ('active', 'warming')")
    counts = nodes.agg(F.count_if(F.col("status") == "warming").alias("warm"), F.count_if((F.col("addr") == me) & (F.col("status") == "active")).alias("own"))
    some = future.where(F.col("addr") != me).join(F.broadcast(counts.where("warm > 0 and own > 0")))  # one row
    return some.select(F.concat(F.lit(f"{epoch}:{me}->"), F.col("addr")).alias("task_id"), F.lit(me).alias("source"), F.col("addr").alias("target"))


def plan(snapshot: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries that change owner, with source and target."""
    return ring.moved(snapshot, old, new)


def batches(moves: DataFrame, size: int = 256, by: str = "target") -> DataFrame:
    """Moves with their batch number (from 1) for each target, in key order; no target's rows are gathered in one task."""
    return kv.numbered(moves, [F.col("key")], within=by).withColumn("batch", F.ceil(F.col("rank") / size))


def progress(batched: DataFrame, by: str = "target") -> DataFrame:
    """Per target and batch: the last key and how many rows are copied so far."""
    each = batched.groupBy(by, "batch").agg(F.max("key").alias("last_key"), F.count("*").alias("rows"))
    return each.withColumn("copied", F.sum("rows").over(Window.partitionBy(by).orderBy("batch"))).drop("rows")


def resume(snapshot: DataFrame, saved: DataFrame, by: str = "target") -> DataFrame:
    """Moves still to send: keys after the last one saved (task rows by target: last_key)."""
    return snapshot.join(saved.select(by, "last_key"), by, "left").where(F.col("last_key").isNull() | (F.col("key") > F.col("last_key"))).drop("last_key")


def owned(snapshot: DataFrame, write_ring: DataFrame, me: str) -> DataFrame:
    """What a node keeps after collecting entries that others own; an empty ring collects nothing."""
    return ring.route(snapshot, write_ring).where(F.col("owner").isNull() | (F.col("owner") == me))


def collectable(snapshot: DataFrame, write_ring: DataFrame, me: str) -> DataFrame:
    return ring.route(snapshot, write_ring).where(F.col("owner") != me)


def may_collect(state: DataFrame, now_ms: int, grace_ms: int = 300_000) -> DataFrame:
    """Whether garbage may be collected: stable, and for longer than the grace."""
    return state.withColumn("can_gc", (F.col("state") == "stable") & (F.lit(now_ms) - F.col("updated_ms") > grace_ms))


def may_continue(state: DataFrame, me: str, epoch: int) -> DataFrame:
    return state.withColumn("go_on", (F.col("state") == "migrating") & (F.col("owner") == me) & (F.col("epoch") == epoch))


def _step(state: tuple[bool, int, bool, str], action: str, addr: str, epoch: int) -> tuple[tuple[bool, int, bool, str], str]:
    """State (migrating, epoch, pending, owner) after one request, and its result; errors leave the state as it is."""
    migrating, at, pending, owner = state
    if action == "start":
        return (state, "rejected") if migrating else ((True, at + 1, False, addr), "started")
    if action not in ("pending", "finish"):
        return state, "unknown action"
    if not migrating:
        return state, "not migrating"
    if action == "pending":
        return (True, at, True, owner), "pending"
    if owner != addr:
        return state, "wrong owner"
    if at != epoch:
        return state, "wrong epoch"
    return (False, at, False, ""), "finished, again" if pending else "finished"


def state_machine(requests: DataFrame, by: str = "cluster") -> DataFrame:
    """Results of requests (cluster, seq, action, addr, epoch) on each cluster's state, in order: a compare-and-swap log.

    A pass over rows sorted by cluster and seq: one state is held, whatever the length of a cluster's log.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (False, 0, False, "")
        cluster, state, begun = None, first, False
        for b in batches:
            out = []
            for c, action, addr, epoch in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if not begun or c != cluster:
                    cluster, state, begun = c, first, True
                state, result = _step(state, action, addr, epoch)
                out.append((result, state[1], state[0], state[2], state[3]))
            results, epochs, migrating, pending, owner = zip(*out, strict=True) if out else ((),) * 5
            columns = [pa.array(results, pa.string()), pa.array(epochs, pa.int64()), pa.array(migrating, pa.bool_()), pa.array(pending, pa.bool_()), pa.array(owner, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], [by, "seq", "result", "epoch", "migrating", "pending", "owner"])

    rows = requests.select(by, F.col("seq").cast("long").alias("seq"), "action", "addr", F.col("epoch").cast("long").alias("epoch"))
    kind = rows.schema[by].dataType.simpleString()
    return rows.repartition(by).sortWithinPartitions(by, "seq", "action", "addr", "epoch").mapInArrow(run, f"`{by}` {kind}, seq long, result string, epoch long, migrating boolean, pending boolean, owner string")


def activated(nodes: DataFrame) -> DataFrame:
    """Nodes after a successful migration: warming ones are active."""
    return nodes.withColumn("status", F.when(F.col("status") == "warming", "active").otherwise(F.col("status")))


def push(snapshot: DataFrame, future: DataFrame, me: str, size: int = 256) -> DataFrame:
    """Everything a node sends when it hands over by a future ring: rows with target and batch; its own rows stay."""
    routed = ring.route(snapshot, future, owner="target")
    return batches(routed.where(F.col("target").isNotNull() & (F.col("target") != me)), size)


def pull(snapshot: DataFrame, future: DataFrame, asking: str, size: int = 256) -> DataFrame:
    """What a node gets when it asks another for its share by the future ring, in batches; no cap on rows."""
    routed = ring.route(snapshot, future, owner="target")
    return batches(routed.where(F.col("target") == asking), size)
