"""The retry queue: tasks by id, leases, back-off, dead letters. Times are microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekeep.functions import backoff_bounds


def enqueued(tasks: DataFrame, now: Column | int = 0) -> DataFrame:
    """The queue after enqueues (id, seq, ...): the last of an id wins; a missing created_at or next_run_at is now."""
    now = F.lit(now) if isinstance(now, int) else now
    rest = [c for c in tasks.columns if c != "id"]
    out = tasks.where(F.coalesce("id", F.lit("")) != "").groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("t")).select("id", *[F.col(f"t.{c}").alias(c) for c in rest])
    return out.withColumns({c: F.coalesce(c, now) for c in ("created_at", "next_run_at") if c in rest})


def due(tasks: DataFrame, now: int) -> DataFrame:
    """Tasks to deliver: due, and not leased beyond now."""
    return tasks.where((F.col("next_run_at") <= now) & (F.col("leased_until").isNull() | (F.col("leased_until") <= now)))


def leased(tasks: DataFrame, now: int, lease_us: int = 30_000_000) -> DataFrame:
    return due(tasks, now).withColumn("leased_until", F.lit(now + lease_us))


def settled(events: DataFrame, attempts: int = 10) -> DataFrame:
    """State of each task after its events (id, seq, event: ack, nack, dlq or requeue; attempt: as enqueued).

    Nacks since the last requeue count; one beyond `attempts` makes a dead letter, an ack removes the task. Built from
    aggregates alone, so a task may have any number of events.
    """
    base = events.groupBy("id").agg(F.max(F.when(F.col("event") == "requeue", F.col("seq"))).alias("again"), F.min("attempt").alias("first"))
    rows = events.join(base, "id").where(F.col("again").isNull() | (F.col("seq") > F.col("again")))
    sums = rows.groupBy("id").agg(F.count_if(F.col("event") == "nack").alias("nacks"), F.max((F.col("event") == "ack").cast("int")).alias("acked"), F.max((F.col("event") == "dlq").cast("int")).alias("dead"))
    out = base.join(sums, "id", "left").withColumn("attempt", F.when(F.col("again").isNull(), F.col("first")).otherwise(0) + F.coalesce("nacks", F.lit(0)))
    state = F.when(F.coalesce("acked", F.lit(0)) == 1, "done").when((F.coalesce("dead", F.lit(0)) == 1) | (F.col("attempt") > attempts), "dlq").otherwise("pending")
    low, high = backoff_bounds(F.col("attempt"))
    return out.select("id", "attempt", state.alias("state"), F.when(state == "pending", low).alias("wait_from_ms"), F.when(state == "pending", high).alias("wait_to_ms"))


def listed(tasks: DataFrame, now: int, option: str | None = None, only_due: bool = False, leased: bool | None = None, limit: int = 100) -> DataFrame:
    """A page of tasks in id order, by option, whether due, and whether leased."""
    out = tasks
    if option:
        out = out.where(F.col("option") == option)
    if only_due:
        out = out.where(F.col("next_run_at") <= now)
    if leased is not None:
        held = F.col("leased_until").isNotNull() & (F.col("leased_until") >= now)
        out = out.where(held if leased else ~held)
    return out.orderBy("id").limit(limit)


def stats(tasks: DataFrame, now: int) -> DataFrame:
    """Pending (leased ones too), in flight, the oldest age, and dead letters, from tasks with dlq (boolean)."""
    open_ = ~F.col("dlq")
    return tasks.agg(
        F.count_if(open_).alias("pending"), F.count_if(open_ & (F.col("leased_until") > now)).alias("in_flight"), F.max(F.when(open_, F.lit(now) - F.col("created_at"))).alias("oldest_age"), F.count_if(F.col("dlq")).alias("dlq")
    )


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Tasks from JSON lines (id, body), without corrupt ones."""
    return lines.select(F.from_json("body", schema).alias("t"), "body").where(F.col("t.id").isNotNull()).select("t.*")


def dead_letters(tasks: DataFrame) -> DataFrame:
    """Dead letters in id order."""
    return tasks.where("dlq").orderBy("id")


def requeued(tasks: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """The queue after dead letters with these ids are put back: attempt 0, no error, no lease, due now. Others stay."""
    back = tasks.join(ids.select("id", F.lit(True).alias("_back")).distinct(), "id", "left")
    hit = F.col("dlq") & F.coalesce("_back", F.lit(False))
    changed = {"attempt": F.lit(0), "last_err": F.lit(None).cast("string"), "leased_until": F.lit(None).cast("long"), "next_run_at": F.lit(now).cast("long"), "dlq": F.lit(False)}
    return back.withColumn("_hit", hit).withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changed.items() if c in tasks.columns}).drop("_hit", "_back")


def dispatch(stream: DataFrame, deliver, checkpoint: str):
    """A query that hands the due tasks of each batch to deliver(DataFrame), which must bear repeats: a batch may come twice."""

    def each(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("seen_at")).first()[0]
        if now is not None:
            deliver(due(enqueued(batch), now))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
