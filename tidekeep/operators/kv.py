"""Versioned key-value state from an operation log: folds, scans, reads.

An operation log has seq, key, value, version and tombstone; with time, also ts (microseconds) and ttl (0: none).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidekeep.functions import SEQUENCE_BITS, live, remaining_ms, snowflake
from tidekeep.sources.shared import stored

#: Operations of a key beyond which its history isn't held as one array.
HOT = 100_000


def lww_snapshot(ops: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The last write of each key: the highest version, of equal ones the latest. Tombstones stay as rows.

    A max_by aggregate: rows are combined before the shuffle, so a key may have any number of operations.
    """
    by = by or ["key"]
    rest = [c for c in ops.columns if c not in by]
    top = ops.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("version", "seq")).alias("w"))
    return top.select(*by, *[F.col(f"w.{c}").alias(c) for c in rest])


def batch_merge(snapshot: DataFrame, batch: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A snapshot after a batch of entries: an entry wins only with a higher version, of equal ones the first stays."""
    by = by or ["key"]
    rows = snapshot.withColumn("_at", F.lit(0)).unionByName(batch.withColumn("_at", F.lit(1)))
    rest = [c for c in rows.columns if c not in [*by, "_at"]]
    top = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("version", -F.col("_at"), -F.col("seq"))).alias("w"))
    return top.select(*by, *[F.col(f"w.{c}").alias(c) for c in rest])


def stale_writes(ops: DataFrame) -> DataFrame:
    """Operations that a guard rejects: an earlier one of their key had a higher version (no expiry)."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return ops.withColumn("newest", F.max("version").over(before)).where("version < newest")


def _fold(ops: DataFrame) -> DataFrame:
    step = """aggregate(array_sort(collect_list(struct(seq, version, ts, ttl, tombstone, strict))),
        named_struct('seq', -1L, 'version', -1L, 'exp', 0L, 'tombstone', false),
        (a, x) -> if(a.seq >= 0 and (a.exp = 0 or a.exp > x.ts) and (x.version < a.version or x.strict and x.version = a.version), a,
            named_struct('seq', x.seq, 'version', x.version, 'exp', if(x.ttl > 0, x.ts + x.ttl, 0L), 'tombstone', x.tombstone)))"""
    return ops.groupBy("key").agg(F.expr(step).alias("w")).select("key", "w.*")


def _stream_fold(ops: DataFrame) -> DataFrame:
    """The same fold, as a pass over rows sorted by key and seq: one state is held, whatever the key's history."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done = []
            for k, seq, version, ts, ttl, dead, strict in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key or state is None:
                    if state is not None:
                        done.append((key, *state))
                    key, state = k, None
                if state is None or not ((state[2] == 0 or state[2] > ts) and (version < state[1] or strict and version == state[1])):
                    state = (seq, version, ts + ttl if ttl > 0 else 0, dead)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done])
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (key, *state), strict=True))])

    names = ["key", "seq", "version", "exp", "tombstone"]
    rows = ops.select("key", "seq", "version", "ts", "ttl", "tombstone", "strict")
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, "key string, seq long, version long, exp long, tombstone boolean")


def ttl_fold(ops: DataFrame, hot: int = HOT) -> DataFrame:
    """Last accepted write of each key in log order, where an expired entry no longer guards its version.

    A set or delete of an equal version is accepted, an entry of a batch (column `batch`, if there is one) only with a higher
    one; a write that has ended on arrival (a negative ttl) changes nothing.  Keys with more than `hot` operations (at most
    one in `hot` of all rows) are folded as a stream instead of an array.
    """
    strict = F.coalesce(F.col("batch"), F.lit(False)) if "batch" in ops.columns else F.lit(False)
    rows = ops.where(F.coalesce("ttl", F.lit(0)) >= 0).select("key", "seq", "version", "ts", "ttl", "tombstone", strict.alias("strict"))
    many = rows.groupBy("key").count().where(F.col("count") > hot).select("key")
    return _fold(rows.join(many, "key", "left_anti")).unionByName(_stream_fold(rows.join(many, "key", "left_semi")))


def alive(folded: DataFrame, now: int) -> DataFrame:
    """Entries of a fold (exp: 0 for none) that live at now, with the milliseconds left."""
    exp = F.when(F.col("exp") > 0, F.col("exp"))
    return folded.where(live(exp, F.lit(now))).withColumn("ttl_ms", remaining_ms(exp, F.lit(now)))


def scan_page(snapshot: DataFrame, start: str = "", count: int = 0) -> DataFrame:
    """Keys after start (exclusive; "" from the first) in byte order, tombstones included; count 0 or less: all."""
    page = snapshot.where(F.col("key") > start) if start else snapshot
    page = page.orderBy("key")
    return page.limit(count) if count > 0 else page


def numbered(rows: DataFrame, keys: list[Column], within: str | None = None) -> DataFrame:
    """rows with rank (from 1) in the order of keys, for each value of `within`; rows of equal keys in any order.

    Rows are sorted across the cluster and written once, each with its place (partition and row in it), so that the counts
    and the ranks come from the same partitions.  The counts, a few rows a partition, make the ranks: no task holds a group.
    """
    order = [F.col(within), *keys] if within else keys
    placed = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    groups = [F.col(within).alias("_of")] if within else [F.lit(0).alias("_of")]
    counts = placed.groupBy(*groups, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # a row for each partition and group in it
    before = Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).select("_of", F.col("_part").alias("_in"), "_offset")
    same = F.col(within).eqNullSafe(F.col("_of")) if within else F.lit(True)
    return placed.join(offsets, (part == F.col("_in")) & same).withColumn("rank", F.col("_at") + F.col("_offset")).drop("_at", "_of", "_in", "_offset")


def pages(snapshot: DataFrame, page: int = 256) -> DataFrame:
    """Each key with its page number (from 1), as a chain of scans of `page` rows would see it."""
    return numbered(snapshot, [F.col("key")]).withColumn("page", F.ceil(F.col("rank") / page))


def read_through(keys: DataFrame, snapshot: DataFrame, origin: DataFrame) -> DataFrame:
    """Each asked key with its value and where it came from: cache, origin, deleted (a tombstone hides it), or miss."""
    cached = snapshot.select("key", F.col("value").alias("cached"), F.col("tombstone").alias("dead"), F.lit(True).alias("here"))
    loaded = origin.select("key", F.col("value").alias("loaded"), F.lit(True).alias("there"))
    found = keys.join(cached, "key", "left").join(loaded, "key", "left")
    source = F.when(F.col("key") == "", "error").when(F.col("dead"), "deleted").when(F.col("here"), "cache").when(F.col("there"), "origin").otherwise("miss")
    out = found.withColumn("source", source)
    return out.withColumn("value", F.when(F.col("source") == "cache", F.col("cached")).when(F.col("source") == "origin", F.col("loaded"))).drop("cached", "loaded", "dead", "here", "there")


def backfill(read: DataFrame, now: int, keep_us: int, first_version: int) -> DataFrame:
    """Entries that a read-through stores: loaded values with an expiry and generated versions."""
    rows = read.where("source = 'origin'").select("key", "value").distinct()
    return numbered(rows, [F.col("key")]).select("key", "value", (F.lit(first_version - 1) + F.col("rank")).alias("version"), F.lit(now + keep_us).alias("exp"), F.lit(False).alias("tombstone"))


def negative(keys: DataFrame, snapshot: DataFrame, origin: DataFrame, now: int, keep_us: int) -> DataFrame:
    """Keys that neither the cache nor the origin has: rows to remember as absent until exp."""
    absent = keys.select("key").distinct().join(snapshot, "key", "left_anti").join(origin, "key", "left_anti")
    return absent.withColumn("exp", F.lit(now + keep_us))


def removed(snapshot: DataFrame, keys: DataFrame) -> DataFrame:
    """A snapshot after physical deletes, without tombstones."""
    return snapshot.join(keys.select("key").distinct(), "key", "left_anti")


def outcomes(ops: DataFrame) -> DataFrame:
    """Each request with the code that it returns: key required, value required, stale (silent for set), or ok."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max("version").over(before)
    code = F.when(F.coalesce("key", F.lit("")) == "", "key required").when((F.col("op") == "set") & F.col("value").isNull(), "value required")
    code = code.when((newest > F.col("version")) & (F.col("op") == "delete"), "false").when(newest > F.col("version"), "ignored").otherwise("ok")
    return ops.withColumn("outcome", code)


def dedupe_loads(calls: DataFrame) -> DataFrame:
    """Calls (key, start, finish) that share a load: overlapping calls of a key are one flight. Per key: calls, loads, shared."""
    before = Window.partitionBy("key").orderBy("start", "finish").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.col("start") > F.max("finish").over(before), F.lit(True))
    flights = calls.withColumn("lead", first.cast("long"))
    return flights.groupBy("key").agg(F.count("*").alias("calls"), F.sum("lead").alias("loads"), (F.count("*") - F.sum("lead")).alias("shared"))


def peak_concurrency(calls: DataFrame, by: str, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Most calls at once for each `by`: a sweep over starts and ends, cut into time buckets so a hot group splits."""
    edges = calls.select(by, F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct((F.col("finish")).alias("t"), F.lit(-1).alias("d")))).alias("e")).select(by, "e.t", "e.d")
    edges = edges.withColumn("slot", F.floor(F.col("t") / bucket_us))
    totals = edges.groupBy(by, "slot").agg(F.sum("d").alias("net"))
    open_ = Window.partitionBy(by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("base", F.coalesce(F.sum("net").over(open_), F.lit(0))).drop("net")
    inside = edges.withColumn("run", F.sum("d").over(Window.partitionBy(by, "slot").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(base, [by, "slot"]).groupBy(by).agg(F.max(F.col("base") + F.col("run")).alias("peak"))


def get_many(keys: DataFrame, snapshot: DataFrame, maybe: DataFrame | None = None) -> DataFrame:
    """Each asked key with its value and outcome: key required, absent (a Bloom filter rules it out), no key, or ok.

    maybe: key and may_exist, from bloom.may_exist.
    """
    found = keys.join(snapshot.select("key", "value", "version", F.col("tombstone").alias("dead")), "key", "left")
    found = found.join(maybe, "key", "left") if maybe is not None else found.withColumn("may_exist", F.lit(True))
    gone = F.col("version").isNull() | F.coalesce("dead", F.lit(False))
    code = F.when(F.col("key") == "", "key required").when(~F.coalesce("may_exist", F.lit(True)), "absent").when(gone, "no key").otherwise("ok")
    return found.select("key", F.when(code == "ok", F.col("value")).alias("value"), code.alias("outcome"))


def read_owned(keys: DataFrame, caches: DataFrame, origin: DataFrame, me: str) -> DataFrame:
    """Reads at one node: its own cache, else the owner's (keys: key, owner), else the origin. caches: node, key, value, tombstone.

    A peer's tombstone or miss falls back to the origin, as a failed call does.
    """
    own = caches.where(F.col("node") == me).select("key", F.col("value").alias("mine"), F.col("tombstone").alias("dead"), F.lit(True).alias("here"))
    peer = caches.where((F.col("node") != me) & ~F.col("tombstone")).select(F.col("node").alias("owner"), "key", F.col("value").alias("theirs"), F.lit(True).alias("there"))
    found = keys.join(own, "key", "left").join(peer, ["owner", "key"], "left").join(origin.select("key", F.col("value").alias("loaded"), F.lit(True).alias("last")), "key", "left")
    source = F.when(F.col("dead"), "deleted").when(F.col("here"), "local").when(F.col("there"), "peer").when(F.col("last"), "origin").otherwise("miss")
    out = found.withColumn("source", source)
    value = F.when(F.col("source") == "local", F.col("mine")).when(F.col("source") == "peer", F.col("theirs")).when(F.col("source") == "origin", F.col("loaded"))
    return out.select("key", "owner", "source", value.alias("value"))


def generated(rows: DataFrame, order: str = "seq") -> DataFrame:
    """rows (ms, worker) with a version each, in the given order: a sequence number within the worker's millisecond.

    A worker that has used up a millisecond's 4096 numbers waits for the next one, and a clock that falls back waits for the
    last one: places are numbered on, and a place is the greater of the row's own time and the one after the last place.
    """
    each = 1 << SEQUENCE_BITS
    number = F.row_number().over(Window.partitionBy("worker").orderBy(order))
    ahead = Window.partitionBy("worker").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_n", number).withColumn("_place", F.max(F.col("ms") * each - F.col("_n")).over(ahead) + F.col("_n"))
    return placed.withColumn("version", snowflake(F.floor(F.col("_place") / each), F.col("worker"), F.pmod("_place", F.lit(each)))).drop("_n", "_place")


def request_rows(ops: DataFrame, shadow: DataFrame) -> DataFrame:
    """Rows that a write sends: one to its owner, one to the shadow owner where it is another node. ops: key, writer; shadow: key, shadow."""
    both = ops.join(shadow.select("key", "shadow").distinct(), "key", "left")
    targets = F.filter(F.array(F.struct(F.lit("owner").alias("kind"), F.col("writer").alias("node")), F.struct(F.lit("shadow").alias("kind"), F.col("shadow").alias("node"))), lambda t: (t["kind"] == "owner") | (t["node"].isNotNull() & (t["node"] != F.col("writer"))))
    return both.select("*", F.explode(targets).alias("t")).select("*", "t.kind", "t.node").drop("t", "shadow")


def write_owned(rows: DataFrame, path: str, by: str = "owner", page: int = 256) -> None:
    """Writes a snapshot for each owner into a folder of its own; files hold `page` pages of 256 rows at most."""
    rows.repartition(by).sortWithinPartitions(by, "key").write.mode("overwrite").option("maxRecordsPerFile", 256 * page).partitionBy(by).parquet(path)
