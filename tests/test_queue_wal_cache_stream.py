"""Retry queue, log files, cache simulation, streaming."""

import struct

from pyspark.sql import functions as F

from tidekeep.functions import snowflake, snowflake_parts
from tidekeep.operators import cachesim, kv, retry
from tidekeep.schemas import StoreOptions
from tidekeep.sources import wal
from tidekeep.streaming import live


def test_queue(spark):
    ev = lambda *e: [("t", i, x, 1) for i, x in enumerate(e)]
    state = lambda *e: retry.settled(spark.createDataFrame(ev(*e), "id string, seq long, event string, attempt long"), 3).first()
    assert (state("nack").attempt, state("nack").state) == (2, "pending")
    assert state("nack", "nack", "nack").state == "dlq"
    assert state("nack", "ack").state == "done"
    again = state("nack", "nack", "nack", "requeue")
    assert (again.attempt, again.state) == (0, "pending")
    rows = spark.createDataFrame([("a", 0, "first", 1), ("a", 1, "second", 2), ("", 2, "x", 1)], "id string, seq long, value string, attempt int")
    assert [(r.value, r.attempt) for r in retry.enqueued(rows).collect()] == [("second", 2)]
    t = spark.createDataFrame([("a", "set", 5, None), ("b", "delete", 5, None), ("c", "set", 5, 20)], "id string, option string, next_run_at long, leased_until long")
    assert [retry.listed(t, 0, limit=2).count(), retry.listed(t, 0, "set").count(), retry.listed(t, 0, only_due=True).count()] == [2, 2, 0]
    assert [r.id for r in retry.due(t, 10).orderBy("id").collect()] == ["a", "b"]
    assert retry.due(t, 20).count() == 3
    q = spark.createDataFrame([(False, 0, None), (False, 5, 20), (True, 1, None)], "dlq boolean, created_at long, leased_until long")
    assert tuple(retry.stats(q, 10).first()) == (2, 1, 10, 1)
    j = spark.createDataFrame([('{"id": "x"}',), ("broken",)], "body string")
    assert [r.id for r in retry.parsed(j, "id string, attempt int").collect()] == ["x"]


def test_wal_files(spark, tmp_path):
    a = wal.frame(1, b"k", b"v", 0, 5, 0) + wal.frame(2, b"k", b"", 0, 6, 0)
    bad = bytearray(wal.frame(1, b"x", b"y", 0, 1, 0))
    bad[-1] ^= 1
    (tmp_path / "wal.log.20260101000000").write_bytes(a)
    (tmp_path / "wal.log").write_bytes(wal.frame(3, b"s", b"1", 0, 9, 0) + wal.frame(1, b"e", b"1", 5, 9, 50) + bytes(bad) + a)
    (tmp_path / "wal.log.20260102000000").write_bytes(wal.frame(1, b"z", "é".encode(), 7, 8, 500)[:-1])
    rows = wal.read(spark, str(tmp_path))
    assert rows.count() == 4
    snap = {r.key: r for r in wal.replayed(rows, 100).collect()}
    assert set(snap) == {"k"} and snap["k"].tombstone and snap["k"].version == 6
    assert [r.key for r in wal.retries(rows, 100).collect()] == ["s"]
    assert wal.frame(1, b"k", b"v", 0, 5, 0)[4:11] == struct.pack("<BHI", 1, 1, 1)


def trace(spark, keys):
    rows = [(i, "get", k, 62 + len(k), 0, 0) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "seq long, op string, key string, size long, ts long, ttl long")


def test_lru2_promotes(spark):
    r = cachesim.simulate(trace(spark, ["foo", "foo", "foo"]), StoreOptions("lru2", 10_000, 1)).first()
    assert (r.gets, r.misses, r.hits, r.promotions, r.resident) == (3, 1, 2, 1, 1)
    s = cachesim.Store(StoreOptions("lru2", 200, 1))
    s.set("a", 90, 0), s.set("b", 90, 0), s.set("c", 90, 0)
    assert not s.get("a", 0) and s.get("b", 0) and s.counts["evictions"] == 1
    s = cachesim.Store(StoreOptions("lru", 200, 1))
    s.set("a", 90, 0), s.set("b", 90, 0), s.get("a", 0), s.set("c", 90, 0)
    assert s.get("a", 0) and not s.get("b", 0)
    s.set("t", 10, 5)
    assert not s.get("t", 5) and s.counts["expirations"] == 1
    s.delete("c")
    assert not s.get("c", 0)


def test_store_rules(spark):
    s = cachesim.Store(StoreOptions("no such kind", 10, 1, clean_us=100))
    for k in range(50):
        s.set(f"k{k}", 90, 0)
    assert len(s) == 50 and s.counts["evictions"] == 0
    s.set("late", 1, 5, 5), s.set("early", 1, 5, 4)
    assert len(s) == 51 and s.scan(4)[-1] == ("early", 5) and len(s.scan(5)) == 50
    s.pass_time(4), s.pass_time(99)
    assert len(s) == 51
    s.pass_time(100)
    assert len(s) == 50 and s.counts["expirations"] == 1
    s.clear()
    assert len(s) == 0 and s.summary()["used"] == 0
    s = cachesim.Store(StoreOptions("lru2", 1000, 1))
    s.set("a", 9, 70), s.get("a", 0), s.set("b", 9, 0)
    assert s.scan(10) == [("b", 0), ("a", 70)]
    rows = [(i, "set", f"k{i}", 9, 10, t) for i, t in enumerate([0, 5, -3, 100, 7])] + [(9, "get", "k0", 9, 10, 0)]
    made = spark.createDataFrame(rows, "seq long, op string, key string, size long, ts long, ttl long")
    found = lambda *a: [(r.key, r.ttl_us) for r in cachesim.scan(made, StoreOptions("lru2", 10_000, 4), 15, *a).collect()]
    assert found() == [("k0", 0), ("k3", 95), ("k4", 2)] and found("k0", 1) == [("k3", 95)]


def test_lru_against_a_list(spark):
    """A trace with sets, deletes and ends, against a list of entries from the oldest to the newest."""
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice(["get", "get", "set", "delete"]), f"k{rng.randrange(30)}", rng.randrange(10, 60), 10 * i, rng.choice([0, 0, 300])) for i in range(1500)]
    entries, hits, evicted = [], 0, 0
    for _, op, key, size, ts, ttl in rows:
        at = next((n for n, e in enumerate(entries) if e[0] == key), None)
        end = ts + ttl if ttl else 0
        if op == "delete":
            entries = [e for e in entries if e[0] != key]
            continue
        if op == "get":
            if at is not None and not (entries[at][2] and entries[at][2] <= ts):
                hits += 1
                entries.append(entries.pop(at))
                continue
            if at is not None:
                entries.pop(at)
                at = None
        fresh = at is None
        if not fresh:
            entries.pop(at)
        entries.append((key, size, end))
        while fresh and sum(e[1] for e in entries) > 400:
            entries.pop(0)
            evicted += 1
    made = spark.createDataFrame(rows, "seq long, op string, key string, size long, ts long, ttl long")
    r = cachesim.simulate(made, StoreOptions("lru", 400, 1)).first()
    assert (r.hits, r.evictions, r.resident, r.used) == (hits, evicted, len(entries), sum(e[1] for e in entries))


def test_snowflake(spark):
    r = spark.range(5).select(snowflake(F.lit(1767225600123), F.lit(7), F.col("id")).alias("v"))
    assert [tuple(x) for x in r.select(*snowflake_parts(F.col("v"))).collect()] == [(1767225600123, 7, i) for i in range(5)]


def test_stream_equals_batch(spark, tmp_path):
    ops = spark.range(400).selectExpr("id as seq", "cast(id % 7 as string) as key", "id * 7919 % 101 as version", "id * 1000 as ts", "50000L as ttl", "id % 5 = 0 as tombstone")
    ops.where("seq < 200").coalesce(1).write.parquet(str(tmp_path / "in"))
    ops.where("seq >= 200").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.write_view(live.live_view(stream), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    accepted = spark.read.parquet(str(tmp_path / "out/accepted"))
    late = spark.read.parquet(str(tmp_path / "out/late"))
    assert accepted.count() + late.count() == 400 and late.count() > 0
    last = accepted.groupBy("key").agg(F.max_by(F.struct("seq", "version", "exp", "tombstone"), "seq").alias("w")).select("key", "w.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, kv.ttl_fold(ops).select("key", "seq", "version", "exp", "tombstone").collect()))
