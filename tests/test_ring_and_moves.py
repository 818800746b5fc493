"""Hash ring, Bloom filter, migration, state machine."""

import zlib

from pyspark.sql import functions as F

from tidekeep.functions import fnv1_32
from tidekeep.operators import bloom, migrate, ring


def nodes(spark, *names):
    return spark.createDataFrame([(f"node-{n}", k) for k, n in enumerate(names)], "node string, ord int")


def keys(spark, n=10_000):
    return spark.range(n).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"))


def test_movement_and_spread(spark):
    moved = ring.moved(keys(spark), ring.points(nodes(spark, *"abc")), ring.points(nodes(spark, *"abcd")))
    assert moved.count() == 2230
    assert {r.target for r in moved.select("target").distinct().collect()} == {"node-d"}
    for replicas, spread in ((1, 4055), (50, 578)):
        load = ring.load(ring.route(keys(spark), ring.points(nodes(spark, *"abcde"), replicas)))
        assert load.agg(F.max("keys") - F.min("keys")).first()[0] == spread


def test_route_against_bisect(spark):
    import bisect

    points = sorted((zlib.crc32(f"{i}-node-{n}".encode()), f"node-{n}") for n in "abc" for i in range(50))
    hashes = [h for h, _ in points]
    for r in ring.route(keys(spark, 2000), ring.points(nodes(spark, *"abc"))).collect():
        assert r.owner == points[bisect.bisect_left(hashes, zlib.crc32(r.key.encode())) % len(points)][1]


def test_empty_ring(spark):
    empty = ring.points(nodes(spark, *"a").where("ord > 5"))
    assert ring.route(keys(spark, 5), empty).where("owner is null").count() == 5
    assert migrate.owned(keys(spark, 5), empty, "node-a").count() == 5
    assert migrate.collectable(keys(spark, 5), empty, "node-a").count() == 0


def test_status_rings(spark):
    for status, want in (("active", {"read": 100, "write": 100, "shadow": 100}), ("warming", {"read": 50, "write": 50, "shadow": 100}), ("draining", {"read": 100, "write": 50, "shadow": 50})):
        rows = ring.rings(spark.createDataFrame([("127.0.0.1:8001", "active"), ("127.0.0.1:8002", status)], "addr string, status string"))
        assert {r.ring: r["count"] for r in rows.groupBy("ring").count().collect()} == want


def test_fnv(spark):
    def model(b):
        h = 2166136261
        for x in b:
            h = (h * 16777619 & 0xFFFFFFFF) ^ x
        return h

    words = ["", "a", "hello", "é", "日本"]
    rows = spark.createDataFrame([(w,) for w in words], "k string").select("k", fnv1_32(F.col("k")).alias("h")).collect()
    assert {r.k: r.h for r in rows} == {w: model(w.encode()) for w in words}


def test_bloom(spark):
    assert bloom.parameters(1000, 0.01) == (9585, 6)
    known = keys(spark, 1000)
    f = bloom.build(known, 9585, 6)
    assert bloom.may_exist(known, f, 9585, 6).where("not may_exist").count() == 0
    other = spark.range(3000).select(F.concat(F.lit("other-"), F.col("id").cast("string")).alias("key"))
    assert bloom.may_exist(other, f, 9585, 6).where("may_exist").count() < 90


def run(spark, *steps):
    rows = [(1, i, a, who, e) for i, (a, who, e) in enumerate(steps)]
    got = migrate.state_machine(spark.createDataFrame(rows, "cluster int, seq long, action string, addr string, epoch long")).orderBy("seq").collect()
    return [(r.result, r.epoch) for r in got]


def test_state_machine(spark):
    flow = run(spark, ("start", "A", 0), ("start", "B", 0), ("pending", "B", 0), ("finish", "A", 1), ("start", "A", 0), ("finish", "A", 2))
    assert flow == [("started", 1), ("rejected", 1), ("pending", 1), ("finished, again", 1), ("started", 2), ("finished", 2)]
    assert run(spark, ("start", "A", 0), ("finish", "B", 1), ("finish", "A", 999), ("finish", "A", 1)) == [("started", 1), ("wrong owner", 1), ("wrong epoch", 1), ("finished", 1)]
    assert [r for r, _ in run(spark, *[("start", x, 0) for x in "ABC"])] == ["started", "rejected", "rejected"]
    assert run(spark, ("finish", "A", 0), ("x", "A", 0)) == [("not migrating", 0), ("unknown action", 0)]


def test_gc_gate(spark):
    rows = [("stable", 1_000_000, 1), ("stable", 400_000, 2), ("migrating", 400_000, 3)]
    state = spark.createDataFrame(rows, "state string, updated_ms long, n int")
    assert [r.can_gc for r in migrate.may_collect(state, 1_000_000).orderBy("n").collect()] == [False, True, False]


def test_batches(spark):
    moves = keys(spark, 700).withColumn("target", F.lit("t"))
    p = migrate.progress(migrate.batches(moves)).orderBy("batch").collect()
    assert [r.copied for r in p] == [256, 512, 700]
    saved = migrate.progress(migrate.batches(moves)).where("batch = 2")
    assert migrate.resume(moves, saved).count() == 188


def test_tasks_need_warming_nodes(spark):
    rows = spark.createDataFrame([("a", "active"), ("b", "active")], "addr string, status string")
    assert migrate.tasks(rows, "a", 1).count() == 0
    assert migrate.tasks(rows.union(spark.createDataFrame([("c", "warming")], rows.schema)), "a", 1).count() == 2
