"""Folds, scans and reads, on the fixtures and against a sequential model."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidekeep.operators import kv, migrate
from tidekeep.sources.shared import stored

OPS = "seq long, key string, value string, version long, tombstone boolean, ts long, ttl long"


def log(spark, *rows):
    full = [(i, k, v, n, d, 1_000 * i, 0) for i, (k, v, n, d) in enumerate(rows)]
    return spark.createDataFrame(full, OPS)


@pytest.mark.parametrize(
    "rows, version, dead",
    [
        ([("k", "new", 20, False), ("k", "old", 10, False)], 20, False),
        ([("k", "value", 10, False), ("k", None, 20, True)], 20, True),
        ([("k", None, 20, True)], 20, True),
        ([("k", None, 20, True), ("k", "old", 10, False)], 20, True),
        ([("k", "value", 100, False), ("k", None, 50, True)], 100, False),
    ],
)
def test_last_write_wins(spark, rows, version, dead):
    r = kv.lww_snapshot(log(spark, *rows)).collect()
    assert [(x.version, x.tombstone) for x in r] == [(version, dead)]
    r = kv.ttl_fold(log(spark, *rows)).collect()
    assert [(x.version, x.tombstone) for x in r] == [(version, dead)]


def test_ties(spark):
    rows = log(spark, ("k", "a", 5, False), ("k", "b", 5, False))
    assert kv.lww_snapshot(rows).first().value == "b"
    own = rows.select("key", "seq", "value", "version", "tombstone")
    assert kv.batch_merge(own.where("seq = 0"), own.where("seq = 1")).first().value == "a"


def model(rows):
    state = {}
    for seq, key, _, version, dead, ts, ttl in rows:
        old = state.get(key)
        if old and (old[2] == 0 or old[2] > ts) and version < old[1]:
            continue
        state[key] = (seq, version, ts + ttl if ttl else 0, dead)
    return state


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ttl_fold_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"k{rng.randrange(12)}", None, rng.randrange(40), rng.random() < 0.3, 100 * i, rng.choice([0, 300, 5000])) for i in range(600)]
    ops = spark.createDataFrame(rows, OPS)
    for hot in (10**6, 55, 0):
        got = {r.key: (r.seq, r.version, r.exp, r.tombstone) for r in kv.ttl_fold(ops, hot).collect()}
        assert got == model(rows)


def test_expiry_frees_the_version(spark):
    rows = [(0, "k", "v", 20, True, 0, 300), (1, "k", "old", 10, False, 400, 0)]
    assert kv.ttl_fold(spark.createDataFrame(rows, OPS)).first().version == 10


def test_scan(spark):
    snap = spark.createDataFrame([("b",), ("a",), ("c",)], "key string")
    assert [r.key for r in kv.scan_page(snap, "a", 2).collect()] == ["b", "c"]
    assert [r.key for r in kv.scan_page(snap).collect()] == ["a", "b", "c"]


def test_alive_boundary(spark):
    folded = spark.createDataFrame([("a", 100), ("b", 101), ("c", 0)], "key string, exp long")
    assert sorted(r.key for r in kv.alive(folded, 100).collect()) == ["b", "c"]


def test_numbered_ranks_every_row(spark):
    rows = spark.range(1000).selectExpr("case id % 4 when 3 then null else cast(id % 4 as string) end as g", "id as key")
    got = kv.numbered(rows, [rows["key"]], "g").collect()
    for g in ("0", "1", "2", None):
        ids = sorted((r.key, r["rank"]) for r in got if r.g == g)
        assert [n for _, n in ids] == list(range(1, 251))


@pytest.mark.parametrize("kind", ["backfill", "batches", "pages"])
def test_a_million_ranks_with_further_columns(spark, kind):
    """Ranks are 1 to n, each once and in the order of the keys, whatever columns are kept."""
    n = 1_000_000
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.concat(F.lit("value "), F.col("id")).alias("value"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("target"), F.lit("origin").alias("source"))
    of = ["target"] if kind == "batches" else []
    if kind == "backfill":
        got = kv.backfill(rows, 0, 5, 1).withColumn("rank", F.col("version"))
    elif kind == "pages":
        got = kv.pages(rows)
    else:
        got = migrate.batches(rows)
    got = stored(got, "got")
    sums = got.groupBy(*of).agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("key").alias("k")).collect()
    assert sum(r.n for r in sums) == n and all(r.n == r.d == r.hi == r.k and r.lo == 1 for r in sums)
    ahead = Window.partitionBy(*of, F.floor(F.col("rank") / 5000)).orderBy("rank")
    assert got.withColumn("last", F.lag("key").over(ahead)).where("last >= key").count() == 0


def test_reads(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("",)], "key string")
    snap = spark.createDataFrame([("a", "x", False), ("b", None, True)], "key string, value string, tombstone boolean")
    origin = spark.createDataFrame([("b", "o"), ("c", "o")], "key string, value string")
    got = {r.key: (r.source, r.value) for r in kv.read_through(keys, snap, origin).collect()}
    assert got == {"a": ("cache", "x"), "b": ("deleted", None), "c": ("origin", "o"), "d": ("miss", None), "": ("error", None)}
    assert [r.key for r in kv.negative(keys.where("key <> ''"), snap, origin, 0, 5).collect()] == ["d"]


def test_singleflight(spark):
    calls = spark.createDataFrame([("hot", 0, 50)] * 100 + [("cold", 0, 1), ("cold", 5, 6)], "key string, start long, finish long")
    assert {r.key: (r.calls, r.loads) for r in kv.dedupe_loads(calls).collect()} == {"hot": (100, 1), "cold": (2, 2)}
    assert {r.key: r.peak for r in kv.peak_concurrency(calls, "key", 10).collect()} == {"hot": 100, "cold": 1}


def test_empty(spark):
    ops = spark.createDataFrame([], OPS)
    assert kv.lww_snapshot(ops).count() == kv.ttl_fold(ops).count() == kv.pages(ops).count() == 0
