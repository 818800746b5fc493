"""The library's registered queries, each on a folder of tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidekeep import functions as fn
from tidekeep.operators import bloom, cachesim, kv, migrate, retry, ring
from tidekeep.plans import sql
from tidekeep.schemas import StoreOptions
from tidekeep.sources import tables, wal
from tidekeep.sources.tables import HOUR_US, nodes, oplog, order_keys, ring_nodes, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ME = "127.0.0.1:8001"
#: A fixed "now" of the time-dependent queries: microseconds, inside the events' span.
NOW_SQL = "(SELECT max(epoch_us(ts)) - 3600000000 FROM events)"


def registered(oracle: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


def now_us(ops: DataFrame) -> int:
    return ops.agg(F.max("ts")).first()[0] - HOUR_US


# ---- writes


@registered(sql.query(sql.ops(), sql.LWW, select="SELECT key, seq, version, tombstone, value FROM lww"))
def kv_lww_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return kv.lww_snapshot(oplog(spark, d)).select("key", "seq", "version", "tombstone", "value")


@registered(sql.query(sql.ops(), sql.LWW, select="SELECT key, version, value FROM lww WHERE NOT tombstone"))
def kv_live_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return kv.lww_snapshot(oplog(spark, d)).where("not tombstone").select("key", "version", "value")


@registered(sql.query(sql.ops(), sql.LWW, select="SELECT key, version FROM lww WHERE tombstone"))
def kv_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return kv.lww_snapshot(oplog(spark, d)).where("tombstone").select("key", "version")


@registered(
    sql.query(
        sql.CRC, sql.ops(), sql.LWW, sql.ring("w", "active"), "live AS (SELECT key, value FROM lww WHERE NOT tombstone)", sql.routed("r", "live", "w"),
        select="SELECT owner, count(*) AS keys, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DECIMAL(38, 2)) AS total FROM r GROUP BY owner",
    )
)
def kv_routed_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: live keys and the sum of their values for each node."""
    live = kv.lww_snapshot(oplog(spark, d)).where("not tombstone").select("key", "value")
    owned = ring.route(live, ring.points(ring_nodes(spark, "active")))
    return owned.groupBy("owner").agg(F.count("*").alias("keys"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))


@registered(
    sql.query(
        sql.ops(97), sql.LWW, "batch AS (SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS seq, o_orderkey * 7919 % 97 AS version, o_orderstatus = 'F' AS tombstone FROM orders)",
        "u AS (SELECT key, seq, version, tombstone, 0 AS side FROM lww UNION ALL SELECT key, seq, version, tombstone, 1 FROM batch)",
        select="SELECT key, seq, version, tombstone FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, side, seq) = 1",
    )
)
def kv_batchset_merge(spark: SparkSession, d: str) -> DataFrame:
    """A batch of entries, one for each order, over the snapshot of all operations."""
    snapshot = kv.lww_snapshot(oplog(spark, d, 97)).select("key", "seq", "version", "tombstone")
    batch = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 7919 % 97).alias("version"), (F.col("o_orderstatus") == "F").alias("tombstone"))
    return kv.batch_merge(snapshot, batch)


@registered(sql.query(sql.ops(), select="SELECT * FROM (SELECT key, seq, version, max(version) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ops) WHERE version < newest"))
def kv_stale_writes(spark: SparkSession, d: str) -> DataFrame:
    return kv.stale_writes(oplog(spark, d)).select("key", "seq", "version", "newest")


@registered(
    sql.query(
        sql.ops(), "o AS (SELECT *, CASE WHEN seq % 50 = 0 THEN '' ELSE key END AS k2, CASE WHEN tombstone THEN 'delete' ELSE 'set' END AS op, CASE WHEN seq % 40 = 1 THEN NULL ELSE value END AS v2 FROM ops)",
        "n AS (SELECT *, max(version) OVER (PARTITION BY k2 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM o)",
        select="SELECT op, CASE WHEN k2 = '' THEN 'key required' WHEN op = 'set' AND v2 IS NULL THEN 'value required' WHEN newest > version AND op = 'delete' THEN 'false' WHEN newest > version THEN 'ignored' ELSE 'ok' END AS outcome, count(*) AS n FROM n GROUP BY ALL",
    )
)
def kv_request_outcomes(spark: SparkSession, d: str) -> DataFrame:
    ops = oplog(spark, d).withColumns({"key": F.when(F.col("seq") % 50 == 0, "").otherwise(F.col("key")), "op": F.when(F.col("tombstone"), "delete").otherwise("set"), "value": F.when(F.col("seq") % 40 != 1, F.col("value"))})
    return kv.outcomes(ops).groupBy("op", "outcome").agg(F.count("*").alias("n"))


@registered("SELECT CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, CASE WHEN event_type <> 'error' AND event_id % 3 = 0 THEN 5000 ELSE event_id % 3 * 1000 END AS ttl_ms, event_id % 2 = 0 AS forward, count(*) AS n FROM events GROUP BY ALL")
def kv_request_log(spark: SparkSession, d: str) -> DataFrame:
    log = oplog(spark, d).select("seq", F.lit("g").alias("grp"), F.when(F.col("tombstone"), "delete").otherwise("set").alias("op"), "key", F.col("value").cast("string").alias("value"), "version", (F.col("seq") % 3 * 1000).alias("ttl_ms"), (F.col("seq") % 2 == 1).alias("from_peer"))
    return tables.requests(log).groupBy("op", "ttl_ms", "forward").agg(F.count("*").alias("n"))


@registered(sql.query(sql.ops(), sql.LWW, select="SELECT l.key, l.version FROM lww l WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE CAST(c.c_custkey AS VARCHAR) = l.key AND c.c_custkey % 2 = 0)"))
def kv_physical_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("key"))
    return kv.removed(kv.lww_snapshot(oplog(spark, d)), gone).select("key", "version")


@registered(sql.query(sql.ORDER_KEYS, select="SELECT key, strlen(key) + strlen(CAST(value AS VARCHAR)) + 17 AS charged FROM okeys"))
def kv_charged_size(spark: SparkSession, d: str) -> DataFrame:
    return order_keys(spark, d).select("key", fn.charged_size(F.col("key"), F.col("value").cast("string")).alias("charged"))


# ---- expiry


@registered(sql.query(sql.ops(), sql.FOLD, select="SELECT key, seq, version, exp, tombstone FROM folded"))
def kv_ttl_fold(spark: SparkSession, d: str) -> DataFrame:
    return kv.ttl_fold(oplog(spark, d))


@registered(sql.query(sql.ops(97), sql.MIXED, select="SELECT key, seq, version, exp, tombstone FROM folded"))
def kv_mixed_fold(spark: SparkSession, d: str) -> DataFrame:
    """Sets and deletes, and every third operation as an entry of a batch, in one log."""
    return kv.ttl_fold(oplog(spark, d, 97).withColumn("batch", F.col("seq") % 3 == 0))


@registered(sql.query(sql.ops(), sql.FOLD, select=f"SELECT key, version, CAST(floor((exp - {NOW_SQL}) / 1000) AS BIGINT) AS ttl_ms FROM folded WHERE exp > {NOW_SQL}"))
def kv_remaining_ttl(spark: SparkSession, d: str) -> DataFrame:
    ops = oplog(spark, d)
    return kv.alive(kv.ttl_fold(ops), now_us(ops)).select("key", "version", "ttl_ms")


# ---- scans and reads


@registered(sql.query(sql.ORDER_KEYS, select="SELECT key, value FROM okeys WHERE key > '500' ORDER BY key LIMIT 256"))
def kv_scan_page(spark: SparkSession, d: str) -> DataFrame:
    return kv.scan_page(order_keys(spark, d), "500", 256)


@registered(sql.query(sql.ops(), sql.LWW, select="SELECT key, version, tombstone FROM lww ORDER BY key"))
def kv_scan_all(spark: SparkSession, d: str) -> DataFrame:
    return kv.scan_page(kv.lww_snapshot(oplog(spark, d)).select("key", "version", "tombstone"))


@registered(sql.query(sql.ORDER_KEYS, select="SELECT key, CAST((row_number() OVER (ORDER BY key) + 255) // 256 AS BIGINT) AS page FROM okeys"))
def kv_scan_pages_256(spark: SparkSession, d: str) -> DataFrame:
    return kv.pages(order_keys(spark, d).select("key")).select("key", "page")


@registered(sql.query(sql.ops(), sql.LWW, select="SELECT key, version, value FROM lww WHERE key = '7' AND NOT tombstone"))
def kv_point_get(spark: SparkSession, d: str) -> DataFrame:
    return kv.lww_snapshot(oplog(spark, d).where("key = '7'")).where("not tombstone").select("key", "version", "value")


ASKED = "asked AS (SELECT DISTINCT CAST(l_suppkey * 3 AS VARCHAR) AS key FROM lineitem), origin AS (SELECT CAST(s_suppkey * 3 AS VARCHAR) AS key, s_acctbal AS value FROM supplier WHERE s_suppkey % 4 <> 0)"
READ = "got AS (SELECT a.key, CASE WHEN l.tombstone THEN 'deleted' WHEN l.key IS NOT NULL THEN 'cache' WHEN o.key IS NOT NULL THEN 'origin' ELSE 'miss' END AS source, CASE WHEN l.tombstone THEN NULL WHEN l.key IS NOT NULL THEN l.value ELSE o.value END AS value FROM asked a LEFT JOIN lww l ON a.key = l.key LEFT JOIN origin o ON a.key = o.key)"


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = table(spark, d, "lineitem").select((F.col("l_suppkey") * 3).cast("string").alias("key")).distinct()
    origin = table(spark, d, "supplier").where("s_suppkey % 4 <> 0").select((F.col("s_suppkey") * 3).cast("string").alias("key"), F.col("s_acctbal").alias("value"))
    return asked, kv.lww_snapshot(oplog(spark, d)), origin


@registered(sql.query(sql.ops(), sql.LWW, ASKED, READ, select="SELECT * FROM got"))
def kv_read_through(spark: SparkSession, d: str) -> DataFrame:
    return kv.read_through(*_asked(spark, d)).select("key", "source", "value")


@registered(sql.query(sql.ops(), sql.LWW, ASKED, READ, select="SELECT source, count(*) AS n FROM got GROUP BY source"))
def kv_hit_miss(spark: SparkSession, d: str) -> DataFrame:
    return kv.read_through(*_asked(spark, d)).groupBy("source").agg(F.count("*").alias("n"))


@registered(sql.query(sql.ops(), sql.LWW, ASKED, READ, select="SELECT key, value, 1000 + row_number() OVER (ORDER BY key) - 1 AS version, 1300000000 AS exp, FALSE AS tombstone FROM got WHERE source = 'origin'"))
def kv_backfill(spark: SparkSession, d: str) -> DataFrame:
    return kv.backfill(kv.read_through(*_asked(spark, d)), 1_000_000_000, 300_000_000, 1000)


@registered(sql.query(sql.ops(), sql.LWW, ASKED, select="SELECT key, 1030000000 AS exp FROM asked WHERE key NOT IN (SELECT key FROM lww) AND key NOT IN (SELECT key FROM origin)"))
def kv_negative_cache(spark: SparkSession, d: str) -> DataFrame:
    return kv.negative(*_asked(spark, d), 1_000_000_000, 30_000_000)


CALLS = "calls AS (SELECT CAST(user_id % 7 AS VARCHAR) AS key, epoch_us(ts) AS start, epoch_us(ts) + 1000000 * (event_id % 900) AS finish FROM events)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 7).cast("string").alias("key"), fn.epoch_us("ts").alias("start"), (fn.epoch_us("ts") + 1_000_000 * (F.col("event_id") % 900)).alias("finish"))


@registered(
    sql.query(
        CALLS, "f AS (SELECT key, CASE WHEN start > max(finish) OVER (PARTITION BY key ORDER BY start, finish ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY key ORDER BY start, finish) = 1 THEN 1 ELSE 0 END AS lead FROM calls)",
        select="SELECT key, count(*) AS calls, CAST(sum(lead) AS BIGINT) AS loads, CAST(count(*) - sum(lead) AS BIGINT) AS shared FROM f GROUP BY key",
    )
)
def sf_dedupe_loads(spark: SparkSession, d: str) -> DataFrame:
    return kv.dedupe_loads(_calls(spark, d))


@registered(sql.query(CALLS, "e AS (SELECT key, start AS t, 1 AS d FROM calls UNION ALL SELECT key, finish, -1 FROM calls)", select="SELECT key, CAST(max(open) AS BIGINT) AS peak FROM (SELECT key, sum(d) OVER (PARTITION BY key ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM e) GROUP BY key"))
def load_peak_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return kv.peak_concurrency(_calls(spark, d), "key")


# ---- ring


def _ring(spark: SparkSession, *statuses: str, replicas: int = 50) -> DataFrame:
    return ring.points(ring_nodes(spark, *statuses), replicas)


@registered(sql.query(sql.CRC, sql.ring("w", "active"), select="SELECT hash, node FROM w_p"))
def ring_points(spark: SparkSession, d: str) -> DataFrame:
    return _ring(spark, "active")


@registered(sql.query(sql.CRC, sql.ring("w", "active"), select="SELECT lag(hash, 1, -1) OVER (ORDER BY hash) AS lo, hash AS hi, node FROM w_p UNION ALL SELECT max(hash), 4294967296, arg_min(node, hash) FROM w_p"))
def ring_segments(spark: SparkSession, d: str) -> DataFrame:
    return ring.segments(_ring(spark, "active"))


@registered(sql.query(sql.CRC, sql.ORDER_KEYS, sql.ring("w", "active"), sql.routed("r", "okeys", "w"), select="SELECT key, owner FROM r"))
def ring_route(spark: SparkSession, d: str) -> DataFrame:
    return ring.route(order_keys(spark, d), _ring(spark, "active")).select("key", "owner")


@registered(sql.query(sql.CRC, sql.ORDER_KEYS, sql.ring("w", "active"), sql.routed("r", "okeys", "w"), select="SELECT owner, count(*) AS keys FROM r GROUP BY owner"))
def ring_load(spark: SparkSession, d: str) -> DataFrame:
    return ring.load(ring.route(order_keys(spark, d), _ring(spark, "active")))


@registered(sql.query(sql.CRC, sql.ORDER_KEYS, sql.ring("a", "active", replicas=1), sql.ring("b", "active"), sql.routed("x", "okeys", "a"), sql.routed("y", "okeys", "b"), select="SELECT 1 AS replicas, max(n) - min(n) AS spread FROM (SELECT count(*) AS n FROM x GROUP BY owner) UNION ALL SELECT 50, max(n) - min(n) FROM (SELECT count(*) AS n FROM y GROUP BY owner)"))
def ring_spread(spark: SparkSession, d: str) -> DataFrame:
    spread = lambda n: ring.load(ring.route(order_keys(spark, d), _ring(spark, "active", replicas=n))).agg(F.lit(n).alias("replicas"), (F.max("keys") - F.min("keys")).alias("spread"))
    return spread(1).union(spread(50))


MOVES = (sql.CRC, sql.ORDER_KEYS, sql.ring("a", "active"), sql.ring("b", "active", "warming"), sql.routed("x", "okeys", "a", "source"), sql.routed("y", "x", "b", "target"), "m AS (SELECT * FROM y WHERE source <> target)")


def _moves(spark: SparkSession, d: str) -> DataFrame:
    return migrate.plan(order_keys(spark, d), _ring(spark, "active"), _ring(spark, "active", "warming"))


@registered(sql.query(*MOVES, select="SELECT key, source, target FROM m"))
def ring_moved_keys(spark: SparkSession, d: str) -> DataFrame:
    return _moves(spark, d).select("key", "source", "target")


@registered(sql.query(sql.CRC, sql.ring("a", "active", "warming"), sql.ring("b", "active"), select="SELECT hash, node FROM a_p WHERE node <> '127.0.0.1:8004'"))
def ring_remove(spark: SparkSession, d: str) -> DataFrame:
    gone = spark.createDataFrame([("127.0.0.1:8004",)], "node string")
    return ring.points(ring.without(ring_nodes(spark, "active", "warming"), gone))


def _status_ring(name: str, *statuses: str) -> str:
    return f"SELECT '{name}' AS ring, node, count(*) AS points FROM {name}_p GROUP BY node"


@registered(sql.query(sql.CRC, sql.ring("read", "active", "draining"), sql.ring("write", "active"), sql.ring("shadow", "active", "warming"), select=" UNION ALL ".join(map(_status_ring, ("read", "write", "shadow")))))
def ring_by_status(spark: SparkSession, d: str) -> DataFrame:
    return ring.rings(nodes(spark)).groupBy("ring", "node").agg(F.count("*").alias("points"))


@registered(sql.query(sql.CRC, sql.ORDER_KEYS, sql.ring("w", "active"), sql.routed("r", "okeys", "w"), select=f"SELECT owner = '{ME}' AS is_self, owner = '{ME}' OR owner <> '127.0.0.1:8003' AS ok, count(*) AS n FROM r GROUP BY ALL"))
def ring_pick(spark: SparkSession, d: str) -> DataFrame:
    routed = ring.route(order_keys(spark, d), _ring(spark, "active"))
    return ring.pick(routed, ME, F.col("owner") != "127.0.0.1:8003").groupBy("is_self", "ok").agg(F.count("*").alias("n"))


@registered(sql.query(sql.CRC, sql.ORDER_KEYS, sql.ring("w", "active"), sql.ring("s", "active", "warming"), sql.routed("x", "okeys", "w", "writer"), sql.routed("y", "x", "s", "shadow"), select="SELECT key, writer, shadow FROM y WHERE writer <> shadow"))
def shadow_targets(spark: SparkSession, d: str) -> DataFrame:
    both = ring.route(ring.route(order_keys(spark, d), _ring(spark, "active"), owner="writer"), _ring(spark, "active", "warming"), owner="shadow")
    return both.where("writer <> shadow").select("key", "writer", "shadow")


@registered("SELECT addr, status FROM (SELECT CAST(user_id % 9 AS VARCHAR) AS addr, arg_max(CASE event_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'warming' ELSE 'draining' END, event_id) AS status, max(event_id) AS seen FROM events GROUP BY 1) WHERE seen + 12 > (SELECT max(event_id) FROM events)")
def node_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 3 == 0, "active").when(F.col("event_id") % 3 == 1, "warming").otherwise("draining")
    seen = e.select((F.col("user_id") % 9).cast("string").alias("addr"), status.alias("status"), F.col("event_id").alias("ts_ms"))
    return ring.node_status(seen, e.agg(F.max("event_id")).first()[0], 12)


@registered("SELECT coalesce(a.addr, b.addr) AS addr, CASE WHEN a.addr IS NULL THEN 'added' WHEN b.addr IS NULL THEN 'removed' ELSE 'kept' END AS change FROM (SELECT s_suppkey AS addr FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey AS addr FROM supplier WHERE s_suppkey % 2 = 0) b ON a.addr = b.addr")
def node_changes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("addr"))
    return ring.membership_change(s.where("addr % 3 <> 0"), s.where("addr % 2 = 0"))


# ---- migration


@registered(sql.query(sql.all_nodes(), select=f"SELECT '3:{ME}->' || addr AS task_id, '{ME}' AS source, addr AS target FROM nodes WHERE status IN ('active', 'warming') AND addr <> '{ME}'"))
def mig_tasks(spark: SparkSession, d: str) -> DataFrame:
    return migrate.tasks(nodes(spark), ME, 3)


@registered(sql.query(*MOVES, select="SELECT source, target, count(*) AS keys FROM m GROUP BY source, target"))
def mig_plan(spark: SparkSession, d: str) -> DataFrame:
    return _moves(spark, d).groupBy("source", "target").agg(F.count("*").alias("keys"))


BATCHES = "b AS (SELECT key, target, CAST((row_number() OVER (PARTITION BY target ORDER BY key) + 255) // 256 AS BIGINT) AS batch FROM m)"


@registered(sql.query(*MOVES, BATCHES, select="SELECT key, target, batch FROM b"))
def mig_batches(spark: SparkSession, d: str) -> DataFrame:
    return migrate.batches(_moves(spark, d)).select("key", "target", "batch")


@registered(sql.query(*MOVES, BATCHES, select="SELECT target, batch, max(key) AS last_key, CAST(sum(count(*)) OVER (PARTITION BY target ORDER BY batch) AS BIGINT) AS copied FROM b GROUP BY target, batch"))
def mig_progress(spark: SparkSession, d: str) -> DataFrame:
    return migrate.progress(migrate.batches(_moves(spark, d)))


@registered(sql.query(*MOVES, BATCHES, "l AS (SELECT target, max(key) AS last FROM b WHERE batch = 2 GROUP BY target)", select="SELECT m.key, m.target FROM m LEFT JOIN l ON l.target = m.target WHERE l.last IS NULL OR m.key > l.last"))
def mig_resume(spark: SparkSession, d: str) -> DataFrame:
    moves = _moves(spark, d)
    saved = migrate.progress(migrate.batches(moves)).where("batch = 2")
    return migrate.resume(moves, saved).select("key", "target")


@registered(
    sql.query(
        sql.ops(97), "a AS (SELECT *, 0 AS side FROM ops WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) = 1)", "u AS (SELECT * FROM a UNION ALL SELECT *, 1 AS side FROM ops WHERE seq % 2 = 1)",
        select="SELECT key, seq, version, tombstone FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, side ASC, seq ASC) = 1",
    )
)
def mig_merge(spark: SparkSession, d: str) -> DataFrame:
    ops = oplog(spark, d, 97).select("key", "seq", "version", "tombstone")
    return kv.batch_merge(kv.lww_snapshot(ops.where("seq % 2 = 0")), ops.where("seq % 2 = 1")).select("key", "seq", "version", "tombstone")


@registered(sql.query(sql.CRC, sql.ORDER_KEYS, sql.ring("w", "active"), sql.routed("r", "okeys", "w"), select=f"SELECT key, owner FROM r WHERE owner <> '{ME}'"))
def gc_non_owner(spark: SparkSession, d: str) -> DataFrame:
    return migrate.collectable(order_keys(spark, d), _ring(spark, "active"), ME).select("key", "owner")


@registered("SELECT o_orderkey AS id, o_orderstatus = 'O' AND 1000000 - o_custkey * 1000 > 300000 AS can_gc, o_orderstatus <> 'O' AND o_custkey = 5 AND o_orderkey % 2 = 1 AS go_on FROM orders")
def gc_gate(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    state = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "stable").otherwise("migrating").alias("state"), (F.col("o_custkey") * 1000).alias("updated_ms"), F.col("o_custkey").cast("string").alias("owner"), (F.col("o_orderkey") % 2).alias("epoch"))
    return migrate.may_continue(migrate.may_collect(state, 1_000_000), "5", 1).select("id", "can_gc", "go_on")


REQUESTS = """q AS (SELECT user_id % 20 AS cluster, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'finish' WHEN 2 THEN 'pending' ELSE 'finish' END AS action,
  CASE WHEN event_id % 5 < 4 THEN 'A' ELSE 'B' END AS addr, event_id % 3 + 1 AS epoch FROM events),
qn AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY seq) AS rn FROM q),
st(cluster, rn, seq, migrating, epoch, pending, owner, result) AS (
  SELECT cluster, CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE, CAST(0 AS BIGINT), FALSE, '', '' FROM qn WHERE rn = 1 UNION ALL
  SELECT s.cluster, x.rn, x.seq,
    CASE WHEN x.action = 'start' THEN TRUE WHEN x.action = 'finish' AND s.migrating AND s.owner = x.addr AND s.epoch = x.epoch THEN FALSE ELSE s.migrating END,
    CASE WHEN x.action = 'start' AND NOT s.migrating THEN s.epoch + 1 ELSE s.epoch END,
    CASE WHEN x.action = 'start' AND NOT s.migrating THEN FALSE WHEN x.action = 'pending' AND s.migrating THEN TRUE WHEN x.action = 'finish' AND s.migrating AND s.owner = x.addr AND s.epoch = x.epoch THEN FALSE ELSE s.pending END,
    CASE WHEN x.action = 'start' AND NOT s.migrating THEN x.addr WHEN x.action = 'finish' AND s.migrating AND s.owner = x.addr AND s.epoch = x.epoch THEN '' ELSE s.owner END,
    CASE WHEN x.action = 'start' THEN CASE WHEN s.migrating THEN 'rejected' ELSE 'started' END WHEN NOT s.migrating THEN 'not migrating' WHEN x.action = 'pending' THEN 'pending'
      WHEN s.owner <> x.addr THEN 'wrong owner' WHEN s.epoch <> x.epoch THEN 'wrong epoch' WHEN s.pending THEN 'finished, again' ELSE 'finished' END
  FROM st s JOIN qn x ON x.cluster = s.cluster AND x.rn = s.rn + 1)"""


@registered(sql.query(REQUESTS, select="SELECT cluster, seq, result, epoch, migrating, pending, owner FROM st WHERE rn > 0"))
def rebalance_state_machine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    action = F.when(F.col("event_id") % 4 == 0, "start").when(F.col("event_id") % 4 == 2, "pending").otherwise("finish")
    asked = e.select((F.col("user_id") % 20).alias("cluster"), F.col("event_id").alias("seq"), action.alias("action"), F.when(F.col("event_id") % 5 < 4, "A").otherwise("B").alias("addr"), (F.col("event_id") % 3 + 1).alias("epoch"))
    return migrate.state_machine(asked)


@registered(sql.query(sql.all_nodes(), select="SELECT addr, CASE WHEN status = 'warming' THEN 'active' ELSE status END AS status FROM nodes"))
def mig_activate(spark: SparkSession, d: str) -> DataFrame:
    return migrate.activated(nodes(spark))


# ---- retry queue

TASKS = "tasks AS (SELECT event_id AS seq, sha256('g' || CAST(user_id AS VARCHAR) || CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END || CAST(event_id % 5 AS VARCHAR)) AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS option, event_id % 14 AS attempt, epoch_us(ts) AS created_at, epoch_us(ts) + 1000000 * (event_id % 100000) AS next_run_at, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) + 7200000000 END AS leased_until FROM events), queue AS (SELECT * FROM tasks QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    option = F.when(F.col("event_type") == "error", "delete").otherwise("set")
    at = fn.epoch_us("ts")
    return e.select(
        F.col("event_id").alias("seq"), fn.task_id(F.lit("g"), F.col("user_id").cast("string"), option, F.col("event_id") % 5).alias("id"), option.alias("option"), (F.col("event_id") % 14).alias("attempt"), at.alias("created_at"), (at + 1_000_000 * (F.col("event_id") % 100_000)).alias("next_run_at"), F.when(F.col("event_id") % 3 == 0, at + 7_200_000_000).alias("leased_until")
    )


@registered(sql.query(TASKS, select="SELECT seq, id FROM tasks"))
def retry_task_id(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).select("seq", "id")


@registered("SELECT range AS attempt, CAST(floor(least(100 * pow(2, greatest(range, 1) - 1), 600000) / 2) AS BIGINT) AS low_ms, CAST(least(100 * pow(2, greatest(range, 1) - 1), 600000) AS BIGINT) AS high_ms FROM range(0, 41)")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    low, high = fn.backoff_bounds(F.col("id"))
    return spark.range(41).select(F.col("id").alias("attempt"), low.alias("low_ms"), high.alias("high_ms"))


@registered(sql.query(TASKS, select="SELECT id, seq, option, attempt FROM queue"))
def retry_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return retry.enqueued(_tasks(spark, d)).select("id", "seq", "option", "attempt")


@registered(sql.query(TASKS, select=f"SELECT id, {NOW_SQL} + 30000000 AS leased_until FROM queue WHERE next_run_at <= {NOW_SQL} AND (leased_until IS NULL OR leased_until <= {NOW_SQL})"))
def retry_due(spark: SparkSession, d: str) -> DataFrame:
    return retry.leased(retry.enqueued(_tasks(spark, d)), now_us(oplog(spark, d))).select("id", "leased_until")


EVENTS = "ev AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_id % 61 = 0 THEN 'requeue' WHEN event_id % 97 = 0 THEN 'ack' WHEN event_id % 89 = 0 THEN 'dlq' ELSE 'nack' END AS event, user_id % 3 AS attempt FROM events)"


@registered(
    sql.query(
        EVENTS, "ag AS (SELECT id, max(CASE WHEN event = 'requeue' THEN seq END) AS again, min(attempt) AS first FROM ev GROUP BY id)",
        "s AS (SELECT a.id, CASE WHEN again IS NULL THEN first ELSE 0 END + count(e.seq) FILTER (e.event = 'nack') AS attempt, bool_or(coalesce(e.event = 'ack', FALSE)) AS acked, bool_or(coalesce(e.event = 'dlq', FALSE)) AS dead FROM ag a LEFT JOIN ev e ON e.id = a.id AND (again IS NULL OR e.seq > again) GROUP BY a.id, again, first)",
        select="SELECT id, attempt, CASE WHEN acked THEN 'done' WHEN dead OR attempt > 10 THEN 'dlq' ELSE 'pending' END AS state, CASE WHEN NOT acked AND NOT dead AND attempt <= 10 THEN CAST(floor(least(100 * pow(2, greatest(attempt, 1) - 1), 600000) / 2) AS BIGINT) END AS wait_from_ms, CASE WHEN NOT acked AND NOT dead AND attempt <= 10 THEN CAST(least(100 * pow(2, greatest(attempt, 1) - 1), 600000) AS BIGINT) END AS wait_to_ms FROM s",
    )
)
def retry_dlq(spark: SparkSession, d: str) -> DataFrame:
    event = F.when(F.col("event_id") % 61 == 0, "requeue").when(F.col("event_id") % 97 == 0, "ack").when(F.col("event_id") % 89 == 0, "dlq").otherwise("nack")
    return retry.settled(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), event.alias("event"), (F.col("user_id") % 3).alias("attempt")))


@registered(sql.query(TASKS, select=f"SELECT count(*) FILTER (attempt <= 10) AS pending, count(*) FILTER (attempt <= 10 AND leased_until > {NOW_SQL}) AS in_flight, max(CASE WHEN attempt <= 10 THEN {NOW_SQL} - created_at END) AS oldest_age, count(*) FILTER (attempt > 10) AS dlq FROM queue"))
def retry_stats(spark: SparkSession, d: str) -> DataFrame:
    return retry.stats(retry.enqueued(_tasks(spark, d)).withColumn("dlq", F.col("attempt") > 10), now_us(oplog(spark, d)))


@registered(sql.query(TASKS, select=f"SELECT id, option FROM queue WHERE option = 'set' AND next_run_at <= {NOW_SQL} AND NOT (leased_until IS NOT NULL AND leased_until >= {NOW_SQL}) ORDER BY id LIMIT 100"))
def retry_list(spark: SparkSession, d: str) -> DataFrame:
    return retry.listed(retry.enqueued(_tasks(spark, d)), now_us(oplog(spark, d)), "set", True, False).select("id", "option")


# ---- versions, hashes, filters


@registered("SELECT event_id AS seq, epoch_ms(ts) * 0 + 1767225600000 + event_id * 1000 AS ms, event_id % 1024 AS worker, event_id % 4096 AS sequence, ((event_id * 1000) << 22) | ((event_id % 1024) << 12) | (event_id % 4096) AS version FROM events")
def snowflake_decode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"))
    made = e.withColumn("version", fn.snowflake(F.lit(1767225600000) + F.col("seq") * 1000, F.col("seq") % 1024, F.col("seq") % 4096))
    ms, worker, sequence = fn.snowflake_parts(F.col("version"))
    return made.select("seq", ms.alias("ms"), worker.alias("worker"), sequence.alias("sequence"), "version")


@registered("SELECT event_id AS seq, CASE WHEN event_id % 5 - 2 < 0 THEN 1000 + event_id ELSE event_id % 5 - 2 END AS set_version, CASE WHEN event_id % 5 - 2 <= 0 THEN 1000 + event_id ELSE event_id % 5 - 2 END AS delete_version FROM events")
def version_defaults(spark: SparkSession, d: str) -> DataFrame:
    own, made = F.col("event_id") % 5 - 2, F.col("event_id") + 1000
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), fn.version_of(own, made, True).alias("set_version"), fn.version_of(own, made, False).alias("delete_version"))


@registered("SELECT min(range) AS worker FROM range(1, 1024) WHERE range NOT IN (SELECT s_suppkey FROM supplier)")
def workid_alloc(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return spark.range(1, 1024).join(used, "id", "left_anti").agg(F.min("id").alias("worker"))


BITS, HASHES = bloom.parameters(1000, 0.01)


@registered(sql.query(sql.ORDER_KEYS, f"h AS (SELECT key, {sql.fnv('key')} AS h FROM okeys)", select=f"SELECT key, i.range AS i, ((h + i.range * (h >> 16)) & 4294967295) % {BITS} AS pos FROM h, range({HASHES}) i"))
def bloom_positions(spark: SparkSession, d: str) -> DataFrame:
    return order_keys(spark, d).select("key", F.posexplode(bloom.positions(F.col("key"), BITS, HASHES)).alias("i", "pos")).select("key", F.col("i").cast("long"), "pos")


@registered(
    sql.query(
        f"k AS (SELECT CAST(c_custkey AS VARCHAR) AS key, {sql.fnv('CAST(c_custkey AS VARCHAR)')} AS h, c_custkey < 300 AS known FROM customer)", f"p AS (SELECT key, known, ((h + i.range * (h >> 16)) & 4294967295) % {BITS} AS pos FROM k, range({HASHES}) i)", "f AS (SELECT DISTINCT pos FROM p WHERE known)",
        select="SELECT key, bool_and(pos IN (SELECT pos FROM f)) AS may_exist FROM p GROUP BY key",
    )
)
def bloom_filter_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_custkey")
    return bloom.may_exist(keys.select("key"), bloom.build(keys.where("c_custkey < 300"), BITS, HASHES), BITS, HASHES)


@registered(sql.query(sql.ORDER_KEYS, select=f"SELECT {sql.fnv('key')} & 31 AS shard, count(*) AS n FROM okeys GROUP BY 1"))
def lru2_shard(spark: SparkSession, d: str) -> DataFrame:
    return order_keys(spark, d).groupBy(fn.shard_of(F.col("key"), 32).alias("shard")).agg(F.count("*").alias("n"))


def _trace(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    key = F.col("l_partkey").cast("string")
    return rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.lit("get").alias("op"), key.alias("key"), (F.octet_length(key) + 25).alias("size"), F.lit(0).alias("ts"), F.lit(0).alias("ttl"))


@registered("SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS key, 0 AS ttl_us FROM lineitem WHERE CAST(l_partkey AS VARCHAR) > '15'")
def lru2_scan(spark: SparkSession, d: str) -> DataFrame:
    """What a store of two tiers that is large enough holds after the trace, in both tiers."""
    return cachesim.scan(_trace(spark, d), StoreOptions("lru2", 1 << 40, 32), 0, "15")


@registered(None)
def lru2_sim(spark: SparkSession, d: str) -> DataFrame:
    return cachesim.simulate(_trace(spark, d), StoreOptions("lru2", 16_384, 32))


@registered(None)
def lru_sim(spark: SparkSession, d: str) -> DataFrame:
    return cachesim.simulate(_trace(spark, d), StoreOptions("lru", 16_384, 1))


@registered(sql.query(f"k AS (SELECT CAST(l_partkey AS VARCHAR) AS key FROM lineitem), s AS (SELECT key, {sql.fnv('key')} & 31 AS shard FROM k)", select="SELECT shard, count(*) AS gets, count(*) - count(DISTINCT key) AS hits, count(DISTINCT key) AS resident FROM s GROUP BY shard"))
def simple_sim(spark: SparkSession, d: str) -> DataFrame:
    return cachesim.simulate(_trace(spark, d), StoreOptions("simple", 0, 32)).select("shard", "gets", "hits", "resident")


# ---- write-ahead log

LOG = "log AS (SELECT event_id AS pos, CASE WHEN event_id % 4 = 3 THEN 'wal.log' ELSE 'wal.log.2026010' || CAST(event_id % 4 AS VARCHAR) END AS file, CASE WHEN event_type = 'error' THEN 2 WHEN event_id % 11 = 0 THEN 3 ELSE 1 END AS type, CAST(user_id AS VARCHAR) AS key, event_id * 7919 % 97 AS version, CASE WHEN event_id % 5 = 0 THEN event_id ELSE 0 END AS expired_at_ns FROM events)"


def _wal(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    return e.select(
        F.when(i % 4 == 3, "wal.log").otherwise(F.concat(F.lit("wal.log.2026010"), (i % 4).cast("string"))).alias("file"), i.alias("pos"), F.when(F.col("event_type") == "error", 2).when(i % 11 == 0, 3).otherwise(1).cast("tinyint").alias("type"),
        F.col("user_id").cast("string").alias("key"), F.col("value").cast("string").cast("binary").alias("value"), F.lit(0).cast("long").alias("ttl_ns"), (i * 7919 % 97).alias("version"), F.when(i % 5 == 0, i).otherwise(0).cast("long").alias("expired_at_ns"),
    )


@registered(sql.query(LOG, select="SELECT key, version, type = 2 AS tombstone, file, pos FROM log WHERE type < 3 AND NOT (expired_at_ns > 0 AND expired_at_ns <= 5000) QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, file = 'wal.log' DESC, file DESC, pos DESC) = 1"))
def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    return wal.replayed(_wal(spark, d), 5000).select("key", "version", "tombstone", "file", "pos")


@registered(sql.query(LOG, select="SELECT key, version, file, pos FROM log WHERE type = 3 AND NOT (expired_at_ns > 0 AND expired_at_ns <= 5000)"))
def wal_retries(spark: SparkSession, d: str) -> DataFrame:
    return wal.retries(_wal(spark, d), 5000).select("key", "version", "file", "pos")


@registered(sql.query(LOG, select="SELECT file, type, count(*) AS n, CAST(sum(version) AS BIGINT) AS versions FROM log GROUP BY file, type"))
def wal_codec(spark: SparkSession, d: str) -> DataFrame:
    """Frames of the log's files, encoded and decoded again."""
    back = wal.decoded(wal.encoded(_wal(spark, d)))
    return back.groupBy("file", F.col("type").cast("int").alias("type")).agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


@registered("SELECT file, mtime FROM (SELECT s_name AS file, s_suppkey % 37 AS mtime FROM supplier) QUALIFY row_number() OVER (ORDER BY mtime DESC, file DESC) > 5 AND 40 - mtime > 10")
def wal_retention(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "supplier").select(F.col("s_name").alias("file"), (F.col("s_suppkey") % 37).alias("mtime"))
    return wal.retention(files, 40, 10)


@registered("SELECT 'wal.log.' || lpad(CAST(s_suppkey AS VARCHAR), 14, '0') AS file FROM supplier WHERE s_suppkey % 3 > 0 ORDER BY file")
def wal_listed(spark: SparkSession, d: str) -> DataFrame:
    """Rotated files of one log among those of another."""
    name = F.when(F.col("s_suppkey") % 3 > 0, "wal.log.").otherwise("other.log.")
    return wal.listed(table(spark, d, "supplier").select(F.concat(name, F.lpad(F.col("s_suppkey").cast("string"), 14, "0")).alias("file")), "wal.log")


# ---- further reads, versions, transfers


@registered(
    sql.query(
        sql.ops(), sql.LWW, ASKED, f"k AS (SELECT key, {sql.fnv('key')} AS h, TRUE AS known FROM (SELECT DISTINCT key FROM lww)), q AS (SELECT key, {sql.fnv('key')} AS h FROM asked)",
        f"f AS (SELECT DISTINCT ((h + i.range * (h >> 16)) & 4294967295) % {BITS} AS pos FROM k, range({HASHES}) i), m AS (SELECT key, bool_and(((h + i.range * (h >> 16)) & 4294967295) % {BITS} IN (SELECT pos FROM f)) AS may FROM q, range({HASHES}) i GROUP BY key)",
        select="SELECT a.key, CASE WHEN may AND NOT l.tombstone THEN l.value END AS value, CASE WHEN NOT may THEN 'absent' WHEN l.key IS NULL OR l.tombstone THEN 'no key' ELSE 'ok' END AS outcome FROM asked a JOIN m ON a.key = m.key LEFT JOIN lww l ON a.key = l.key",
    )
)
def kv_get_many(spark: SparkSession, d: str) -> DataFrame:
    asked, snap, _ = _asked(spark, d)
    return kv.get_many(asked, snap, bloom.may_exist(asked, bloom.build(snap.select("key"), BITS, HASHES), BITS, HASHES))


@registered(
    sql.query(
        sql.CRC, sql.ops(), sql.LWW, ASKED, sql.ring("w", "active"), sql.routed("r", "asked", "w"), sql.routed("c", "lww", "w", "node"),
        "g AS (SELECT r.key, r.owner, m.tombstone AS dead, m.key IS NOT NULL AS here, m.value AS mine, p.key IS NOT NULL AS there, p.value AS theirs, o.key IS NOT NULL AS last, o.value AS loaded FROM r "
        f"LEFT JOIN c m ON m.key = r.key AND m.node = '{ME}' LEFT JOIN c p ON p.key = r.key AND p.node = r.owner AND p.node <> '{ME}' AND NOT p.tombstone LEFT JOIN origin o ON o.key = r.key)",
        select="SELECT key, owner, CASE WHEN dead THEN 'deleted' WHEN here THEN 'local' WHEN there THEN 'peer' WHEN last THEN 'origin' ELSE 'miss' END AS source, CASE WHEN dead THEN NULL WHEN here THEN mine WHEN there THEN theirs WHEN last THEN loaded END AS value FROM g",
    )
)
def kv_read_owned(spark: SparkSession, d: str) -> DataFrame:
    asked, snap, origin = _asked(spark, d)
    w = _ring(spark, "active")
    return kv.read_owned(ring.route(asked, w), ring.route(snap, w, owner="node"), origin, ME)


@registered("SELECT event_id AS seq, ((event_id // 100) << 22) | ((user_id % 8) << 12) | (row_number() OVER (PARTITION BY user_id % 8, event_id // 100 ORDER BY event_id) - 1) AS version FROM events")
def snowflake_generate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("seq"), (F.lit(1767225600000) + F.floor(F.col("event_id") / 100)).alias("ms"), (F.col("user_id") % 8).alias("worker"))
    return kv.generated(rows).select("seq", "version")


@registered(
    sql.query(
        "r AS (SELECT l_orderkey * 8 + l_linenumber AS seq, l_orderkey // 20000 AS ms, row_number() OVER (ORDER BY l_orderkey * 8 + l_linenumber) AS n FROM lineitem)", "p AS (SELECT seq, n + max(ms * 4096 - n) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS place FROM r)",
        select="SELECT seq, ((place // 4096) << 22) | (3 << 12) | (place % 4096) AS version FROM p",
    )
)
def snowflake_waits(spark: SparkSession, d: str) -> DataFrame:
    """One worker makes more versions than its milliseconds have."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), (F.lit(1767225600000) + F.floor(F.col("l_orderkey") / 20000)).alias("ms"), F.lit(3).alias("worker"))
    return kv.generated(rows).select("seq", "version")


@registered(sql.query(sql.CRC, "j AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS s FROM events)", select=f"SELECT seq, 300000 + {sql.crc('s')} % 120000 - 60000 AS ttl_ms FROM j, tt"))
def ttl_jitter(spark: SparkSession, d: str) -> DataFrame:
    ops = oplog(spark, d)
    return ops.select("seq", fn.jittered_ms(F.lit(300_000), F.col("key"), F.col("seq")).alias("ttl_ms"))


@registered(sql.query(sql.CRC, sql.ORDER_KEYS, sql.ring("b", "active", "warming"), sql.routed("y", "okeys", "b", "target"), select=f"SELECT key, target, CAST((row_number() OVER (PARTITION BY target ORDER BY key) + 255) // 256 AS BIGINT) AS batch FROM y WHERE target <> '{ME}'"))
def mig_push(spark: SparkSession, d: str) -> DataFrame:
    return migrate.push(order_keys(spark, d), _ring(spark, "active", "warming"), ME).select("key", "target", "batch")


@registered(sql.query(sql.CRC, sql.ORDER_KEYS, sql.ring("b", "active", "warming"), sql.routed("y", "okeys", "b", "target"), select="SELECT key, CAST((row_number() OVER (ORDER BY key) + 255) // 256 AS BIGINT) AS batch FROM y WHERE target = '127.0.0.1:8004'"))
def mig_pull(spark: SparkSession, d: str) -> DataFrame:
    return migrate.pull(order_keys(spark, d), _ring(spark, "active", "warming"), "127.0.0.1:8004").select("key", "batch")


@registered(sql.query(sql.CRC, sql.ORDER_KEYS, sql.ring("w", "active"), sql.ring("s", "active", "warming"), sql.routed("x", "okeys", "w", "writer"), sql.routed("y", "x", "s", "shadow"), select="SELECT kind, node, count(*) AS n FROM (SELECT 'owner' AS kind, writer AS node FROM y UNION ALL SELECT 'shadow', shadow FROM y WHERE shadow <> writer) GROUP BY ALL"))
def shadow_rows(spark: SparkSession, d: str) -> DataFrame:
    ops = ring.route(order_keys(spark, d), _ring(spark, "active"), owner="writer")
    shadow = ring.route(order_keys(spark, d), _ring(spark, "active", "warming"), owner="shadow")
    return kv.request_rows(ops, shadow).groupBy("kind", "node").agg(F.count("*").alias("n"))


@registered(sql.query(TASKS, select="SELECT id, attempt FROM queue WHERE attempt > 10 ORDER BY id"))
def retry_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return retry.dead_letters(retry.enqueued(_tasks(spark, d)).withColumn("dlq", F.col("attempt") > 10)).select("id", "attempt")


@registered(sql.query(TASKS, select="SELECT id, CASE WHEN attempt > 10 AND seq % 2 = 0 THEN 0 ELSE attempt END AS attempt, attempt > 10 AND seq % 2 = 1 AS dlq, CASE WHEN NOT (attempt > 10 AND seq % 2 = 0) THEN leased_until END AS leased_until FROM queue"))
def retry_requeue(spark: SparkSession, d: str) -> DataFrame:
    q = retry.enqueued(_tasks(spark, d)).withColumn("dlq", F.col("attempt") > 10)
    return retry.requeued(q, q.where("dlq and seq % 2 = 0"), 0).select("id", "attempt", "dlq", "leased_until")


@registered(
    sql.query(
        "f AS (SELECT user_id % 5 AS w, event_id AS seq, 35 + strlen(CAST(user_id AS VARCHAR)) + strlen(props) AS size, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS rn FROM events)",
        "r(w, seq, size, rn, used, file_no) AS (SELECT w, seq, size, rn, size, 0::BIGINT FROM f WHERE rn = 1 UNION ALL SELECT f.w, f.seq, f.size, f.rn, CASE WHEN r.used + f.size > 4096 THEN f.size ELSE r.used + f.size END, CASE WHEN r.used + f.size > 4096 THEN r.file_no + 1 ELSE r.file_no END FROM r JOIN f ON f.w = r.w AND f.rn = r.rn + 1)",
        select="SELECT CAST(w AS VARCHAR) AS writer, file_no, count(*) AS n, sum(size)::BIGINT AS bytes FROM r GROUP BY w, file_no",
    )
)
def wal_rotation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("writer"), F.col("event_id").alias("seq"), (35 + F.octet_length(F.col("user_id").cast("string")) + F.octet_length("props")).alias("size"))
    return wal.rotation(e, 4096).groupBy("writer", "file_no").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
