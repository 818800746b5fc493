"""Pieces of the SQL that the registered queries are compared with."""

from __future__ import annotations

# The table of CRC-32, from its polynomial.
CRC = """tb(n, k, c) AS (SELECT range::BIGINT, 0, range::BIGINT FROM range(256) UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tb WHERE k < 8),
tt AS (SELECT list(c ORDER BY n) AS tab FROM tb WHERE k = 8)"""


def crc(s: str) -> str:
    """CRC-32 of an ASCII string; needs CRC and tt in FROM."""
    bytes_ = f"list_transform(range(1, strlen({s}) + 1), lambda i: ord(substring({s}, i::INT, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def fnv(s: str) -> str:
    bytes_ = f"list_transform(range(1, strlen({s}) + 1), lambda i: ord(substring({s}, i::INT, 1))::BIGINT)"
    return f"list_reduce(list_prepend(2166136261::BIGINT, {bytes_}), lambda h, b: xor((h * 16777619) & 4294967295, b))"


def ops(modulus: int = 10007) -> str:
    return f"ops AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS ts, event_id * 7919 % {modulus} AS version, event_type = 'error' AS tombstone, value, 21600000000 AS ttl FROM events)"


LWW = "lww AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) = 1)"
ORDER_KEYS = "okeys AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_custkey AS value FROM orders)"
FOLD = """num AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM ops),
fold(key, rn, seq, version, exp, tombstone) AS (SELECT key, rn, seq, version, ts + ttl, tombstone FROM num WHERE rn = 1 UNION ALL
  SELECT n.key, n.rn, CASE WHEN f.exp > n.ts AND n.version < f.version THEN f.seq ELSE n.seq END, CASE WHEN f.exp > n.ts AND n.version < f.version THEN f.version ELSE n.version END,
    CASE WHEN f.exp > n.ts AND n.version < f.version THEN f.exp ELSE n.ts + n.ttl END, CASE WHEN f.exp > n.ts AND n.version < f.version THEN f.tombstone ELSE n.tombstone END
  FROM fold f JOIN num n ON n.key = f.key AND n.rn = f.rn + 1),
folded AS (SELECT key, seq, version, exp, tombstone FROM fold QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1)"""

# The same where every third operation is an entry of a batch, which wins with a higher version only.
MIXED = FOLD.replace("n.version < f.version", "(n.version < f.version OR n.seq % 3 = 0 AND n.version = f.version)")


def node_rows(*statuses: str) -> str:
    from tidekeep.sources.tables import NODES

    return ", ".join(f"('{a}', {k})" for k, (a, s) in enumerate(NODES) if s in statuses)


def all_nodes() -> str:
    from tidekeep.sources.tables import NODES

    return "nodes(addr, status) AS (VALUES " + ", ".join(f"('{a}', '{s}')" for a, s in NODES) + ")"


def ring(name: str, *statuses: str, replicas: int = 50) -> str:
    """CTEs {name}_p (hash, node): the points of a ring."""
    return (
        f"{name}_n(node, ord) AS (VALUES {node_rows(*statuses)}), {name}_h AS (SELECT node, ord, {crc("CAST(i.range AS VARCHAR) || '-' || node")} AS hash FROM {name}_n, range({replicas}) i, tt), "
        f"{name}_p AS (SELECT hash, arg_max(node, ord) AS node FROM {name}_h GROUP BY hash)"
    )


def routed(name: str, keys: str, ring_: str, owner: str = "owner") -> str:
    """CTE {name}: rows of keys (key, ...) with the owner on a ring."""
    return (
        f"{name}_k AS (SELECT k.*, {crc('key')} AS kh FROM {keys} k, tt), {name}_s AS (SELECT lag(hash, 1, -1) OVER (ORDER BY hash) AS lo, hash AS hi, node FROM {ring_}_p), "
        f"{name} AS (SELECT k.* EXCLUDE (kh), coalesce(s.node, (SELECT arg_min(node, hash) FROM {ring_}_p)) AS {owner} FROM {name}_k k LEFT JOIN {name}_s s ON k.kh > s.lo AND k.kh <= s.hi)"
    )


def query(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + " " + select
