"""Column functions of the key-value engine, all built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of the systems whose logs are read.
FNV_OFFSET, FNV_PRIME, UINT32 = 2166136261, 16777619, 4294967295
VERSION_EPOCH_MS, WORKER_BITS, SEQUENCE_BITS = 1767225600000, 10, 12
BACKOFF_BASE_MS, BACKOFF_MOST_MS = 100, 600_000
ENTRY_OVERHEAD = 17


def fnv1_32(text: Column) -> Column:
    """FNV-1, 32 bits, of the UTF-8 bytes: multiply, then xor."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    each = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))
    folded = F.aggregate(each, F.lit(FNV_OFFSET).cast("long"), lambda h, b: (h * FNV_PRIME).bitwiseAND(F.lit(UINT32)).bitwiseXOR(b))
    return F.when(size == 0, F.lit(FNV_OFFSET).cast("long")).otherwise(folded)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a store with a power of two of shards."""
    return fnv1_32(key).bitwiseAND(F.lit(shards - 1))


def snowflake(ms: Column, worker: Column, sequence: Column) -> Column:
    """A version from milliseconds, worker (10 bits) and a sequence number (12 bits); raises beyond those."""
    bad = (worker < 0) | (worker >= 1 << WORKER_BITS) | (sequence < 0) | (sequence >= 1 << SEQUENCE_BITS)
    value = F.shiftleft(ms.cast("long") - VERSION_EPOCH_MS, WORKER_BITS + SEQUENCE_BITS).bitwiseOR(F.shiftleft(worker.cast("long"), SEQUENCE_BITS)).bitwiseOR(sequence.cast("long"))
    return F.when(bad, F.raise_error(F.lit("worker or sequence out of range"))).otherwise(value)


def version_of(version: Column, generated: Column, keep_zero: bool) -> Column:
    """The version of a write: its own, or a generated one where it is negative (or zero, unless zero is kept)."""
    return F.when(version < 0 if keep_zero else version <= 0, generated).otherwise(version)


def snowflake_parts(version: Column) -> tuple[Column, Column, Column]:
    """(milliseconds, worker, sequence) of a version."""
    return (
        F.shiftright(version, WORKER_BITS + SEQUENCE_BITS) + VERSION_EPOCH_MS,
        F.shiftright(version, SEQUENCE_BITS).bitwiseAND(F.lit((1 << WORKER_BITS) - 1)),
        version.bitwiseAND(F.lit((1 << SEQUENCE_BITS) - 1)),
    )


def task_id(group: Column, key: Column, option: Column, version: Column) -> Column:
    """Id of a retry task: SHA-256, in hex, of the four parts without separators."""
    return F.sha2(F.concat(group, key, option, version.cast("string")), 256)


def backoff_bounds(attempt: Column) -> tuple[Column, Column]:
    """[low, high) of the wait after an attempt, in ms: half of, and all of, 100 ms doubled for each attempt, 10 min at most."""
    n = F.least(F.greatest(attempt, F.lit(1)), F.lit(30)) - 1
    high = F.least(F.lit(BACKOFF_BASE_MS).cast("long") * F.pow(F.lit(2.0), n).cast("long"), F.lit(BACKOFF_MOST_MS).cast("long"))
    return F.floor(high / 2), high


def live(expires: Column, now: Column) -> Column:
    """Whether an entry lives: no expiry, or one after now."""
    return expires.isNull() | (expires > now)


def remaining_ms(expires_us: Column, now_us: Column) -> Column:
    """Whole milliseconds left, 0 without expiry."""
    return F.coalesce(F.floor((expires_us - now_us) / 1000), F.lit(0)).cast("long")


def charged_size(key: Column, value: Column) -> Column:
    """Bytes that an entry is charged in a bounded store."""
    return F.octet_length(key) + F.octet_length(value) + ENTRY_OVERHEAD


def epoch_us(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"datediff(to_date({ts}), date'1970-01-01') * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def jittered_ms(ttl_ms: Column, key: Column, seq: Column, spread_ms: int = 60_000) -> Column:
    """A TTL moved by up to spread_ms either way, the same for the same key and seq. Off unless asked for."""
    return ttl_ms + F.crc32(F.concat_ws("-", key, seq.cast("string"))) % (2 * spread_ms) - spread_ms
