"""Schemas of the engine's tables, as DDL, and its options."""

from __future__ import annotations

from dataclasses import dataclass

WAL = "file string, pos bigint, type tinyint, key string, value binary, ttl_ns bigint, version bigint, expired_at_ns bigint"


@dataclass(frozen=True)
class StoreOptions:
    """A bounded store: kind is lru or lru2, any other is simple (unbounded); both tiers of lru2 get max_bytes.

    clean_us: how often entries that have ended are swept out, in the trace's time (0: only when they are asked for).
    """

    kind: str = "lru2"
    max_bytes: int = 1 << 20
    shards: int = 32
    touch_on_get: bool = False
    clean_us: int = 0
