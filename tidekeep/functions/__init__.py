"""Column functions: hashes, versions, times, sizes."""

from tidekeep.functions.columns import SEQUENCE_BITS, backoff_bounds, charged_size, epoch_us, fnv1_32, jittered_ms, live, remaining_ms, shard_of, snowflake, snowflake_parts, task_id, version_of

__all__ = ["backoff_bounds", "charged_size", "epoch_us", "fnv1_32", "jittered_ms", "live", "remaining_ms", "shard_of", "snowflake", "snowflake_parts", "task_id", "version_of"]
