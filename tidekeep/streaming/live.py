"""The live view of a stream of operations, with a version guard, expiry and a side output of late ones."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

OUT = "key string, seq long, version long, exp long, tombstone boolean, accepted boolean"


def processor():
    """A stateful processor that keeps (seq, version, exp, tombstone) of each key; rows come with the fate of each operation."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class LiveView(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("entry", "seq long, version long, exp long, tombstone boolean")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            now = tuple(self.state.get()) if self.state.exists() else None
            for part in rows:
                out = []
                for r in part.sort_values("seq").itertuples():
                    stale = now is not None and (now[2] == 0 or now[2] > r.ts) and r.version < now[1]
                    if not stale:
                        now = (int(r.seq), int(r.version), int(r.ts + r.ttl) if r.ttl > 0 else 0, bool(r.tombstone))
                    out.append((key[0], int(r.seq), int(r.version), int(r.ts + r.ttl) if r.ttl > 0 else 0, bool(r.tombstone), not stale))
                yield pd.DataFrame(out, columns=["key", "seq", "version", "exp", "tombstone", "accepted"])
            if now is not None:
                self.state.update(now)

        def close(self) -> None:
            pass

    return LiveView()


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_view(ops: DataFrame) -> DataFrame:
    """Every operation of a stream (key, seq, version, ts, ttl, tombstone) with whether the guard accepts it; late ones aren't.

    Operations of a key are taken in the order of arrival by batch, and by seq within a batch.
    """
    return ops.groupBy("key").transformWithStateInPandas(processor(), OUT, "append", "None")


def split(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, late) of a batch of live_view()."""
    return batch.where("accepted"), batch.where("not accepted")


def write_view(viewed: DataFrame, path: str, checkpoint: str):
    """A query that appends accepted and late operations to two tables under path, each batch in a folder of its own, so a repeat replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for part, name in zip(split(batch), ("accepted", "late"), strict=True):
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return viewed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
