"""Write-ahead log files: binary frames, replay, retention.

A frame is a 35-byte little-endian header (CRC-32, type, key length, value length, TTL, version, expiry; the CRC covers all
that follows it), the key and the value. Reading stops at a file's first bad frame and keeps what came before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidekeep.schemas import WAL

# Fixed values of the format.
SET, DELETE, SHADOW_SET, SHADOW_DELETE = 1, 2, 3, 4
HEADER = struct.Struct("<IBHIqqq")


def frame(type_: int, key: bytes, value: bytes, ttl_ns: int, version: int, expired_at_ns: int) -> bytes:
    if len(key) > 0xFFFF:
        raise ValueError("a key has at most 65535 bytes")
    body = HEADER.pack(0, type_, len(key), len(value), ttl_ns, version, expired_at_ns)[4:] + key + value
    return struct.pack("<I", zlib.crc32(body)) + body


def frames(data: bytes) -> Iterator[tuple]:
    """(pos, type, key, value, ttl_ns, version, expired_at_ns) of the good frames before the first bad one."""
    at = 0
    while at + HEADER.size <= len(data):
        crc, type_, n, m, ttl, version, expires = HEADER.unpack_from(data, at)
        end = at + HEADER.size + n + m
        if end > len(data) or zlib.crc32(data[at + 4 : end]) != crc:
            return
        body = at + HEADER.size
        yield at, type_, data[body : body + n].decode("utf-8", "replace"), data[body + n : end], ttl, version, expires
        at = end


def read(spark: SparkSession, path: str) -> DataFrame:
    """All frames of the files at path (a glob), each file by one task: rotation bounds a file's size."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return decoded(files)


def decoded(files: DataFrame) -> DataFrame:
    def run(batches):
        import pandas as pd

        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = [(path.rsplit("/", 1)[-1], *f) for f in frames(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "pos", "type", "key", "value", "ttl_ns", "version", "expired_at_ns"])

    return files.select("path", "content").mapInPandas(run, WAL)


def encoded(rows: DataFrame) -> DataFrame:
    """file, content: the frames of each file in pos order (a file's frames come together in one task)."""

    def run(frame_rows):
        import pandas as pd

        ordered = frame_rows.sort_values("pos")
        data = b"".join(frame(r.type, r.key.encode(), bytes(r.value or b""), r.ttl_ns, r.version, r.expired_at_ns) for r in ordered.itertuples())
        return pd.DataFrame({"path": [frame_rows["file"].iloc[0]], "content": [data]})

    return rows.groupBy("file").applyInPandas(run, "path string, content binary")


def operations(rows: DataFrame, now_ns: int) -> DataFrame:
    """Log rows that still count at now, in order (rotated files by name, then the current one): file, pos, key, version, tombstone, expires, retry."""
    fresh = rows.where(~((F.col("expired_at_ns") > 0) & (F.col("expired_at_ns") <= now_ns)))
    return fresh.where(F.col("type").between(SET, SHADOW_DELETE)).select(
        "file", "pos", "key", "value", "version", F.col("type").isin(DELETE, SHADOW_DELETE).alias("tombstone"), F.when(F.col("expired_at_ns") > 0, F.col("expired_at_ns")).alias("expires_ns"), (F.col("type") >= SHADOW_SET).alias("retry")
    )


def replayed(rows: DataFrame, now_ns: int, current: str = "wal.log") -> DataFrame:
    """Snapshot after a replay: for each key the highest version, of equal ones the last logged. Shadow retries are left out."""
    own = operations(rows, now_ns).where("not retry")
    order = F.struct("version", (F.col("file") == current).alias("cur"), "file", "pos")
    return own.groupBy("key").agg(F.max_by(F.struct("version", "tombstone", "value", "expires_ns", "file", "pos"), order).alias("w")).select("key", "w.*")


def retries(rows: DataFrame, now_ns: int) -> DataFrame:
    """Shadow writes that a replay puts back into the retry queue."""
    return operations(rows, now_ns).where("retry").drop("retry")


def retention(files: DataFrame, now: int, max_age: int, max_files: int = 5) -> DataFrame:
    """Rotated files (file, mtime) to delete: older than max_age, but never among the newest max_files."""
    newest = Window.orderBy(F.desc("mtime"), F.desc("file"))  # a directory's listing
    return files.withColumn("_n", F.row_number().over(newest)).where((F.col("_n") > max_files) & (F.lit(now) - F.col("mtime") > max_age)).drop("_n")


def rotated_name(name: str, at: str = "current_timestamp()", repeat: int = 0) -> Column:
    """Name of a rotated file: the log's with a time stamp, and a number where that is taken."""
    stamp = F.concat(F.lit(f"{name}."), F.date_format(F.expr(at), "yyyyMMddHHmmss"))
    return F.concat(stamp, F.lit(f".{repeat:06d}")) if repeat else stamp


def rotation(rows: DataFrame, most: int = 256 << 20, by: str = "writer") -> DataFrame:
    """Rows (writer, seq, size) with the number of the file they go to: a file is closed when the next frame would exceed `most` bytes."""
    from collections.abc import Iterator as Batches

    import pyarrow as pa

    def run(batches: Batches[pa.RecordBatch]) -> Batches[pa.RecordBatch]:
        writer, used, number = None, 0, 0
        for b in batches:
            out = []
            for w, size in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if w != writer:
                    writer, used, number = w, 0, 0
                if used and used + size > most:
                    used, number = 0, number + 1
                used += size
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], ["writer", "seq", "size", "file_no"])

    own = rows.select(F.col(by).cast("string").alias("writer"), F.col("seq").cast("long").alias("seq"), F.col("size").cast("long").alias("size"))
    return own.repartition("writer").sortWithinPartitions("writer", "seq").mapInArrow(run, "writer string, seq long, size long, file_no long")


def listed(files: DataFrame, name: str) -> DataFrame:
    """Rotated files of a log, in the order in which they are replayed."""
    return files.where(F.col("file").startswith(f"{name}.")).orderBy("file")
