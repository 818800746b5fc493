"""Helpers that the training-data operators share: tables in the shared folder and graph components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidekeep.sources.shared import forget, stored

#: A word: a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of the word numbers of a sieve: it has at most 2 ** WORDS rows, some 16 MB, whatever it is made of.
WORDS = 20


def _place(key: Column) -> tuple[Column, Column]:
    """The word of a key in a sieve, and its bit there."""
    h = F.xxhash64(key, F.lit(5))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, WORDS).bitwiseAND(F.lit(63)).cast("int"))
    return h.bitwiseAND(F.lit((1 << WORDS) - 1)), bit


def sifted(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be in the first column of ids, and rows whose key surely isn't.

    ids are hashed to the bits of at most 2 ** WORDS words, a bound that holds at any size, so the words may be broadcast.
    What may be in ids then meets them in an ordinary join: few rows besides those wanted while ids are under some
    2 ** (WORDS + 6), and all rows beyond, in the same plan.
    """
    word, bit = _place(F.col(ids.columns[0]))
    words = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = _place(F.col(key))
    sieve = F.broadcast(stored(words, "sieve"))
    seen = F.col("_bits").bitwiseAND(bit) != 0
    maybe = rows.join(sieve, word == F.col("_word")).where(seen).drop("_word", "_bits")
    others = rows.join(sieve, word == F.col("_word"), "left").where(~F.coalesce(seen, F.lit(False))).drop("_word", "_bits")
    return maybe, others


def rowed(docs: DataFrame) -> DataFrame:
    """docs with _row (long), a key of each row's own in the order of doc_id, null ids last.

    It is the doc_id where that is unique and never null.  Else the rows are numbered and stored: whole texts are sorted by
    doc_id, and equal ids by their place in the table, so neither null nor repeated ids gather in one task.
    """
    own = F.col("doc_id").cast("long")
    if docs.groupBy(own.alias("_id")).agg(F.count("*").alias("_n")).where("_id is null or _n > 1").isEmpty():
        return docs.withColumn("_row", own)
    placed = docs.withColumn("_at", F.monotonically_increasing_id()).orderBy(own.asc_nulls_last(), "_at")
    return stored(placed.withColumn("_row", F.monotonically_increasing_id()).drop("_at"), "rows")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b, of any type with an order): one row (node, root) for each node of an edge, root its smallest.

    Alternates large-star and small-star steps.  A node's smallest neighbour is an aggregate, combined before the shuffle,
    and comes back by a join that may split a hub's rows, so no task holds all edges of a hub.  Each round's edges are
    written to the shared folder.  Nothing is collected but a count and a checksum.  Null ends are left out.
    """
    cols = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    now = stored(edges.where("a <> b").select(*cols).distinct(), "edges")
    last = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark.n == 0 or mark == last:
            break
        last = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        # edges (v, u) of the larger ends v of each centre u, which now hang on its least neighbour
        large = now.join(near, F.col("v") == F.col("c")).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        low = large.join(least.select(F.col("u").alias("c"), "m"), F.col("u") == F.col("c")).select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
        after = stored(low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        forget(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
