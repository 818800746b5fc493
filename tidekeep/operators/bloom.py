"""A Bloom filter as a set of bit positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekeep.functions import fnv1_32


def parameters(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes for n keys and a false positive rate p."""
    bits = int(-n * math.log(p) / math.log(2) ** 2)
    return bits, int(bits / n * math.log(2))


def positions(key: Column, bits: int, hashes: int) -> Column:
    """Positions of a key: (h1 + i * h2) modulo 2 ** 32, then modulo the bits; h2 is the upper half of h1."""
    h = fnv1_32(key)
    one = F.transform(F.array(h), lambda x: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (x + i * F.shiftright(x, 16)).bitwiseAND(F.lit(4294967295)) % bits))
    return F.get(one, F.lit(0))


def build(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The positions that are set: at most `bits` rows."""
    return keys.select(F.explode(positions(F.col("key"), bits, hashes)).alias("pos")).distinct()


def may_exist(asked: DataFrame, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """asked (distinct key) with may_exist: all of its positions are set."""
    each = asked.select("key", F.explode(F.array_distinct(positions(F.col("key"), bits, hashes))).alias("pos"))
    hit = each.join(filter_.withColumn("on", F.lit(1)), "pos", "left")
    return hit.groupBy("key").agg((F.count("on") == F.count("*")).alias("may_exist"))
