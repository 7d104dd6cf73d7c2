"""Bloom filters as tables of 64-bit words, built and asked with DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

BITS_PER_KEY, HASHES = 10, 4
#: Bound on a filter (8 MB); every filter is at most as large as its keys ask for.
MAX_BITS = 1 << 26


@dataclass
class Level:
    table: DataFrame
    bits: int
    number: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number * HASHES + i)), F.lit(self.bits)) for i in range(HASHES)]

    def passes(self, key: Column) -> Column:
        words = self.table.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("w")).scalar()
        test = F.lit(True)
        for p in self.places(key):
            test = test & (F.expr("1L") == F.call_function("bit_get", F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")))
        return test


def build_level(keys: DataFrame, count: int, number: int) -> Level:
    bits = -(-count * BITS_PER_KEY // 64) * 64
    level = Level(keys, bits, number)
    spark = keys.sparkSession
    marks = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("p")).select(
        F.shiftright("p", 6).alias("word"), F.call_function("shiftleft", F.expr("1L"), (F.col("p") % 64).cast("int")).alias("bits"))
    blank = spark.range(bits // 64).select(F.col("id").alias("word"), F.expr("0L").alias("bits"))
    level.table = saved(marks.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits")))
    return level
