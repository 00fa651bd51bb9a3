"""Bloom filters as tables: one row per word of a shard's bit set that is not zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Shards, as a number of leading bits of the key's hash; words of 64 bits in a shard's filter; bits of a key.
PREFIX_BITS, WORDS, PROBES = 4, 1 << 18, 5
SHARDS = 1 << PREFIX_BITS
SCHEMA = StructType([StructField("word", IntegerType()), StructField("bits", LongType())])


def shard(key: Column) -> Column:
    """Prefix of the key's hash."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - PREFIX_BITS).cast("int")


def _probes(rows: DataFrame, key: str) -> DataFrame:
    """The bits of each key: rows (key, shard) become (key, shard, word, mask)."""
    spots = [F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(WORDS * 64)) for i in range(PROBES)]
    return rows.select(key, "shard", F.explode(F.array(*spots)).alias("_spot")).select(
        key, "shard", F.floor(F.col("_spot") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(_spot % 64 as int))").alias("mask"))


def words(rows: DataFrame, key: str) -> DataFrame:
    """Filter of the keys of rows (key, shard): (shard, word, bits)."""
    return _probes(rows, key).groupBy("shard", "word").agg(F.bit_or("mask").alias("bits"))


def suspects(rows: DataFrame, key: str, filters: DataFrame) -> DataFrame:
    """Rows (key, shard) with different keys whose bits are all set in the filters; the others surely are not in the set.

    ``filters`` may hold a word several times, from several batches.
    """
    merged = filters.groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    found = _probes(rows, key).join(merged, ["shard", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
    return found.groupBy(key, "shard").agg(F.count("*").alias("_hits")).where(F.col("_hits") == PROBES).drop("_hits")
