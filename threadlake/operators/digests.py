"""Digests of ordered record sets, and ranks over a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.operators.ordered import block_of, position
from threadlake.session import materialize

FANOUT = 4096


def ordered_digest(records: DataFrame, keys: Sequence[str], ordinal: str, digest: str, out: str = "digest", fanout: int = FANOUT) -> DataFrame:
    """SHA-256 over the record digests of each group in ordinal order.

    Records are numbered densely first, so gaps between ordinals change nothing.  The
    digests of ``fanout`` consecutive records are hashed together, then those
    results, and so on: a tree whose every node has at most ``fanout`` children, so
    no task ever holds a whole store.  Three levels cover fanout^3 records; the
    last step joins what is left, one digest per fanout^3 records.
    """
    keys = list(keys)
    rows = records.select(*keys, F.col(ordinal).cast("bigint").alias("_o"), F.col(digest).alias("_d"))
    level = position(rows, keys, "_o", "_n").drop("_o")
    for _ in range(3):
        level = (
            level.withColumn("_b", block_of("_n", fanout)).groupBy(*keys, "_b")
            .agg(F.array_sort(F.collect_list(F.struct("_n", "_d"))).alias("_l"))
            .select(*keys, F.col("_b").alias("_n"),
                    F.sha2(F.array_join(F.transform("_l", lambda x: x["_d"]), ""), 256).alias("_d"))
        )
    return level.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "_d"))).alias("_l")).select(
        *keys, F.sha2(F.array_join(F.transform("_l", lambda x: x["_d"]), ""), 256).alias(out))


def store_inventory(records: DataFrame, store: str, ordinal: str, record: Column) -> DataFrame:
    """Per store: record count, payload bytes and an order-sensitive digest of the record set."""
    hashed = records.select(store, ordinal, F.octet_length(record).alias("_size"), F.sha2(record, 256).alias("_sha"))
    counts = hashed.groupBy(store).agg(F.count("*").alias("records"), F.sum("_size").cast("bigint").alias("bytes"))
    return counts.join(ordered_digest(hashed, [store], ordinal, "_sha", "fingerprint"), store)


def store_manifest(records: DataFrame, store: str, ordinal: str, record: Column, expected: DataFrame) -> DataFrame:
    """Inventory of an export beside what was expected, and one digest over all of its stores.

    expected: store, expected_records, encrypted.  A store is complete when it has the expected number of records; one
    that nobody expected is not.  ``export_sha256`` covers names and fingerprints in the order of the names (an
    export has as many of them as its source has stores).
    """
    stores = store_inventory(records, store, ordinal, record).withColumnRenamed(store, "store")
    named = F.array_sort(F.collect_list(F.struct("store", "fingerprint")))
    lines = F.transform(named, lambda s: F.concat_ws(":", s["store"], s["fingerprint"]))
    export = stores.agg(F.sha2(F.array_join(lines, "\n"), 256)).scalar()
    rows = stores.join(expected, "store", "left")
    return rows.select(
        "store", "records", "bytes", F.col("fingerprint").alias("sha256"), "expected_records",
        F.coalesce(F.col("records") == F.col("expected_records"), F.lit(False)).alias("complete"),
        F.coalesce("encrypted", F.lit(False)).alias("encrypted"), export.alias("export_sha256"))


def unordered_digest(records: DataFrame, keys: Sequence[str], record: Column, out: str = "digest") -> DataFrame:
    """Order-free digest of a record set: the sum of 64-bit hashes, exact in decimals."""
    return records.groupBy(*keys).agg(F.sum(F.xxhash64(record).cast("decimal(38,0)")).cast("string").alias(out))


def global_rank(rows: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Dense 1-based rank over a whole table without a single-task window.

    Rows are range-partitioned and sorted by ``order``, numbered inside their partition and
    written once, so the numbers stay the same however often tasks are repeated.
    Offsets come from one count per partition; nothing is shuffled a second time.
    """
    spark = rows.sparkSession
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # the upper bits of the number are the partition, the lower 33 the place in it
    fixed = materialize(ranged, "ranked").withColumn("_part", F.shiftright("_id", 33))
    place = F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    # one row per partition: at most as many as there are shuffle partitions
    offsets = (
        fixed.groupBy("_part").agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(
            Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    )
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(out, (place + F.col("_offset")).cast("bigint")).drop("_id", "_offset", "_part")
    )
