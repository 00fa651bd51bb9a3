"""Set and multiset operations on record and key sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Records whose number of copies differs, with both counts.

    Both sides are counted in one aggregation; copies shrink before the shuffle.
    """
    tagged = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return tagged.groupBy(*columns).agg(F.sum("_l").alias("left_copies"), F.sum("_r").alias("right_copies")).where(
        "left_copies <> right_copies")


def multiset_equal(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: equal, and how many copies stand on one side only."""
    difference = F.col("left_copies") - F.col("right_copies")
    return multiset_difference(left, right, columns).agg(
        (F.count("*") == 0).alias("equal"),
        F.coalesce(F.sum(F.greatest(difference, F.lit(0))), F.lit(0)).alias("left_only"),
        F.coalesce(F.sum(F.greatest(-difference, F.lit(0))), F.lit(0)).alias("right_only"))


def key_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that were added, removed or kept."""
    old, new = before.select(key), after.select(key)
    label = lambda df, name: df.withColumn("change", F.lit(name))
    return (
        label(new.subtract(old), "added")
        .unionByName(label(old.subtract(new), "removed")).unionByName(label(old.intersect(new), "kept"))
    )
