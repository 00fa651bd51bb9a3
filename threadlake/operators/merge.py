"""Layered prefer-first merges and keep-first dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.operators.ordered import first_of_group


def _has_value(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    return column.isNotNull() & (column != "") if df.schema[name].dataType.simpleString() == "string" else column.isNotNull()


def prefer_first(layers: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column the first non-empty value by ``order``; 0 and false count as values.

    One aggregation per key with map-side combine: no sort, no window.
    """
    rank = F.struct(*order)
    return layers.groupBy(*keys).agg(*[F.min_by(c, F.when(_has_value(layers, c), rank)).alias(c) for c in columns])


def prefer_first_media(
    layers: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], location: Sequence[str],
) -> DataFrame:
    """Like :func:`prefer_first`, but the location columns follow the first available row."""
    rank = F.struct(*order)
    there = F.when(F.col("available"), rank)
    plain = [c for c in columns if c not in location]
    merged = layers.groupBy(*keys).agg(
        *[F.min_by(c, F.when(_has_value(layers, c), rank)).alias(c) for c in plain],
        F.bool_or("available").alias("available"),
        *[F.min_by(c, F.when(_has_value(layers, c), rank)).alias(f"_any_{c}") for c in location],
        *[F.min_by(c, there).alias(f"_own_{c}") for c in location])
    return merged.select(
        *keys, *plain, "available", *[F.coalesce(f"_own_{c}", f"_any_{c}").alias(c) for c in location])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per composite key in ``order`` (never an arbitrary one)."""
    return first_of_group(df, keys, order, [c for c in df.columns if c not in keys])


def merge_current(legacy: DataFrame, current: DataFrame, key: str = "id") -> DataFrame:
    """Union by id where current rows replace legacy ones; rows without an id get a synthetic one."""
    def keyed(df: DataFrame, name: str, priority: int) -> DataFrame:
        fallback = F.concat(F.lit(f"{name}:"), F.col("line_no").cast("string"))
        own = F.nullif(F.trim(F.col(key).cast("string")), F.lit(""))
        return df.withColumn(key, F.coalesce(own, fallback)).withColumn("_priority", F.lit(priority))
    rows = keyed(legacy, "legacy", 1).unionByName(keyed(current, "current", 0), allowMissingColumns=True)
    # within one source the last row of an id counts
    rows = rows.withColumn("_late", -F.col("line_no"))
    return keep_first(rows, [key], ["_priority", "_late"]).drop("_priority", "_late")


def drop_superseded_recovered(messages: DataFrame, recovered: str = "recovered") -> DataFrame:
    """Messages of the catch-all conversation go when the same id exists in a real one."""
    real = messages.where(F.col("conversation_id") != recovered).select("id").distinct()
    catch_all = messages.where(F.col("conversation_id") == recovered).join(real, "id", "left_anti")
    return messages.where(F.col("conversation_id") != recovered).unionByName(catch_all)


def skip_imported(rows: DataFrame, captures: DataFrame, id_column: str, recovered: str = "recovered") -> DataFrame:
    """With captures present, imported rows of captured conversations and the catch-all are skipped.

    rows carry ``layer`` (capture, imported or recovery); captures: distinct captured ids.
    """
    has_capture = captures.agg(F.count("*") > 0).scalar()
    flagged = rows.withColumn("_imported", F.col("layer") == "imported")
    flagged = flagged.where(~(F.col("_imported") & (F.col(id_column).cast("string") == recovered) & has_capture))
    captured = captures.select(F.col("id").alias(id_column)).distinct().withColumn("_imported", F.lit(True))
    return flagged.join(captured, [id_column, "_imported"], "left_anti").drop("_imported")


def media_identity(source_recovery: Column) -> Column:
    """Identity key of a media row: relationship, recovery id, content hash, id, source-local id."""
    stable = F.col("stable_id")
    text = lambda c: F.col(c).cast("string")
    relationship = F.concat_ws(":", F.lit("relationship"), text("conversation_id"), text("message_id"),
                               F.coalesce(text("stable_id"), text("path"), text("local_id")))
    return (
        F.when(F.col("conversation_id").isNotNull() & F.col("message_id").isNotNull(), relationship)
        .when(source_recovery & stable.isNotNull(), F.concat(F.lit("id:"), text("stable_id")))
        .when(F.col("sha").isNotNull(), F.concat(F.lit("sha256:"), "sha"))
        .when(stable.isNotNull(), F.concat(F.lit("id:"), text("stable_id")))
        .otherwise(F.concat_ws(":", F.col("source_name"), text("local_id")))
    )


def recover_messages(existing: DataFrame, imported: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of an import whose key is unknown, once each: what applying the import would add.

    Known keys and imported rows meet in one aggregation, which combines them map-side: no join, no table of distinct keys.
    """
    keys, payload = list(keys), [c for c in imported.columns if c not in keys]
    known = existing.select(*keys).dropna(subset=keys).withColumn("_known", F.lit(True))
    rows = imported.withColumn("_known", F.lit(False)).unionByName(known, allowMissingColumns=True)
    best = F.min(F.when(~F.col("_known"), F.struct(*order, *[c for c in payload if c not in order]))).alias("_best")
    fresh = rows.groupBy(*keys).agg(best, F.bool_or("_known").alias("_known")).where(~F.col("_known"))
    return fresh.select(*[F.col(k).cast(imported.schema[k].dataType).alias(k) for k in keys], *[F.col(f"_best.{c}").alias(c) for c in payload])
