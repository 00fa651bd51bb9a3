"""Captures, layers, versioned stores and store discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import records as R
from threadlake.operators.digests import global_rank

LAYERS = ("imported archive", "full-resolution media", "recovered media", "recovered content")


def explode_manifest(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store rows and file rows of capture manifests (run_id, stores, files)."""
    stores = manifests.select("run_id", F.inline("stores"))
    files = manifests.select("run_id", F.inline("files"))
    return stores, files


def capture_sources(captures: DataFrame, layers: DataFrame) -> DataFrame:
    """Layers in order of precedence: verified captures newest first, then the other layers.

    captures: name, ok; layers: name.  Unverified captures are ignored.
    """
    known = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("name"))
    taken = captures.where(F.col("ok") & F.col("name").startswith("capture-")).select(
        "name", F.lit("capture").alias("layer"), F.lit(0).cast("bigint").alias("_group"))
    others = layers.where(known > 0).select(
        "name", F.when(F.col("name") == LAYERS[0], "imported").otherwise("recovery").alias("layer"), known.alias("_group"))
    ranked = global_rank(taken.unionByName(others), [F.col("_group").asc(), F.col("name").desc()], "source_rank")
    return ranked.drop("_group")


def latest_verified(captures: DataFrame) -> DataFrame:
    """The newest verified capture (no row when there is none)."""
    return captures.where("ok").orderBy(F.col("name").desc()).limit(1)


def latest_versions(stores: DataFrame) -> DataFrame:
    """Physical store ``<base>-<n>-documents`` with the highest n per base.

    stores: store (distinct names).
    """
    parts = stores.select(
        "store", F.regexp_extract("store", r"^(.+)-(\d+)-documents$", 1).alias("base"),
        F.regexp_extract("store", r"^(.+)-(\d+)-documents$", 2).try_cast("bigint").alias("version")).where("base <> ''")
    return parts.groupBy("base").agg(F.max_by("store", "version").alias("store"), F.max("version").alias("version"))


def live_documents(records: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents of the latest versions without deleted ones; bookkeeping fields are dropped.

    records: store, record (JSON text).  The version table has one row per base.
    """
    fields = F.from_json("record", "map<string,string>")
    kept = F.map_filter(fields, lambda k, _: ~k.isin("_meta", "_rev", "_attachments", "_deleted"))
    deleted = R.as_text(R.child(R.parse("record"), "_deleted"))
    return (
        records.join(versions.select("store", "base"), "store")
        .where(F.coalesce(deleted, F.lit("false")) != "true").select("base", kept.alias("fields"))
    )


def discover_stores(configured: Sequence[str], inventory: DataFrame) -> DataFrame:
    """Configured stores, then live stores the configuration does not know."""
    spark = inventory.sparkSession
    known = spark.createDataFrame([(name,) for name in dict.fromkeys(configured)], "name string")
    live = inventory.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    return known.withColumn("discovered", F.lit(False)).unionByName(
        live.join(known, "name", "left_anti").withColumn("discovered", F.lit(True)))
