"""Sinks: normalized tables, content-addressed objects, documents, run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.content import first_seen


def write_indexes(base: str, conversations: DataFrame, messages: DataFrame, media: DataFrame, mode: str = "errorifexists") -> None:
    """The three normalized tables below one folder."""
    for name, df in (("conversations", conversations), ("messages", messages), ("media", media)):
        df.write.mode(mode).parquet(f"{base}/{name}")


def write_objects(items: DataFrame, pool_path: str, pool: DataFrame | None, order: list[str], item_id: str, shard_digits: int = 2) -> DataFrame:
    """Appends payloads the pool lacks, once per hash, and returns each item's status.

    items: item_id, sha, content.  Objects are sharded by the first hex digits of the hash.
    Rows are rebalanced by shard before the write: small shards share a task, large
    ones are split, so files come out near the advisory size.
    """
    status = first_seen(items.drop("content"), "sha", order, item_id, pool)
    fresh = status.where("status = 'materialized'").select(item_id)
    objects = items.join(fresh, item_id, "left_semi").select(
        F.substring("sha", 1, shard_digits).alias("prefix"), "sha", F.length("content").cast("bigint").alias("bytes"), "content")
    objects.hint("rebalance", F.col("prefix")).write.mode("append").partitionBy("prefix").parquet(pool_path)
    return status


def write_documents(sections: DataFrame, path: str) -> None:
    """Markdown sections in reading order, range-partitioned so that long documents span files."""
    ordered = sections.repartitionByRange("conversation_id", "seq").sortWithinPartitions("conversation_id", "seq")
    ordered.write.parquet(path)


def append_run(manifest: DataFrame, path: str) -> None:
    """One row per run."""
    manifest.coalesce(1).write.mode("append").parquet(path)
