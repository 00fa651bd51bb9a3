"""Delta generations and snapshot retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.ordered import first_of_group

MAX_DEPTH = 200


def generation_chain(generations: DataFrame, head: str) -> DataFrame:
    """Chain of generations from ``head`` to its root, with depth 0 at the head.

    generations: gen_id, base_gen_id, one row per generation.  A cycle or a chain of
    200 and more is refused.
    """
    spark = generations.sparkSession
    chain = spark.sql("""
        with recursive chain(gen_id, base_gen_id, depth) max recursion level 201 as (
            select gen_id, base_gen_id, 0 from {generations} where gen_id = :head
            union all
            select g.gen_id, g.base_gen_id, c.depth + 1 from chain c join {generations} g on g.gen_id = c.base_gen_id
            where c.depth < 200)
        select * from chain
    """, args={"head": head}, generations=generations)
    limit = F.when(F.col("depth") >= MAX_DEPTH, F.raise_error(F.lit("cyclic or too deep generation chain"))).otherwise(F.col("depth"))
    return chain.withColumn("depth", limit.cast("int"))


def overlay(entries: DataFrame, chain: DataFrame) -> DataFrame:
    """Current content of every path: the closest generation wins.

    entries: gen_id, path, sha, bytes.  The chain has fewer than 200 rows, so it is broadcast.
    """
    placed = entries.join(F.broadcast(chain.select("gen_id", "depth")), "gen_id")
    return first_of_group(placed, ["path"], ["depth"], ["gen_id", "sha", "bytes", "depth"])


def select_tree(tree: DataFrame, prefix: str) -> DataFrame:
    """Listing of a tree below a path prefix."""
    return tree.where(F.col("path").startswith(prefix))


def restore_plan(tree: DataFrame, objects: DataFrame, prefix: str) -> DataFrame:
    """What a restore below a path prefix writes: every file with the object that holds its bytes.

    tree: path, sha, bytes; objects: sha, object_path, object_bytes, one row per content.  A file whose object is
    missing or has another size can't be restored.
    """
    rows = select_tree(tree, prefix).join(objects, "sha", "left")
    status = F.when(F.col("object_path").isNull(), "missing object").when(F.col("object_bytes") != F.col("bytes"), "wrong size").otherwise("ready")
    return rows.select("path", "sha", "bytes", "object_path", status.alias("status"))


def retention_plan(snapshots: DataFrame, keep: int) -> DataFrame:
    """Which managed snapshots stay: the latest ``keep``; only verified ones may go.

    snapshots: snapshot_id (sorts by time), verified, managed.  Nothing is deleted.
    """
    eligible = F.col("verified") & F.col("managed")
    kept = snapshots.where(eligible).orderBy(F.col("snapshot_id").desc()).limit(keep).select("snapshot_id", F.lit(True).alias("_kept"))
    return snapshots.join(kept, "snapshot_id", "left").select(
        "snapshot_id", "verified", "managed",
        F.when(~eligible, "untouched").when(F.col("_kept"), "keep").otherwise("prune").alias("action"))
