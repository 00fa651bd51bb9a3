"""Change data: inventory diffs, incremental plans, registries, two-sided comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake import constants as K


def inventory_diff(before: DataFrame, after: DataFrame, key: str, signature: str, same: bool = False) -> DataFrame:
    """Keys that were created, removed or modified (or are the same, on request)."""
    b = before.select(key, F.col(signature).alias("_b"), F.lit(True).alias("_had"))
    a = after.select(key, F.col(signature).alias("_a"), F.lit(True).alias("_has"))
    change = (
        F.when(F.col("_had").isNull(), "created").when(F.col("_has").isNull(), "removed")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "modified").otherwise("same")
    )
    rows = b.join(a, key, "full_outer").select(key, change.alias("change"))
    return rows if same else rows.where("change <> 'same'")


def consistency_delta(source: DataFrame, target: DataFrame, forced: DataFrame, key: str, signature: str) -> DataFrame:
    """Changes that make ``target`` equal ``source``; forced keys count even when equal."""
    changes = inventory_diff(target, source, key, signature, same=True)
    wanted = forced.select(key).distinct().withColumn("_forced", F.lit(True))
    return (
        changes.join(wanted, key, "left")
        .withColumn("change", F.when((F.col("change") == "same") & F.col("_forced"), "modified").otherwise(F.col("change")))
        .where("change <> 'same'").drop("_forced")
    )


def incremental_stores(previous: DataFrame, current: DataFrame, core: Sequence[str] = K.CORE_STORES) -> DataFrame:
    """Action per store: read, skip or removed.

    A store is the same only when both fingerprints exist and match and the counts match.
    When any core store changed or disappeared, all core stores are read again.
    previous and current: name, records, fingerprint.
    """
    p = previous.select("name", F.col("records").alias("_pr"), F.col("fingerprint").alias("_pf"), F.lit(True).alias("_had"))
    rows = current.withColumn("_has", F.lit(True)).join(p, "name", "full_outer")
    same = F.coalesce((F.col("fingerprint") == F.col("_pf")) & (F.col("records") == F.col("_pr")), F.lit(False))
    staged = rows.select("name", F.when(F.col("_has").isNull(), "removed").when(same, "skip").otherwise("read").alias("action"),
                         F.col("name").isin(*core).alias("core"))
    core_changed = staged.agg(F.coalesce(F.bool_or(F.col("core") & (F.col("action") != "skip")), F.lit(False))).scalar()
    return staged.select("name", F.when((F.col("action") == "skip") & F.col("core") & core_changed, "read").otherwise(
        F.col("action")).alias("action"))


def incremental_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Action per file; a file is the same only when both times are non-zero and size and time match.

    previous and current: path, bytes, modified.
    """
    p = previous.select("path", F.col("bytes").alias("_pb"), F.col("modified").alias("_pm"))
    rows = current.withColumn("_has", F.lit(True)).join(p, "path", "full_outer")
    same = F.coalesce((F.col("modified") != 0) & (F.col("_pm") != 0) & (F.col("bytes") == F.col("_pb"))
                      & (F.col("modified") == F.col("_pm")), F.lit(False))
    return rows.select("path", F.when(F.col("_has").isNull(), "removed").when(same, "skip").otherwise("read").alias("action"))


def plan_summary(stores: DataFrame, files: DataFrame) -> DataFrame:
    """One row: what to read, what is skipped, what went away, and whether nothing changed."""
    def totals(df: DataFrame, name: str) -> DataFrame:
        return df.agg(*[F.count_if(F.col("action") == a).alias(f"{name}_{a}") for a in ("read", "skip", "removed")])
    of_files = totals(files, "files").select(F.struct("*").alias("f")).scalar()
    joined = totals(stores, "stores").withColumn("f", of_files).select("*", "f.*").drop("f")
    changed = sum((F.col(f"{n}_{a}") for n in ("stores", "files") for a in ("read", "removed")), F.lit(0))
    return joined.withColumn("unchanged", changed == 0)


SCOPES = (("indexed", "IndexedDB/"), ("files", "File System/"), ("local", "Local Storage/"), ("session", "Session Storage/"))


def read_scope(changes: DataFrame, has_stores: bool = True, has_files: bool = True) -> DataFrame:
    """Which inventories can be reused, from the prefixes of the changed paths."""
    known = F.lit(False)
    for _, prefix in SCOPES:
        known = known | F.col("path").startswith(prefix)
    touched = changes.agg(
        (F.coalesce(F.bool_and(known), F.lit(False)) & (F.count("*") > 0)).alias("known"),
        *[F.coalesce(F.bool_or(F.col("path").startswith(prefix)), F.lit(False)).alias(f"_{name}") for name, prefix in SCOPES])
    return touched.select(
        (F.col("known") & F.lit(has_stores) & ~F.col("_indexed")).alias("reuse_stores"),
        (F.col("known") & F.lit(has_files) & ~F.col("_files")).alias("reuse_files"),
        F.col("_local").alias("local_storage_changed"), F.col("_session").alias("session_storage_changed"))


def reuse_hashes(current: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that keep their known hash, and files that must be hashed again.

    current: path, bytes, signature; previous: path, bytes, signature, sha.
    """
    known = previous.where(F.col("sha").isNotNull()).select("path", "bytes", "signature", "sha")
    joined = current.join(known, ["path", "bytes", "signature"], "left")
    return joined.where("sha is not null"), joined.where("sha is null").drop("sha")


def upsert_registry(registry: DataFrame, current: DataFrame, now: Column, fields: Sequence[str]) -> DataFrame:
    """Next state of a registry: present rows are active, absent ones keep a tombstone.

    A tombstone keeps its first time; a row that comes back is active again.
    registry: id, fields, status, last_seen, tombstoned_at; current: id, fields (unique ids).
    The result belongs in a new version of the table, never over the one being read.
    """
    c = current.select("id", F.lit(True).alias("_has"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = registry.join(c, "id", "full_outer")
    has = F.col("_has").isNotNull()
    return joined.select(
        "id", *[F.when(has, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.when(has, "active").otherwise("tombstoned").alias("status"),
        F.when(has, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(~has, F.coalesce("tombstoned_at", now)).alias("tombstoned_at"))


def empty_registry(current: DataFrame, fields: Sequence[str], time_type: str = "bigint") -> DataFrame:
    return current.limit(0).select(
        "id", *fields, F.lit(None).cast("string").alias("status"), F.lit(None).cast(time_type).alias("last_seen"),
        F.lit(None).cast(time_type).alias("tombstoned_at"))


def write_plan(previous: DataFrame, current: DataFrame, key: str = "id", digest: str = "record_hash") -> DataFrame:
    """Action per record: added, changed (also when either hash is missing), skipped or tombstoned."""
    p = previous.select(key, F.col(digest).alias("_p"), F.lit(True).alias("_had"))
    c = current.select(key, F.col(digest).alias("_c"), F.lit(True).alias("_has"))
    same = F.coalesce(F.col("_p") == F.col("_c"), F.lit(False))
    return p.join(c, key, "full_outer").select(
        key, F.when(F.col("_had").isNull(), "added").when(F.col("_has").isNull(), "tombstoned").when(same, "skipped")
        .otherwise("changed").alias("action"))


def write_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("added", "changed", "skipped", "tombstoned")])


def diff_package(current: DataFrame, baseline: DataFrame, key: str = "id", digest: str = "record_hash") -> DataFrame:
    """Only the records a baseline lacks or holds with another hash."""
    base = baseline.select(key, F.col(digest).alias("_base"))
    return current.join(base, key, "left").where(F.col("_base").isNull() | (F.col("_base") != F.col(digest))).drop("_base")


def run_manifest(totals: DataFrame, media: DataFrame) -> DataFrame:
    """Row of a run: changes, media counts, warnings and status.

    totals: one row of :func:`write_totals`; media: status per item.
    """
    counted = media.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("materialized", "deduped", "unresolved", "failed")])
    joined = totals.withColumn("m", counted.select(F.struct("*").alias("m")).scalar()).select("*", "m.*").drop("m")
    plural = lambda c, one, many: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, one).otherwise(many)))
    return joined.withColumns({
        "warnings": F.concat_ws(" ", plural("unresolved", " media record is unresolved.", " media records are unresolved."),
                                plural("failed", " media attempt failed.", " media attempts failed.")),
        "status": F.when(F.col("unresolved") + F.col("failed") > 0, "incomplete").otherwise("verified"),
    })


def compare_sides(backup: DataFrame, site: DataFrame, backup_messages: DataFrame, site_messages: DataFrame) -> DataFrame:
    """Status per conversation: restore, conflict, backup-new or synced.

    Two sides are the same when message counts and id sets are equal; edits do not count.
    Ids are matched one by one and counted per conversation, never collected into sets.
    """
    tag = lambda df, left, right: df.select("conversation_id", "id", F.lit(left).alias("_b"), F.lit(right).alias("_s"))
    pairs = tag(backup_messages, 1, 0).unionByName(tag(site_messages, 0, 1)).groupBy("conversation_id", "id").agg(
        F.sum("_b").alias("_b"), F.sum("_s").alias("_s"))
    per_conversation = pairs.groupBy("conversation_id").agg(
        F.sum("_b").alias("backup_count"), F.sum("_s").alias("site_count"),
        F.count_if((F.col("_b") > 0) != (F.col("_s") > 0)).alias("_unmatched")).withColumnRenamed("conversation_id", "id")
    sides = backup.select("id", F.lit(True).alias("_in_backup")).join(site.select("id", F.lit(True).alias("_in_site")), "id", "full_outer")
    rows = sides.join(per_conversation, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    same = (zero("backup_count") == zero("site_count")) & (zero("_unmatched") == 0)
    status = (
        F.when(F.col("_in_site").isNull(), "restore").when(F.col("_in_backup").isNull(), "backup-new")
        .when(same, "synced").otherwise("conflict")
    )
    return rows.select("id", status.alias("status"), zero("backup_count").alias("backup_count"), zero("site_count").alias("site_count"))


def compare_order(status: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in K.COMPARE_STATUS_ORDER for x in pair])
    return F.element_at(ranks, status)


def sync_state(compared: DataFrame, configured: bool = True) -> DataFrame:
    """State of the source, and how both sides relate, from the per-conversation statuses."""
    n = lambda *statuses: F.count_if(F.col("status").isin(*statuses))
    counts = compared.agg(n("restore").alias("restore"), n("conflict").alias("conflict"), n("backup-new").alias("backup_new"), n("synced").alias("synced"))
    site = F.col("backup_new") + F.col("synced") + F.col("conflict")
    vault = F.col("restore") + F.col("synced") + F.col("conflict")
    state = (
        F.when(~F.lit(configured), "not_configured").when((site == 0) & (vault == 0), "fresh")
        .when(site == 0, "browser_empty").when(vault == 0, "vault_empty").otherwise("needs_check")
    )
    relation = (
        F.when((F.col("conflict") > 0) | ((F.col("restore") > 0) & (F.col("backup_new") > 0)), "DIVERGED")
        .when(F.col("backup_new") > 0, "SITE_AHEAD").when(F.col("restore") > 0, "VAULT_AHEAD").otherwise("IN_SYNC")
    )
    return counts.withColumns({"state": state, "relation": relation})


def record_fingerprints(records: DataFrame, store: str, line_no: str, ids: Sequence[str], record: Column) -> DataFrame:
    """Fingerprint per supplemental record; a record without an id gets its store and position."""
    own = F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ids])
    fallback = F.concat(F.col(store), F.lit("-"), (F.col(line_no) + 1).cast("string"))
    return records.select(F.col(store).alias("store"), F.coalesce(own, fallback).alias("record_id"), F.sha2(record, 256).alias("record_hash"))
