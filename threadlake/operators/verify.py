"""Verification and audit: declared against actual counts, sizes, hashes and sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def verify_stores(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Errors of captured stores: missing file, record count, expected count.

    declared: name, records, expected_records; actual: name, lines.
    """
    rows = declared.join(actual.select("name", "lines"), "name", "left")
    text = lambda c: F.col(c).cast("string")
    errors = F.array_compact(F.array(
        F.when(F.col("lines").isNull(), F.concat("name", F.lit(": file is missing."))),
        F.when(F.col("lines") != F.col("records"), F.concat(
            "name", F.lit(": manifest reports "), text("records"), F.lit(" records but file contains "), text("lines"), F.lit("."))),
        F.when(F.col("lines") != F.col("expected_records"), F.concat(
            "name", F.lit(": inventory reported "), text("expected_records"), F.lit(" records but "), text("lines"), F.lit(" were captured."))),
    ))
    return rows.select("name", "lines", errors.alias("errors"))


def verify_files(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Errors of captured files: missing, size, hash (when one is declared).

    declared: path, bytes, sha; actual: path, bytes, sha.
    """
    found = actual.select("path", F.col("bytes").alias("actual_bytes"), F.col("sha").alias("actual_sha"))
    rows = declared.join(found, "path", "left")
    problem = (
        F.when(F.col("actual_bytes").isNull(), "missing").when(F.col("actual_bytes") != F.col("bytes"), "size mismatch")
        .when(F.col("sha").isNotNull() & (F.col("actual_sha") != F.col("sha")), "hash mismatch")
    )
    return rows.select("path", "bytes", "actual_bytes", problem.alias("problem"))


def capture_report(stores: DataFrame, files: DataFrame) -> DataFrame:
    """One row: totals, error count and ok; ok needs no error and at least one store."""
    s = stores.agg(F.count("lines").alias("stores"), F.coalesce(F.sum("lines"), F.lit(0)).cast("bigint").alias("store_records"),
                   F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("bigint").alias("_se"))
    f = files.agg(F.count("actual_bytes").alias("files"), F.coalesce(F.sum("actual_bytes"), F.lit(0)).cast("bigint").alias("file_bytes"),
                  F.count("problem").alias("_fe"))
    return s.withColumn("f", f.select(F.struct("*").alias("f")).scalar()).select("*", "f.*").select(
        "stores", "store_records", "files", "file_bytes", (F.col("_se") + F.col("_fe")).alias("errors"),
        ((F.col("_se") + F.col("_fe") == 0) & (F.col("stores") > 0)).alias("ok"))


def violation(rows: DataFrame, check: str, entity: Column, expected: Column, actual: Column) -> DataFrame:
    return rows.select(
        F.lit(check).alias("check"), entity.cast("string").alias("entity"),
        expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))


def count_mismatches(declared: DataFrame, actual: DataFrame, key: str, value: str, check: str) -> DataFrame:
    """Declared and actual values per key that differ, or exist on one side only."""
    joined = declared.select(key, F.col(value).alias("_d")).join(actual.select(key, F.col(value).alias("_a")), key, "full_outer")
    return violation(joined.where(~F.col("_d").eqNullSafe(F.col("_a"))), check, F.col(key), F.col("_d"), F.col("_a"))


def record_hash_violations(declared: DataFrame, records: DataFrame, key: str, ordinal: str, record: Column) -> DataFrame:
    """Groups whose declared hash (``key``, ``record_hash``) is not the digest of their records in order."""
    from threadlake.operators.digests import ordered_digest
    actual = ordered_digest(records.select(key, ordinal, F.sha2(record, 256).alias("_sha")), [key], ordinal, "_sha", "record_hash")
    return count_mismatches(declared, actual, key, "record_hash", "record hash")


def file_hash_violations(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose bytes differ from the declared hash, or that are on one side only.

    declared: path, sha256; files: path, content.  Only hashes are shuffled.
    """
    actual = files.select("path", F.sha2("content", 256).alias("sha256"))
    return count_mismatches(declared, actual, "path", "sha256", "file hash")


def duplicate_ids(rows: DataFrame, keys: Sequence[str], check: str = "duplicate id") -> DataFrame:
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    return violation(counted, check, F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), F.lit(1), F.col("_n"))


def path_violations(media: DataFrame) -> DataFrame:
    """Media whose path is not addressed by its content hash; media: path, sha."""
    prefix = F.concat(F.lit("media/sha256/"), F.substring("sha", 1, 2), F.lit("/"), "sha", F.lit("."))
    rows = media.where(F.col("sha").isNotNull() & F.col("path").isNotNull()).withColumn("_prefix", F.lower(prefix))
    return violation(rows.where(~F.lower("path").startswith(F.col("_prefix"))), "content path", F.col("path"), F.col("_prefix"), F.col("path"))


def total_violation(rows: DataFrame, check: str, expected: int) -> DataFrame:
    counted = rows.agg(F.count("*").alias("_n"))
    return violation(counted.where(F.col("_n") != expected), check, F.lit("total"), F.lit(expected), F.col("_n"))


def set_violations(index: DataFrame, source: DataFrame, columns: Sequence[str], check: str = "index and source differ") -> DataFrame:
    """Records whose number of copies differs between an index and its source."""
    from threadlake.operators.sets import multiset_difference
    rows = multiset_difference(index, source, columns)
    return violation(rows, check, F.concat_ws(":", *[F.col(c).cast("string") for c in columns]), F.col("right_copies"), F.col("left_copies"))


def quality_summary(violations: DataFrame, warning_checks: Sequence[str] = ()) -> DataFrame:
    """Number of findings per check, with severity."""
    severity = F.when(F.col("check").isin(*warning_checks), "warning").otherwise("error") if warning_checks else F.lit("error")
    return violations.groupBy("check").agg(F.count("*").alias("findings")).withColumn("severity", severity)


def run_status(summary: DataFrame) -> DataFrame:
    errors = F.coalesce(F.sum(F.when(F.col("severity") == "error", F.col("findings"))), F.lit(0)).cast("bigint")
    warnings = F.coalesce(F.sum(F.when(F.col("severity") == "warning", F.col("findings"))), F.lit(0)).cast("bigint")
    return summary.agg(errors.alias("errors"), warnings.alias("warnings")).withColumn(
        "status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "verified with warnings").otherwise("verified"))


def inventory_guard(before: DataFrame, after: DataFrame, key: str, signature: str) -> DataFrame:
    """One row: what changed while a run was reading; any change makes the run incomplete."""
    from threadlake.operators.changes import inventory_diff
    counts = inventory_diff(before, after, key, signature, same=True).agg(*[
        F.count_if(F.col("change") == c).alias(c) for c in ("created", "removed", "modified", "same")])
    return counts.withColumn("status", F.when(F.col("created") + F.col("removed") + F.col("modified") == 0, "complete").otherwise("incomplete"))


def coverage(configured: DataFrame, inventory: DataFrame, fetched: DataFrame) -> DataFrame:
    """Coverage of inventoried stores: every one must arrive with its expected count.

    A configured store the inventory lacks is skipped; a discovered one is mandatory.
    configured: name; inventory: name, records; fetched: name, records.
    """
    rows = (
        configured.select("name", F.lit(True).alias("_configured"))
        .join(inventory.select("name", F.col("records").alias("expected"), F.lit(True).alias("_listed")), "name", "full_outer")
        .join(fetched.select("name", F.col("records").alias("actual")), "name", "left")
    )
    status = (
        F.when(F.col("_listed").isNull(), "absent").when(F.col("expected").isNull(), "uncounted").when(F.col("expected") == 0, "empty")
        .when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("expected"), "mismatch").otherwise("ok")
    )
    return rows.select("name", F.col("_configured").isNull().alias("discovered"), "expected", "actual", status.alias("status"),
                       status.isin("uncounted", "missing", "mismatch").alias("violation"))


def duplicate_audit(files: DataFrame, pool: DataFrame, declared: DataFrame, references: DataFrame) -> DataFrame:
    """Findings of a duplicate audit beside the summary: wrong checksums and missing references.

    files: path, sha, bytes, layer, category; pool: sha; declared: path, sha; references: path, sha.
    A missing reference is resolvable when its bytes survive in another file or in the pool.
    """
    wrong = declared.select("path", F.col("sha").alias("_d")).join(files.select("path", "sha"), "path").where(F.col("sha") != F.col("_d"))
    bad = wrong.select(F.lit("checksum mismatch").alias("finding"), "path", F.lit(False).alias("resolvable"))
    missing = references.join(files.select("path"), "path", "left_anti")
    held = files.select("sha").unionByName(pool.select("sha")).where("sha is not null").distinct().withColumn("_held", F.lit(True))
    gone = missing.join(held, "sha", "left").select(
        F.lit("missing reference").alias("finding"), "path", F.coalesce("_held", F.lit(False)).alias("resolvable"))
    return bad.unionByName(gone)
