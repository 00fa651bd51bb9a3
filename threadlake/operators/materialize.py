"""Materialized payloads as published versions: staged tables, and a manifest row that is written last."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import media as M
from threadlake.functions import records as R
from threadlake.operators.content import decode_payload, inspect_objects, link_materialized, payload_versions
from threadlake.operators.nested import cleaned, present
from threadlake.operators.ordered import last_of_group
from threadlake.session import materialize

_ITEM = (
    "media_id string, store string, record_id string, sha string, bytes bigint, extension string, mime_type string, kind string, width bigint, height bigint, "
    "file_name string, conversation_id string, message_id string, prompt string, model string, created_ms bigint, capture bigint")
_LATEST = "store string, record_id string, sha string, capture bigint"
_DONE = "capture bigint, store string"
_MANIFEST = "records bigint, payloads bigint, added bigint, bytes bigint"
_PAYLOADS = ("contentBinary", "content_binary", "binaryContent")


def _table(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """Rows of published versions, with their version; a version without a manifest row does not exist."""
    try:
        manifest = spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{base}/manifest").select("version")
        return spark.read.schema(f"{schema}, version int").parquet(f"{base}/{name}").join(manifest, "version", "left_semi")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, version int")


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """One row per published version: records and payloads looked at, items and bytes added."""
    try:
        return spark.read.schema(f"{_MANIFEST}, version int").parquet(f"{base}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{_MANIFEST}, version int")


def items(spark: SparkSession, base: str) -> DataFrame:
    """All items, each as its last version says, with ``is_latest``: the record still has this content."""
    names = [f.split()[0] for f in _ITEM.split(", ")]
    rows = last_of_group(_table(spark, base, "items", _ITEM), ["media_id"], ["version"], names[1:])
    return rows.join(latest(spark, base).select("store", "record_id", F.col("sha").alias("_sha")), ["store", "record_id"], "left").select(
        *names, F.coalesce(F.col("sha") == F.col("_sha"), F.lit(False)).alias("is_latest"))


def latest(spark: SparkSession, base: str) -> DataFrame:
    """The content each record has now: store, record_id, sha, capture."""
    return last_of_group(_table(spark, base, "latest", _LATEST), ["store", "record_id"], ["version"], ["sha", "capture"])


def unseen(records: DataFrame, seen: DataFrame) -> DataFrame:
    """Records of captures and stores not seen yet; ``seen`` (a row a store of a capture) goes to every task, or all records of a store would meet in one."""
    return records.join(F.broadcast(seen), ["capture", "store"], "left_anti")


def publish(base: str, records: DataFrame, messages: DataFrame, apply: bool = True) -> DataFrame:
    """Decodes embedded payloads, adds what is new and publishes it as the next version; returns one row of counts.

    records: store, record_id, capture, line, record (VARIANT); ``capture`` and ``line`` are not negative and in reading order.
    messages: id, conversation_id, created_ms, text, role, model.

    * A pair of capture and store that a published version has seen is passed over, so a second run adds nothing.
    * A payload that can't be decoded, is empty or of no known media type is no item.
    * Content adds an item unless the record's latest content is the same; content the record had before is pointed at
      again, without a new row.  The whole hash decides, never a length or a sample.
    * Bytes go to ``objects``, once per hash; what the linked message knows fills gaps, also of older items, and
      file names get the extension their bytes ask for.
    * Objects, items, latest content and seen stores are staged below the next version's number; the manifest row comes
      last.  A run that ends before it leaves the published version as it was, and the next run overwrites what was staged.

    With ``apply`` false nothing is written below ``base``.
    """
    spark = records.sparkSession
    version = manifest(spark, base).agg(F.coalesce(F.max("version"), F.lit(-1)) + 1).first()[0]
    seen = _table(spark, base, "done", _DONE).select("capture", "store").distinct()
    pending = unseen(records, seen)

    # names and types are read once; the bytes are decoded once and leave the staged table for the objects only
    v = F.col("record")
    payload = F.coalesce(*[R.child(v, name) for name in _PAYLOADS])
    named = lambda *names: present(cleaned(v, *names))
    read = pending.select(
        "store", "record_id", "capture", "line", payload.isNotNull().alias("payload"), decode_payload(payload).alias("content"),
        F.coalesce(named("fileName", "filename", "name"), F.lit("")).alias("reported"), F.coalesce(named("mimeType", "mime_type", "contentType", "content_type"), F.lit("")).alias("said"),
        F.coalesce(named("messageId", "message_id"), F.col("record_id")).alias("message_id"), named("conversationId", "conversation_id").alias("conversation_id"),
        F.coalesce(named("prompt"), F.lit("")).alias("prompt"), named("modelName", "model_name", "model", "modelId", "model_id").alias("model"))
    # a condition on the content would decode it a second time; a list of one or none does not
    filled = F.explode(F.filter(F.array("content"), lambda c: F.length(c) > 0)).alias("content")
    filled = read.select(*(c for c in read.columns if c != "content"), filled)
    found = inspect_objects(filled, "content", "reported", "said").where("detected_mime <> 'application/octet-stream'")
    staged = materialize(found.withColumn("sha", F.sha2("content", 256)).withColumn("ordinal", F.shiftleft("capture", 32) + F.col("line")), "payloads")

    earlier = latest(spark, base).select("store", "record_id", F.lit(-1).cast("bigint").alias("ordinal"), "sha")
    order = payload_versions(staged.select("store", "record_id", "ordinal", "sha").unionByName(earlier), ["store", "record_id"], "ordinal", "sha").where("ordinal >= 0")
    changed = materialize(order.where("changed").select("store", "record_id", "ordinal", "sha"), "changed")
    columns = ["capture", "reported", "message_id", "conversation_id", "prompt", "model", "extension", "detected_mime", "detected_kind", "width", "height", "bytes"]
    known = staged.withColumn("bytes", F.length("content").cast("bigint")).drop("content")
    fresh = last_of_group(known.join(changed, ["store", "record_id", "ordinal", "sha"]), ["store", "record_id", "sha"], ["ordinal"], columns)
    fresh = fresh.select(
        F.concat_ws(":", F.lit("embedded"), "store", "record_id", F.substring("sha", 1, 16)).alias("media_id"), "store", "record_id", "sha", "bytes", "extension",
        F.col("detected_mime").alias("mime_type"), F.col("detected_kind").alias("kind"), "width", "height",
        F.when(F.col("reported") != "", M.correct_extension(F.col("reported"), F.col("extension"))).otherwise(
            F.concat(F.concat_ws("_", "conversation_id", "message_id"), "extension")).alias("file_name"),
        "conversation_id", "message_id", F.nullif(F.col("prompt"), F.lit("")).alias("prompt"), "model", F.lit(None).cast("bigint").alias("created_ms"), "capture")

    # older items are looked at again: a message that came later may know them
    old = items(spark, base).drop("is_latest")
    kept = old.join(fresh.select("media_id"), "media_id", "left_anti")
    every = kept.withColumn("_old", F.struct(*kept.columns)).unionByName(fresh.withColumn("_old", F.lit(None).cast(kept.select(F.struct(*kept.columns)).schema[0].dataType)))
    linked = _linked(every, messages)
    delta = materialize(linked.where(~F.struct(*kept.columns).eqNullSafe(F.col("_old"))).drop("_old"), "items")
    added = fresh.join(old.select("media_id"), "media_id", "left_anti").agg(F.count("*").alias("added"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    counts = materialize(read.agg(F.count("*").alias("records"), F.count_if("payload").alias("payloads")).crossJoin(F.broadcast(added)), "counts")  # one row each
    if not apply:
        return counts

    write = lambda df, name: df.write.mode("overwrite").parquet(f"{base}/{name}/version={version}")
    _put_objects(staged.select("sha", "content"), f"{base}/objects")
    write(delta, "items")
    write(last_of_group(changed, ["store", "record_id"], ["ordinal"], ["sha", "ordinal"]).select("store", "record_id", "sha", F.shiftright("ordinal", 32).alias("capture")), "latest")
    write(pending.select("capture", "store").distinct(), "done")
    write(counts, "manifest")
    return counts


def _linked(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Items with what their message knows; a name without ``_`` becomes that of its conversation and message."""
    said = messages.select("id", "created_ms", F.col("conversation_id").cast("string").alias("conversation_id"), "text", "role", "model")
    wanted = said.join(rows.select(F.col("message_id").alias("id")).distinct(), "id", "left_semi")
    one = last_of_group(wanted, ["id"], ["created_ms", "conversation_id"], ["conversation_id", "created_ms", "text", "role", "model"])  # an id may stand in two conversations
    joined = link_materialized(rows.withColumn("_prompt", F.col("prompt")), one).withColumn("prompt", F.coalesce(F.nullif(F.col("prompt"), F.lit("")), "_prompt")).drop("_prompt")
    own = F.col("conversation_id").isNotNull() & F.col("file_name").rlike(r"^[^_]+$") & F.col("_message")
    renamed = joined.join(one.select(F.col("id").alias("message_id"), F.lit(True).alias("_message")).distinct(), "message_id", "left")
    return renamed.withColumn("file_name", F.when(F.coalesce(own, F.lit(False)), F.concat("conversation_id", F.lit("_"), "message_id", "extension")).otherwise(F.col("file_name"))).select(*rows.columns)


def _put_objects(rows: DataFrame, pool: str) -> None:
    """Bytes the pool lacks, once per hash, sharded by the hash's first digits."""
    spark = rows.sparkSession
    schema = "sha string, bytes bigint, content binary, prefix string"
    fresh = rows.groupBy("sha").agg(F.any_value("content").alias("content"))
    try:
        fresh = fresh.join(spark.read.schema(schema).parquet(pool).select("sha"), "sha", "left_anti")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    objects = fresh.select("sha", F.length("content").cast("bigint").alias("bytes"), "content", F.substring("sha", 1, 2).alias("prefix"))
    objects.hint("rebalance", F.col("prefix")).write.mode("append").partitionBy("prefix").parquet(pool)
