"""The merged catalog of an archive: many layers become three tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions import media as M
from threadlake.operators import gallery as G
from threadlake.operators import links as L
from threadlake.operators import merge as X
from threadlake.operators import rollups as U
from threadlake.operators.digests import global_rank
from threadlake.session import materialize

RECOVERED = "recovered"
ORDER = ["source_rank", "line_no"]
MEDIA_FIELDS = (
    "conversation_id", "message_id", "kind", "file_name", "prompt", "model", "disposition", "source", "created_ms",
    "path", "sha", "bytes", "mime_type", "status", "archive_source", "original_path", "format_corrected",
)
MEDIA_LOCATION = ("path", "sha", "bytes", "mime_type", "status", "archive_source")


@dataclass
class Catalog:
    conversations: DataFrame
    messages: DataFrame
    media: DataFrame


def merge_messages(messages: DataFrame, captured: DataFrame) -> DataFrame:
    """One row per (conversation, id), with ``seq``: time first, then the order of the layers."""
    kept = X.skip_imported(messages, captured, "conversation_id", RECOVERED)
    fields = ["role", "model", "text", "created_ms"]
    merged = X.prefer_first(kept, ["conversation_id", "id"], ORDER, fields)
    first = kept.groupBy("conversation_id", "id").agg(F.min(F.struct(*ORDER)).alias("_first"))
    rows = X.drop_superseded_recovered(merged.join(first, ["conversation_id", "id"]), RECOVERED)
    order = [F.col("conversation_id").asc(), F.col("created_ms").asc_nulls_first(), F.col("_first").asc()]
    return global_rank(rows, order, "seq").drop("_first").withColumns({
        "role": F.coalesce("role", F.lit("unknown")), "text": F.coalesce("text", F.lit(""))})


def merge_media(media: DataFrame, has_capture) -> DataFrame:
    """One row per identity; rows without bytes count only when a capture brought them."""
    kept = media.where((F.col("layer") == "capture") | F.col("available") | ~has_capture)
    kept = kept.where(~M.is_sidecar(F.col("original_path"), F.col("file_name")))
    keyed = kept.withColumn("media_key", X.media_identity(F.col("layer") == "recovery"))
    return X.prefer_first_media(keyed, ["media_key"], ORDER, MEDIA_FIELDS, MEDIA_LOCATION)


def build_catalog(conversations: DataFrame, messages: DataFrame, media: DataFrame) -> Catalog:
    """Layers of an archive as one catalog.

    Every input row carries layer (capture, imported, recovery), source_rank and line_no.
    conversations: id, title, preview, kind, created_ms, updated_ms; messages: conversation_id, id, role,
    model, text, created_ms; media: stable_id, local_id, source_name and the media fields, available.
    """
    captured = conversations.where("layer = 'capture'").select("id").distinct()
    has_capture = conversations.agg(F.coalesce(F.bool_or(F.col("layer") == "capture"), F.lit(False))).scalar()
    said = merge_messages(messages, captured)

    known = conversations.where(~((F.col("layer") == "imported") & (F.col("id") == RECOVERED) & has_capture))
    merged = X.prefer_first(known, ["id"], ORDER, ["title", "preview", "kind", "created_ms", "updated_ms"])
    catch_all = said.where(F.col("conversation_id") == RECOVERED).select(F.col("conversation_id").alias("id")).distinct()
    empty = merged.where(F.col("id") == RECOVERED).join(catch_all, "id", "left_anti")
    merged = merged.join(empty.select("id"), "id", "left_anti")

    # each stage reads its input several times, so its result is written once instead of derived again; prompts are whole
    # texts, so they stay in the first table and meet the rows that are shown at the end: every row has an id of its own
    linked = materialize(G.inherit_from_message(merge_media(media, has_capture).withColumn("media_id", F.col("media_key")), said), "media")
    files = G.recover_by_hash(linked.drop("prompt")).withColumn("is_thumbnail", M.is_thumbnail(F.col("original_path"), F.col("file_name"))) \
        .withColumn("stem", M.thumbnail_stem(F.col("original_path"), F.col("file_name")))
    shown = G.suppress_covered(materialize(files, "linked"))
    own_model = shown.withColumnRenamed("model", "own_model")
    placed = materialize(G.display_message(own_model, said).withColumn(
        "model", F.when(F.col("disposition") != "input", F.coalesce("own_model", "model"))).drop("own_model"), "placed")

    rolled = U.roll_up(merged.select("id", "title", "kind"), said, placed).join(
        merged.select("id", F.col("preview").alias("_preview"), F.col("updated_ms").alias("_updated")), "id", "left")
    conversations_out = rolled.select(
        "id", "title", "kind", "message_count", "media_count", "models",
        F.coalesce("_preview", "preview").alias("preview"), "created_ms", F.coalesce("_updated", "updated_ms").alias("updated_ms"))
    prompted = placed.join(linked.select("media_id", "prompt"), "media_id", "left")
    return Catalog(conversations_out, said, L.with_conversation(prompted, conversations_out))
