"""Joins that link media, files, messages, settings and selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import media as M
from threadlake.functions import scalars as S
from threadlake.operators.ordered import first_of_group


def attach_files(media: DataFrame, files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Media rows take path, size and names of the file with the same identity, then of its sidecar.

    files: path, archived_path, file_name, bytes, mime_type; sidecars: target_path, file_name, mime_type, stored_ms.
    """
    parts = M.path_parts(F.col("path"))
    by_identity = files.withColumn("_p", parts).where("_p is not null").select(
        F.col("_p.conversation_id").alias("conversation_id"), F.col("_p.record_id").alias("media_id"),
        F.col("path").alias("_path"), F.col("archived_path").alias("_archived"), F.col("file_name").alias("_file"),
        F.col("bytes").alias("_bytes"), F.col("mime_type").alias("_mime"))
    notes = sidecars.select(F.col("target_path").alias("_path"), F.col("file_name").alias("_note_name"),
                            F.col("mime_type").alias("_note_mime"), F.col("stored_ms").alias("_stored"))
    joined = media.join(by_identity, ["conversation_id", "media_id"], "left").join(notes, "_path", "left")
    found = F.col("_archived").isNotNull()
    mime = F.coalesce("_note_mime", "mime_type", "_mime")
    return joined.select(
        "conversation_id", "media_id", "message_id", "source",
        F.col("_archived").alias("path"), F.when(found, "materialized").otherwise(F.col("status")).alias("status"),
        F.col("_bytes").alias("bytes"), F.when(found, mime).otherwise(F.col("mime_type")).alias("mime_type"),
        F.when(found, F.coalesce("_note_name", "file_name", "_file")).otherwise(F.col("file_name")).alias("file_name"),
        F.coalesce("created_ms", "_stored").alias("created_ms"),
        M.media_kind(F.when(found, mime).otherwise(F.col("mime_type")), F.col("source")).alias("kind"))


def unclaimed_files(files: DataFrame, media: DataFrame) -> DataFrame:
    """Files no media row claimed become media rows; internal sidecars stay out."""
    free = files.join(media.where("path is not null").select(F.col("path").alias("archived_path")).distinct(),
                      "archived_path", "left_anti")
    free = free.where(~M.is_sidecar(F.col("path"), F.col("file_name")))
    parts = free.withColumn("_p", M.path_parts(F.col("path")))
    return parts.select(
        F.concat(F.lit("file:"), "path").alias("media_id"), F.col("_p.conversation_id").alias("conversation_id"),
        F.col("_p.message_id").alias("message_id"), F.col("_p.attachment").alias("attachment"),
        "file_name", M.media_kind(F.col("mime_type"), F.lit("")).alias("kind"), "mime_type",
        F.col("archived_path").alias("path"), F.col("path").alias("original_path"), F.lit("materialized").alias("status"))


def link_by_path(files: DataFrame, messages: DataFrame) -> DataFrame:
    """Message of a file by its path, else by the exact file name inside the conversation.

    files: file_id, path; messages: conversation_id, id, seq, file_name.
    """
    rows = files.withColumn("_p", M.path_parts(F.col("path"))).select(
        "file_id", "path", F.col("_p.conversation_id").alias("conversation_id"), F.col("_p.message_id").alias("_mid"),
        F.col("_p.attachment").alias("attachment"),
        F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "^media/", "").alias("_name"))
    ids = messages.select(F.col("conversation_id"), F.col("id").alias("_mid"), F.col("id").alias("_direct"))
    named = first_of_group(
        messages.where("file_name is not null").select("conversation_id", F.col("file_name").alias("_name"), "seq", "id"),
        ["conversation_id", "_name"], ["seq"], ["id"]).withColumnRenamed("id", "_named")
    return (
        rows.join(ids, ["conversation_id", "_mid"], "left").join(named, ["conversation_id", "_name"], "left")
        .select("file_id", F.when(F.coalesce("_direct", "_named").isNotNull(), F.col("conversation_id")).alias("conversation_id"),
                F.coalesce("_direct", "_named").alias("message_id"), "attachment")
    )


def enrich_by_link(media: DataFrame, links: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields a media row lacks come from the link record of its id, else of its path-derived id.

    media: media_id, path_id, fields; links: link_id, fields.
    """
    direct = links.select(F.col("link_id").alias("media_id"), F.lit(True).alias("_a"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    derived = links.select(F.col("link_id").alias("path_id"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    joined = media.join(direct, "media_id", "left").join(derived, "path_id", "left")
    pick = lambda f: F.when(F.col("_a").isNotNull(), F.col(f"_a_{f}")).otherwise(F.col(f"_b_{f}"))
    return joined.select(*[c for c in media.columns if c not in fields], *[F.coalesce(f, pick(f)).alias(f) for f in fields])


def with_conversation(media: DataFrame, rollup: DataFrame) -> DataFrame:
    """Title, kind and message count of the conversation on each media row."""
    about = rollup.select(
        F.col("id").alias("conversation_id"), F.col("title").alias("conversation_title"),
        F.col("kind").alias("conversation_kind"), F.col("message_count").alias("conversation_messages"))
    return media.join(about, "conversation_id", "left").withColumn(
        "conversation_messages", F.coalesce("conversation_messages", F.lit(0)))


def with_parent(messages: DataFrame, parent: Column, fields: Sequence[str]) -> DataFrame:
    """Fields of the parent message, by its id inside the conversation."""
    parents = messages.select("conversation_id", F.col("id").alias("_parent"), *[F.col(f).alias(f"parent_{f}") for f in fields])
    return messages.withColumn("_parent", parent).join(parents, ["conversation_id", "_parent"], "left") \
        .withColumnRenamed("_parent", "parent_id")


def context_chain(records: DataFrame, turns: DataFrame, sessions: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields from the record, else its turn, else the session.

    records: turn_id, session_id, fields; turns: turn_id, session_id, fields; sessions: session_id, fields.
    """
    t = turns.select("turn_id", F.col("session_id").alias("_s"), *[F.col(f).alias(f"_t_{f}") for f in fields])
    s = sessions.select(F.col("session_id").alias("_sid"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    joined = records.join(t, "turn_id", "left").withColumn("_sid", F.coalesce("session_id", "_s")).join(s, "_sid", "left")
    return joined.select(
        *[c for c in records.columns if c not in fields and c != "session_id"], F.col("_sid").alias("session_id"),
        *[F.coalesce(f, f"_t_{f}", f"_s_{f}").alias(f) for f in fields])


def resolve_settings(owners: DataFrame, candidates: Sequence[str], settings: DataFrame, key: str) -> DataFrame:
    """Settings record of each row: first owner candidate that has one, else the default record.

    settings: owner_id, key (its own id), is_default, line_no, payload columns; a candidate may name a
    record by owner or by id, the first record wins.  The default is the only record, or the first flagged
    one, or the first; it is one row, read as a scalar.
    """
    payload = [c for c in settings.columns if c not in {"owner_id", key, "is_default", "line_no"}]
    names = F.explode(F.array_distinct(F.array(F.col("owner_id"), F.col(key)))).alias("_name")
    named = first_of_group(
        settings.select("*", names).where("_name is not null"), ["_name"], ["line_no"], payload)
    rows = owners
    for i, name in enumerate(candidates):
        side = named.select(F.col("_name").alias(name), F.struct(*payload).alias(f"_m{i}"))
        rows = rows.join(side, name, "left")
    flagged = F.struct((~F.coalesce("is_default", F.lit(False))).alias("d"), F.col("line_no").alias("n"))
    default = settings.agg(F.min_by(F.struct(*payload), flagged).alias("s")).scalar()
    match = F.coalesce(*[F.col(f"_m{i}") for i in range(len(candidates))])
    label = F.coalesce(*[F.when(F.col(f"_m{i}").isNotNull(), F.lit(n)) for i, n in enumerate(candidates)], F.lit("default"))
    return rows.select(*owners.columns, F.coalesce(match, default).alias("_pick"), label.alias("matched_by")).select(
        *owners.columns, "matched_by", *[F.col(f"_pick.{c}").alias(c) for c in payload])


GENERATION_LABELS = (
    ("record", "Media record"), ("message", "Linked message"), ("parent", "Prompt message"),
    ("settings", "Workspace settings fallback"),
)


def generation_metadata(rows: DataFrame) -> DataFrame:
    """Model and settings of a media row with the place they come from.

    Columns ``<place>_model``, ``<place>_model_id``, ``<place>_settings`` for record, message and parent,
    and settings_model_id, settings_settings.
    """
    places = ("record", "message", "parent")
    has = lambda p: F.coalesce(f"{p}_model", f"{p}_model_id", f"{p}_settings").isNotNull()
    source = F.coalesce(*[F.when(has(p), F.lit(p)) for p in places])
    staged = rows.withColumn("_source", source)
    of = lambda name: F.coalesce(*[F.when(F.col("_source") == p, F.col(f"{p}_{name}")) for p in places])
    names = F.create_map(*[F.lit(x) for pair in GENERATION_LABELS for x in pair])
    own_model = F.coalesce(of("model"), of("model_id")).isNotNull()
    return staged.select(
        *[c for c in rows.columns if not c.split("_")[0] in (*places, "settings")],
        S.model_label(of("model"), F.coalesce(of("model_id"), "settings_model_id"), F.lit(None).cast("string")).alias("model_label"),
        F.coalesce(F.try_element_at(names, F.when(own_model, F.col("_source")).when(
            F.col("settings_model_id").isNotNull(), "settings")), F.lit("")).alias("model_source"),
        F.coalesce(of("settings"), F.col("settings_settings")).alias("settings"),
        F.coalesce(F.try_element_at(names, F.when(of("settings").isNotNull(), F.col("_source")).when(
            F.col("settings_settings").isNotNull(), "settings")), F.lit("")).alias("settings_source"))


def restore_selection(selected: DataFrame, messages: DataFrame, ids: DataFrame, images: DataFrame):
    """Messages, ids and images that belong to the selected conversations.

    Ids need both conversation and message; images need either one.
    """
    chosen = selected.select(F.col("id").alias("conversation_id")).distinct()
    picked = messages.join(chosen, "conversation_id", "left_semi")
    message_ids = picked.select(F.col("id").alias("message_id")).distinct()
    picked_ids = ids.join(chosen, "conversation_id", "left_semi").join(message_ids, "message_id", "left_semi")
    by_message = images.join(message_ids, "message_id", "left_semi")
    by_conversation = images.join(message_ids, "message_id", "left_anti").join(chosen, "conversation_id", "left_semi")
    return picked, picked_ids, by_message.unionByName(by_conversation)


def missing_matches(missing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates for missing rows by (message, kind): high confidence only for one identity.

    Candidates are reduced to one row per key before the join, so nothing multiplies.
    missing: id, message_id, kind, file_name; candidates: message_id, kind, sha, file, bytes, file_name.
    """
    identity = F.coalesce("sha", F.concat_ws(":", "file", F.col("bytes").cast("string")))
    per_key = candidates.withColumn("_identity", identity).groupBy("message_id", "kind").agg(
        F.count("*").alias("matches"), F.count_distinct("_identity").alias("identities"), F.min("_identity").alias("identity"))
    names = candidates.groupBy(F.lower("file_name").alias("_name")).agg(F.count("*").alias("name_matches"))
    return (
        missing.withColumn("_name", F.lower("file_name")).join(names, "_name", "left").join(per_key, ["message_id", "kind"])
        .select("id", "matches", "identities",
                F.when(F.col("identities") == 1, "high").otherwise("ambiguous").alias("confidence"),
                F.when(F.col("identities") == 1, F.col("identity")).alias("identity"),
                F.coalesce("name_matches", F.lit(0)).alias("name_matches"))
    )


def drop_covered_failures(items: DataFrame) -> DataFrame:
    """Failed rows go when a row with bytes covers them.

    Covered by identity, by (source, message, identity), or, for synthetic ids, by (source, message).
    items: item_id, record_id, source, message_id, path, status.
    """
    identity = F.coalesce("record_id", "item_id")
    rows = items.withColumn("_identity", identity)
    good = rows.where("path is not null")
    failed = F.col("status") == "failed"
    synthetic = F.col("record_id").isNull() | F.col("record_id").rlike(r"(?i)^message-image-\d+$")
    bad = rows.where(failed).withColumn("_synthetic", synthetic)
    linked = good.where("message_id is not null")
    bad = bad.join(good.select("_identity").distinct(), "_identity", "left_anti")
    bad = bad.join(linked.select("source", "message_id", "_identity").distinct(), ["source", "message_id", "_identity"], "left_anti")
    bad = bad.join(linked.select("source", "message_id").distinct().withColumn("_synthetic", F.lit(True)),
                   ["source", "message_id", "_synthetic"], "left_anti")
    return rows.where(~failed).select(items.columns).unionByName(bad.select(items.columns))


def supplement(verified: DataFrame, projection: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Verified rows keep their values; context they lack comes from the projection (unique per key)."""
    side = projection.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = verified.join(side, key, "left")
    return joined.select(
        *[c for c in verified.columns if c not in fields],
        *[F.coalesce(F.nullif(F.col(f), F.lit("")) if verified.schema[f].dataType.simpleString() == "string" else F.col(f), F.col(f"_{f}")).alias(f)
          for f in fields])


def attach_to_messages(files: DataFrame, message_media: DataFrame, messages: DataFrame) -> DataFrame:
    """Message of each file: the one whose media has the same record, else the last of its conversation.

    A file whose media id the last message already shows is not attached again.
    files: file_id, conversation_id, record_id, media_id; message_media: conversation_id, message_id, seq, record_id, media_id.
    """
    by_record = first_of_group(
        message_media.where("record_id is not null"), ["conversation_id", "record_id"], ["seq"], ["message_id"]
    ).withColumnRenamed("message_id", "_by_record")
    last = messages.groupBy("conversation_id").agg(F.max_by("id", F.col("seq")).alias("_last"))
    shown = message_media.select("conversation_id", F.col("message_id").alias("_last"), "media_id").distinct() \
        .withColumn("_shown", F.lit(True))
    return (
        files.join(by_record, ["conversation_id", "record_id"], "left").join(last, "conversation_id", "left")
        .join(shown, ["conversation_id", "_last", "media_id"], "left")
        .select("file_id", "conversation_id",
                F.coalesce("_by_record", F.when(F.col("_shown").isNull(), F.col("_last"))).alias("message_id"),
                F.when(F.col("_by_record").isNotNull(), "record").when(F.col("_shown").isNotNull(), "present")
                .when(F.col("_last").isNotNull(), "last").otherwise("none").alias("attached_by"))
    )
