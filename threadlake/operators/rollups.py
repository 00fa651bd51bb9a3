"""Conversation roll-ups, totals, previews and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import scalars as S

PREVIEW = 260


def with_placeholders(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations plus a placeholder for every id that only messages know."""
    missing = (
        messages.select(F.col("conversation_id").alias("id")).distinct()
        .join(conversations.select("id"), "id", "left_anti")
        .select("id", F.lit("Recovered conversation").alias("title"), F.lit("recovered").alias("kind"))
    )
    known = conversations.select("id", F.coalesce("title", F.lit("Untitled conversation")).alias("title"), "kind")
    return known.unionByName(missing)


def first_texts(messages: DataFrame, length: int = PREVIEW) -> DataFrame:
    """First message text that is not empty per conversation, cut before the shuffle."""
    # the cut comes before the aggregation, so whole texts are neither sorted nor shuffled
    said = messages.where(F.col("text") != "").select("conversation_id", "seq", F.substring("text", 1, length).alias("_start"))
    return said.groupBy("conversation_id").agg(F.min_by("_start", "seq").alias("preview"))


def models_seen(messages: DataFrame) -> DataFrame:
    """Distinct models per conversation in the order they first appear.

    The first step leaves one row per (conversation, model), so the list that the
    second step collects holds model names only.
    """
    firsts = messages.where(F.col("model").isNotNull()).groupBy("conversation_id", "model").agg(F.min("seq").alias("first"))
    return firsts.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("first", "model"))).alias("m")).select(
        "conversation_id", F.transform("m", lambda x: x["model"]).alias("models"))


def roll_up(conversations: DataFrame, messages: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """One row per conversation: counts, models, preview and last change.

    Messages and media are aggregated per conversation before any join, so a
    conversation that holds a large share of them meets the joins as one row.
    """
    # numbers only: a hash aggregation; previews are aggregated apart, already cut
    counts = messages.groupBy("conversation_id").agg(
        F.count("*").alias("message_count"), F.max("created_ms").alias("updated_ms"), F.min("created_ms").alias("created_ms"))
    rows = (
        with_placeholders(conversations, messages).withColumnRenamed("id", "conversation_id")
        .join(counts, "conversation_id", "left").join(first_texts(messages), "conversation_id", "left")
        .join(models_seen(messages), "conversation_id", "left")
    )
    if media is None:
        rows = rows.withColumn("media_count", F.lit(0).cast("bigint"))
    else:
        linked = media.where(F.col("conversation_id").isNotNull()).groupBy("conversation_id").agg(F.count("*").alias("media_count"))
        rows = rows.join(linked, "conversation_id", "left")
    return rows.select(
        F.col("conversation_id").alias("id"), "title", "kind",
        F.coalesce("message_count", F.lit(0)).alias("message_count"),
        F.coalesce("media_count", F.lit(0)).alias("media_count"),
        F.coalesce("models", F.array().cast("array<string>")).alias("models"),
        F.coalesce("preview", F.lit("")).alias("preview"), "created_ms", "updated_ms")


def filter_conversations(rows: DataFrame, query: str = "", kind: str = "all") -> DataFrame:
    """Substring over title, preview and models, and an exact kind."""
    text = F.lower(F.concat_ws(" ", "title", "preview", F.array_join("models", " ")))
    keep = F.lit(True)
    if query:
        keep = keep & text.contains(query.lower())
    if kind != "all":
        keep = keep & (F.col("kind") == kind)
    return rows.where(keep)


def list_conversations(rows: DataFrame, sort: str = "recent", limit: int = 60) -> DataFrame:
    """Top rows of a listing; ids break ties."""
    updated = F.coalesce("updated_ms", F.lit(-1))
    order = {
        "recent": [updated.desc()], "oldest": [updated.asc()], "title": [F.lower("title").asc()],
        "messages": [F.col("message_count").desc()], "media": [F.col("media_count").desc()],
        "created": [F.coalesce("created_ms", F.lit(-1)).desc()],
    }[sort]
    return rows.orderBy(*order, F.col("id").asc()).limit(max(1, limit))


def viewer_meta(messages: DataFrame, media: DataFrame, tokens: list[str]) -> DataFrame:
    """Per conversation: attachment, local and review counts, and which tokens occur.

    Tokens hold no blanks, so a token occurs in the joined text of a conversation
    exactly when it occurs in one of its parts; the text itself is never joined.
    """
    said = messages.groupBy("conversation_id").agg(*[
        F.bool_or(F.lower(F.concat_ws(" ", "id", "role", "model", "text")).contains(token)).alias(f"said_{i}")
        for i, token in enumerate(tokens)], F.count("*").alias("message_count"))
    shown = media.groupBy("conversation_id").agg(
        F.count("*").alias("media_count"), F.count_if(F.col("disposition") == "input").alias("attachments"),
        F.count_if("available").alias("local_media"), F.count_if(F.lower("status").isin("failed", "unresolved", "metadata-only")).alias("review_media"),
        *[F.bool_or(F.lower(F.concat_ws(" ", "file_name", "source", "prompt", "status")).contains(token)).alias(f"shown_{i}")
          for i, token in enumerate(tokens)])
    joined = said.join(shown, "conversation_id", "full_outer")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return joined.select(
        "conversation_id", zero("message_count"), zero("media_count"), zero("attachments"), zero("local_media"), zero("review_media"),
        *[(F.coalesce(f"said_{i}", F.lit(False)) | F.coalesce(f"shown_{i}", F.lit(False))).alias(f"has_{i}") for i in range(len(tokens))])


def viewer_filter(conversations: DataFrame, meta: DataFrame, tokens: list[str], media: str = "all", status: str = "all") -> DataFrame:
    """Conversations that pass the media and status filters and contain every token."""
    rows = conversations.join(meta, conversations["id"] == meta["conversation_id"], "left")
    own = F.lower(F.concat_ws(" ", F.col("id").cast("string"), "title", "kind"))
    keep = F.lit(True)
    for i, token in enumerate(tokens):
        keep = keep & (F.coalesce(f"has_{i}", F.lit(False)) | own.contains(token))
    count = lambda name: F.coalesce(name, F.lit(0)) > 0
    keep = keep & {
        "all": F.lit(True), "with-media": count("media_count"),
        "with-attachments": count("attachments"), "without-media": ~count("media_count"),
    }[media]
    keep = keep & {"all": F.lit(True), "local-media": count("local_media"), "review": count("review_media")}[status]
    return rows.where(keep).select(conversations.columns)


def overview(conversations: DataFrame, messages: DataFrame, media_totals: DataFrame) -> DataFrame:
    """One row with the totals of an archive; each input shrinks to one row first."""
    return media_totals.select(
        conversations.agg(F.count("*")).scalar().alias("conversations"),
        messages.agg(F.count("*")).scalar().alias("messages"), "*")


def snapshot_stats(conversations: DataFrame, messages: DataFrame, media: DataFrame) -> DataFrame:
    """Totals, kinds, orphan media and messages without a conversation record."""
    missing = messages.join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti")
    counted = media.agg(
        F.count("*").alias("media"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("image", "video", "audio", "file")],
        F.count_if(F.col("conversation_id").isNull()).alias("orphans"))
    return overview(conversations, messages, counted).select(
        "*", missing.agg(F.count("*")).scalar().alias("messages_missing_conversation"))


def sync_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Growth of every counter between two one-row tables, never below zero, with a sentence."""
    names = [c for c in after.columns if c in before.columns]
    joined = after.select(F.struct("*").alias("a"), before.select(F.struct("*").alias("b")).scalar().alias("b"))
    deltas = joined.select(*[F.greatest(F.lit(0), F.col(f"a.{c}") - F.col(f"b.{c}")).cast("bigint").alias(c) for c in names])
    total = sum((F.col(c) for c in names), F.lit(0))
    noun = lambda c: F.concat(F.col(c).cast("string"), F.lit(f" {c[:-1] if c.endswith('s') else c}"),
                              F.when((F.col(c) == 1) | ~F.lit(c.endswith("s")), "").otherwise("s"))
    parts = F.concat_ws(", ", *[noun(c) for c in names])
    return deltas.withColumn("message", F.when(total > 0, F.concat(F.lit("Found and saved "), parts, F.lit("."))).otherwise(
        "No new content found."))


# ---------------------------------------------------------------- documents and reports

def conversation_titles(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Title of a conversation: its own, else the first readable message, else Untitled."""
    first = (
        messages.select("conversation_id", "seq", F.substring(S.clean(F.col("text")), 1, 160).alias("_start")).where("_start <> ''")
        .groupBy("conversation_id").agg(F.min_by("_start", "seq").alias("_first"))
        .withColumnRenamed("conversation_id", "id"))
    return conversations.join(first, "id", "left").select(
        *[c for c in conversations.columns if c != "title"], S.title_of(F.col("title"), F.col("_first")).alias("title"))


def markdown_sections(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Markdown of each conversation as sections: a head (seq -1), then one per message.

    A document is its sections in ``seq`` order.  Sections stay rows, so a very long
    conversation is written by many tasks.
    conversations: id, title, created_ms, updated_ms, message_count, media_count.
    """
    when = lambda ms: F.coalesce(S.iso_time(ms), F.lit("unknown"))
    head = conversations.select(
        F.col("id").alias("conversation_id"), F.lit(-1).cast("bigint").alias("seq"),
        F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.lit(""),
                    F.concat(F.lit("- Conversation id: "), F.col("id").cast("string")),
                    F.concat(F.lit("- Created: "), when(F.col("created_ms"))),
                    F.concat(F.lit("- Updated: "), when(F.col("updated_ms"))),
                    F.concat(F.lit("- Messages: "), F.col("message_count").cast("string")),
                    F.concat(F.lit("- Media references: "), F.col("media_count").cast("string")), F.lit("")).alias("section"))
    blank = F.lit("_No readable text captured for this message._")
    model = F.when(F.col("model").isNotNull(), F.concat(F.lit("\nModel: "), "model"))
    body = messages.select(
        "conversation_id", "seq",
        F.concat_ws("\n",
                    F.concat(F.lit("## "), S.capitalize(F.coalesce("role", F.lit("message"))), F.lit(" - "),
                             F.coalesce(S.iso_time(F.col("created_ms")), F.lit("unknown time"))),
                    model, F.lit(""), F.coalesce(F.nullif(F.col("text"), F.lit("")), blank), F.lit("")).alias("section"))
    return head.unionByName(body)


def report_messages(conversations: DataFrame, messages: DataFrame, folders: DataFrame) -> DataFrame:
    """Report rows in reading order: role label, model label, text, folder, search text.

    conversations: id, title, folder_id; folders (id, name).
    """
    placed = conversations.join(
        folders.select(F.col("id").alias("folder_id"), F.col("name").alias("folder_name")), "folder_id", "left"
    ).select(F.col("id").alias("conversation_id"), "title", "folder_name")
    role = S.report_role(F.col("role"))
    return messages.join(placed, "conversation_id").select(
        "conversation_id", "id", "seq", role.alias("role"), S.capitalize(role).alias("role_label"),
        S.model_label(F.col("model"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("model_label"),
        "title", "folder_name",
        F.lower(F.concat_ws(" ", "title", "folder_name", F.trim("text"))).alias("search_text"))


def sampled_size(records: DataFrame, group: str, order: str, size: Column, sample: int = 12) -> DataFrame:
    """Size of each store extrapolated from its first rows.

    The rank filter is applied on every partition before the shuffle.
    """
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    heads = (
        records.select(group, order, size.alias("_size")).withColumn("_rn", rank).where(F.col("_rn") <= sample)
        .groupBy(group).agg(F.avg("_size").alias("_avg")))
    counts = records.groupBy(group).agg(F.count("*").alias("records"))
    return counts.join(heads, group, "left").select(
        group, "records", F.coalesce(F.round(F.col("_avg") * F.col("records")), F.lit(0)).cast("bigint").alias("estimated_bytes"))
