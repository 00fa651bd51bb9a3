"""Conversation report: messages and their blocks in one reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions import records as R
from threadlake.functions import scalars as S
from threadlake.operators import nested as N
from threadlake.operators.ordered import running_total


def blocks_of(record: Column, message_id: Column) -> Column:
    """Blocks (type, kind, url, text) of a message: agent segments if it has output items, else text and media in order.

    A tool's ``kind`` is its name and phase, its ``text`` what was asked, passed or returned.
    """
    items = R.child(record, "output_items")
    tool = lambda s: F.nullif(F.concat_ws(":", s["tool"], s["phase"]), F.lit(""))
    segments = F.transform(N.output_segments(items), lambda s: F.struct(
        s["type"].alias("type"), tool(s).alias("kind"), F.get(s["sources"], F.lit(0))["url"].alias("url"),
        F.coalesce(s["text"], s["query"], s["arguments"], s["output"]).alias("text")))
    return F.when(F.size(segments) > 0, segments).otherwise(N.message_blocks(record, message_id))


def report_sections(conversations: DataFrame, messages: DataFrame, folders: DataFrame) -> DataFrame:
    """Report rows in reading order: each message is a row, followed by one row for each of its blocks.

    A row stands at ``position`` of its conversation and what it holds ends at ``until``: a message's interval contains those
    of its blocks, so a page or a section is a range of positions.  Positions are running sums over the number of blocks,
    taken block by block of ``seq``; no conversation is one task's work or one value.

    conversations: id, title, folder_id; folders: id, name; messages: conversation_id, id, seq (unique in a conversation),
    role, model, record (VARIANT).
    """
    placed = conversations.join(folders.select(F.col("id").alias("folder_id"), F.col("name").alias("folder_name")), "folder_id", "left").select(
        F.col("id").alias("conversation_id"), "title", "folder_name")
    role = S.report_role(F.col("role"))
    none = F.lit(None).cast("string")
    read = messages.select(
        "conversation_id", F.col("id").alias("message_id"), "seq", role.alias("role"), S.model_label(F.col("model"), none, none).alias("model_label"),
        blocks_of(F.col("record"), F.col("id")).alias("blocks"))
    numbered = running_total(read, ["conversation_id"], "seq", F.size("blocks") + 1, "start")
    head = F.struct(F.lit("message").alias("type"), S.capitalize(F.col("role")).alias("kind"), none.alias("url"), none.alias("text"))
    rows = numbered.join(placed, "conversation_id").select(
        "conversation_id", "title", "folder_name", "message_id", "role", "model_label", "start", F.size("blocks").alias("size"), F.posexplode(F.concat(F.array(head), F.col("blocks"))).alias("at", "block"))
    position = F.col("start") + F.col("at")
    return rows.select(
        "conversation_id", "title", "folder_name", "message_id", "role", "model_label", position.alias("position"),
        F.when(F.col("at") == 0, F.col("start") + F.col("size")).otherwise(position).alias("until"), "block.type", "block.kind", "block.url", "block.text",
        F.lower(F.when(F.col("at") == 0, F.concat_ws(" ", "title", "folder_name")).when(F.col("block.type") == "text", F.col("block.text"))).alias("search_text"))
