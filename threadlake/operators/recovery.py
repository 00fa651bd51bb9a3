"""Recovery of older backups: one table of actions, which is reported or applied."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.ordered import last_before
from threadlake.operators.rollups import roll_up
from threadlake.session import materialize

#: Entities and the columns that identify a row of them.
KEYS = {"conversations": ["id"], "messages": ["conversation_id", "id"], "media": ["sha"]}
Tables = dict[str, DataFrame]


def actions(existing: Tables, imported: Tables) -> DataFrame:
    """What an import would do with each of its rows: (entity, key, rank, line, action).

    ``add`` for the first row of a key that is unknown, ``known`` for keys that are there, ``repeated`` for later rows of a key
    that is added, ``unusable`` for rows without a key.  imported rows carry ``rank`` (the backup's place) and ``line``,
    which are unique together; the first in that order counts.  A key with very many rows meets the joins as one.
    """
    parts = []
    for entity, keys in KEYS.items():
        rows = imported[entity]
        usable = F.lit(True)
        for key in keys:
            usable = usable & F.col(key).isNotNull() & (F.col(key).cast("string") != "")
        known = existing[entity].select(*keys).distinct().withColumn("_known", F.lit(True))
        first = rows.where(usable).groupBy(*keys).agg(F.min(F.struct("rank", "line")).alias("_first")).join(known, keys, "left")
        action = F.when(~usable, "unusable").when(F.col("_known"), "known").when(F.struct("rank", "line") == F.col("_first"), "add").otherwise("repeated")
        parts.append(rows.join(first, keys, "left").select(
            F.lit(entity).alias("entity"), F.to_json(F.struct(*keys)).alias("key"), "rank", "line", action.alias("action")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def report(planned: DataFrame) -> DataFrame:
    """Number of rows per entity and action."""
    return planned.groupBy("entity", "action").agg(F.count("*").alias("rows"))


def chosen(planned: DataFrame, imported: Tables, entity: str) -> DataFrame:
    """Rows of an import that its actions add."""
    added = planned.where((F.col("entity") == entity) & (F.col("action") == "add")).select("rank", "line")
    return imported[entity].join(added, ["rank", "line"], "left_semi")


def recover(existing: Tables, imported: Tables, base: str | None = None, run: int = 0) -> DataFrame:
    """Applies an import, or only reports it without ``base``; both come from the same actions.  Returns the report.

    Rows that are added go below ``<base>/<entity>/run=<run>``; nothing that is there is changed.  Media take conversation,
    time and, if an assistant said it, model from the backup's own message, and as prompt the user message before it.
    ``<base>/rollup/run=<run>`` has one row per conversation of the added rows with counts, models and preview, orphans
    included.  An import that was applied adds nothing when it is applied again.

    conversations: id, title, kind; messages: conversation_id, id, seq, role, text, model, created_ms;
    media: sha, media_id, message_id, bytes, file_name.
    """
    planned = materialize(actions(existing, imported), "actions")
    if base is not None:
        said = imported["messages"].join(planned.where("entity = 'messages' and action in ('add', 'known')").select("rank", "line"), ["rank", "line"], "left_semi")
        prompted = last_before(said, ["conversation_id"], "seq", ["text"], "_asked", F.col("role") == "user")
        by_id = prompted.groupBy(F.col("id").alias("message_id")).agg(F.min(F.struct(
            "rank", "line", "conversation_id", "created_ms", F.when(F.col("role") == "assistant", F.col("model")).alias("model"), F.col("_asked.text").alias("prompt"))).alias("m"))
        media = chosen(planned, imported, "media").join(by_id, "message_id", "left").select(
            "sha", "media_id", "message_id", "bytes", "file_name", "m.conversation_id", "m.created_ms", "m.model", "m.prompt")
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{base}/{name}/run={run}")
        for name, rows in (("conversations", chosen(planned, imported, "conversations")), ("messages", chosen(planned, imported, "messages"))):
            write(rows.drop("rank", "line"), name)
        write(media, "media")
        spark = media.sparkSession
        back = lambda name: spark.read.parquet(f"{base}/{name}/run={run}")
        write(roll_up(back("conversations"), back("messages"), back("media")), "rollup")
    return report(planned)


def with_recovered(existing: Tables, base: str) -> Tables:
    """Existing tables and what was recovered below ``base``, by key."""
    out = {}
    for entity, keys in KEYS.items():
        rows = existing[entity].select(*keys)
        try:
            rows = rows.unionByName(rows.sparkSession.read.parquet(f"{base}/{entity}").select(*keys))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        out[entity] = rows
    return out
