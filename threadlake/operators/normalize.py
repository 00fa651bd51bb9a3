"""Records of any store become rows of the conversation, message and media tables.

Input: store, line_no, record (VARIANT).  Every logical column is the first of its
field aliases that carries a value, looked up through the envelopes of a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake import constants as K
from threadlake.functions import media as M
from threadlake.functions import predicates as P
from threadlake.functions import records as R
from threadlake.functions import scalars as S


_R = "r"


def routed(records: DataFrame, *targets: str) -> DataFrame:
    """Records whose store belongs to one of the target tables, with envelopes opened."""
    rows = records.where(P.store_target(F.col("store")).isin(*targets))
    return R.unwrap(rows).drop("record")


def _fallback() -> Column:
    return F.concat_ws("-", "store", F.col("line_no").cast("string"))


def _time(names) -> Column:
    return S.to_millis(R.first_value(_R, names))


def conversations(records: DataFrame) -> DataFrame:
    rows = routed(records, "conversation", "studio_session").withColumn(
        "body", F.coalesce(R.lookup(_R, "preview"), R.lookup(_R, "summary")))
    staged = rows.select(
        "store", "line_no", R.record_id(_R, _fallback()).alias("id"),
        R.first_value(_R, K.TITLE_FIELDS).alias("title"),
        R.first_text(_R, ("studioType", "studio_type")).alias("explicit"),
        _time(K.CREATED_FIELDS).alias("created_ms"), _time(K.UPDATED_FIELDS).alias("updated_ms"),
        R.readable_text("body").alias("preview"))
    session = P.studio_type(F.col("store"))
    studio = F.coalesce(session, P.studio_conversation_type(F.col("explicit"), F.col("id")))
    default = F.when(session.isNotNull(), F.concat(S.capitalize(session), F.lit(" Studio"))).otherwise("Untitled conversation")
    return staged.select(
        "store", "line_no", "id", F.coalesce("title", default).alias("title"), P.conversation_kind(F.col("store"), studio).alias("kind"),
        studio.alias("studio_type"), "preview", "created_ms", "updated_ms")


def messages(records: DataFrame) -> DataFrame:
    rows = routed(records, "message")
    usage = F.coalesce(*[R.lookup(_R, name) for name in K.USAGE_FIELDS])
    used = lambda name: F.try_variant_get("usage", f"$.{name}", "string")
    tokens = lambda own, nested: R.finite_nonneg(
        *[R.text(_R, n) for n in own], *[used(n) for n in nested]).cast("bigint")
    staged = rows.withColumns({
        "usage": usage, "body": F.coalesce(*[R.lookup(_R, n) for n in K.TEXT_FIELDS]),
        "items": F.coalesce(R.lookup(_R, "output_items"), R.lookup(_R, "outputItems")),
    }).select(
        "store", "line_no", R.record_id(_R, _fallback()).alias("id"),
        F.coalesce(R.first_value(_R, K.CONVERSATION_ID_FIELDS), F.lit("recovered")).alias("conversation_id"),
        F.coalesce(R.first_value(_R, K.ROLE_FIELDS), F.lit("unknown")).alias("source_role"),
        R.first_text(_R, K.MODEL_FIELDS).alias("model"), R.first_text(_R, K.MODEL_ID_FIELDS).alias("model_id"),
        R.first_value(_R, K.FILE_NAME_FIELDS[:2]).alias("file_name"),
        _time(K.CREATED_FIELDS).alias("created_ms"), _time(K.UPDATED_FIELDS).alias("updated_ms"),
        tokens(K.INPUT_TOKEN_FIELDS, K.INPUT_TOKEN_USAGE_FIELDS).alias("input_tokens"),
        tokens(K.OUTPUT_TOKEN_FIELDS, K.OUTPUT_TOKEN_USAGE_FIELDS).alias("output_tokens"),
        tokens(K.TOTAL_TOKEN_FIELDS, K.TOTAL_TOKEN_FIELDS).alias("explicit_tokens"),
        R.finite_nonneg(*[R.text(_R, n) for n in K.DURATION_FIELDS]).alias("execution_ms"),
        R.first_value(_R, K.STATUS_FIELDS).alias("status"),
        F.when(F.col("items").isNotNull(), F.nullif(R.response_text("items"), F.lit(""))).alias("response"),
        R.readable_text("body").alias("plain"))
    studio = P.studio_conversation_type(F.lit(None).cast("string"), F.col("conversation_id"))
    return staged.select(
        "store", "line_no", "id", "conversation_id", F.when(studio == "video", "user").otherwise(F.col("source_role")).alias("role"),
        "source_role", "model", "model_id", "file_name", studio.alias("studio_type"), "created_ms", "updated_ms", "input_tokens", "output_tokens",
        S.total_tokens(F.col("explicit_tokens"), F.col("input_tokens"), F.col("output_tokens")).alias("total_tokens"),
        "execution_ms", "status", F.coalesce("response", "plain").alias("text"))


def studio_turns(records: DataFrame) -> DataFrame:
    rows = routed(records, "studio_turn").withColumn("body", F.coalesce(R.lookup(_R, "prompt"), R.lookup(_R, "text")))
    return rows.select(
        "store", "line_no", R.record_id(_R, _fallback()).alias("id"), R.first_text(_R, ("sessionId", "session_id")).alias("session_id"),
        P.studio_type(F.col("store")).alias("studio_type"),
        R.readable_text("body").alias("prompt"), _time(K.CREATED_FIELDS).alias("created"))


def media(records: DataFrame) -> DataFrame:
    rows = routed(records, "media").withColumn("body", F.coalesce(R.lookup(_R, "prompt"), R.lookup(_R, "text")))
    mime = R.first_value(_R, K.MIME_FIELDS)
    return rows.select(
        F.col("store").alias("source"), "line_no", R.record_id(_R, _fallback()).alias("media_id"),
        R.first_value(_R, K.MEDIA_CONVERSATION_FIELDS).alias("conversation_id"), R.first_value(_R, K.MEDIA_MESSAGE_FIELDS).alias("message_id"),
        R.first_value(_R, K.FILE_NAME_FIELDS).alias("file_name"), mime.alias("mime_type"), M.media_kind(mime, F.col("store")).alias("kind"),
        R.readable_text("body").alias("prompt"),
        R.first_text(_R, K.MODEL_FIELDS).alias("model"),
        M.media_disposition(R.first_text(_R, K.DISPOSITION_FIELDS), F.col("store")).alias("disposition"),
        _time(K.CREATED_FIELDS).alias("created_ms"), F.lit("source-record").alias("status"))
