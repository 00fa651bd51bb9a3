"""Generators over nested records: agent segments, media candidates, blocks, deep walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlake import constants as K
from threadlake.functions import media as M
from threadlake.functions import records as R
from threadlake.functions import scalars as S

URL_FIELDS = ("url", "mediaUrl", "media_url", "downloadUrl", "download_url", "src", "fileUrl", "file_url")


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def array_of(value: Column) -> Column:
    """Elements of a VARIANT array; empty for anything else."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def cleaned(value: Column, *names: str) -> Column:
    """First member with cleaned text, else the empty text."""
    if len(names) < 3:
        return S.first_nonempty(*[R.as_text(R.child(value, name)) for name in names])
    listed = F.array(*[F.lit(name) for name in names])

    def first(members: Column) -> Column:
        texts = F.transform(listed, lambda name: S.clean(R.as_text(F.try_element_at(members, name))))
        return F.get(F.filter(texts, lambda text: text != ""), F.lit(0))

    return F.coalesce(R.bind(R.fields(value), first), F.lit(""))


def present(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def guessed_kind(hint: Column, mime: Column, url: Column) -> Column:
    fields = F.struct(hint.alias("hint"), mime.alias("mime"), url.alias("url"))
    return R.bind(fields, lambda f: M.classify_kind(f["hint"], f["mime"], f["url"]))


# ---------------------------------------------------------------- agent messages

def content_text(content: Column) -> Column:
    """Readable text of a content value: a string, or parts joined by a blank line."""
    def part(item: Column) -> Column:
        return (
            F.when(R.kind_of(item) == "string", F.trim(R.as_text(item)))
            .when(R.kind_of(item) == "object", cleaned(item, "text", "content", "summary", "value", "delta"))
            .otherwise("")
        )

    parts = F.filter(F.transform(array_of(content), part), lambda text: text != "")
    return F.when(R.kind_of(content) == "string", S.clean(R.as_text(content))).otherwise(
        F.trim(F.array_join(parts, "\n\n"))
    )


def _json_or_text(value: Column) -> Column:
    """A JSON text in canonical form; text that is no JSON stays as it is."""
    text = R.as_text(value)
    return F.when(R.kind_of(value) == "string", F.coalesce(F.to_json(R.parse(text)), text)).otherwise(F.to_json(value))


_CALLS = ("serverFunctionCall", "functionCall", "mcpCall")
_OUTPUTS = ("serverFunctionCallOutput", "functionCallOutput", "mcpCallOutput")


def output_segments(items: Column) -> Column:
    """Ordered segments of an agent message.

    A tool output takes its name from the latest earlier call with the same call id.
    """
    def describe(item: Column, i: Column) -> Column:
        kind = cleaned(item, "type")
        return F.struct(
            i.alias("i"), item.alias("item"), kind.alias("kind"),
            present(cleaned(item, "name")).alias("name"),
            F.when(kind.isin(*_CALLS), cleaned(item, "call_id", "callId", "id"))
            .otherwise(cleaned(item, "call_id", "callId")).alias("call_id"),
            content_text(R.child(item, "content")).alias("text"),
        )

    objects = F.filter(array_of(items), lambda item: R.kind_of(item) == "object")
    described = F.transform(objects, describe)

    def sources(item: Column) -> Column:
        pairs = F.transform(array_of(R.child(item, "sources")), lambda s: F.struct(
            present(cleaned(s, "url", "link")).alias("url"), present(cleaned(s, "title", "name")).alias("title")))
        return F.filter(pairs, lambda p: p["url"].isNotNull() | p["title"].isNotNull())

    def segment(d: Column, all_items: Column) -> Column:
        item, kind = d["item"], d["kind"]
        earlier = F.filter(all_items, lambda e: (
            e["kind"].isin(*_CALLS) & (e["i"] < d["i"]) & (e["call_id"] == d["call_id"]) & (e["call_id"] != "")))
        call_name = F.coalesce(F.try_element_at(earlier, F.lit(-1))["name"],
                               F.when(F.size(earlier) > 0, "function"))
        tool = (
            F.when(kind == "webSearch", "web_search")
            .when(kind.isin(*_CALLS), F.coalesce(d["name"], F.lit("function")))
            .when(kind.isin(*_OUTPUTS), F.coalesce(call_name, d["name"], F.lit("function")))
        )
        reasoning = S.first_nonempty(d["text"], R.as_text(R.child(item, "summary")))
        seg_type = (
            F.when(kind == "reasoning", "reasoning").when(tool.isNotNull(), "tool").otherwise("text")
        )
        text = F.when(kind == "reasoning", reasoning).when(tool.isNull(), d["text"])
        return F.struct(
            seg_type.alias("type"), tool.alias("tool"),
            F.when(kind.isin(*_CALLS), "call").when(kind.isin(*_OUTPUTS), "output").alias("phase"),
            F.when(kind == "webSearch", present(cleaned(item, "query"))).alias("query"),
            text.alias("text"),
            F.when(kind == "webSearch", sources(item)).alias("sources"),
            F.when(kind.isin(*_CALLS), _json_or_text(R.child(item, "arguments"))).alias("arguments"),
            F.when(kind.isin(*_OUTPUTS), _json_or_text(R.child(item, "output"))).alias("output"),
        )

    segments = R.bind(described, lambda all_items: F.transform(all_items, lambda d: segment(d, all_items)))
    return F.filter(segments, lambda s: (s["type"] == "tool") | (s["text"] != ""))


def visible_text(segments: Column) -> Column:
    """Text segments only, joined by a blank line."""
    shown = F.filter(segments, lambda s: s["type"] == "text")
    return F.trim(F.array_join(F.transform(shown, lambda s: s["text"]), "\n\n"))


def agent_conversations(df: DataFrame, record: str = "record") -> DataFrame:
    """Agent conversation records; rows without an id are skipped."""
    v = F.col(record)
    number = lambda name: R.as_text(R.child(v, name)).try_cast("bigint")
    title = F.coalesce(present(cleaned(v, "name", "title")), F.lit("Agentic session"))
    created = number("createdAtUnixTimestamp")
    return df.select(
        "*", present(cleaned(v, "id")).alias("id"), title.alias("title"), created.alias("created"),
        F.coalesce(F.when(number("updatedAtUnixTimestamp") != 0, number("updatedAtUnixTimestamp")), created).alias("updated"),
        F.lit("agent").alias("kind"),
    ).where("id is not null").drop(record)


def agent_messages(df: DataFrame, record: str = "record") -> DataFrame:
    """Agent message records with segments; rows without a conversation are skipped."""
    v = F.col(record)
    number = lambda *names: F.coalesce(*[
        F.when(R.as_text(R.child(v, n)).try_cast("bigint") != 0, R.as_text(R.child(v, n)).try_cast("bigint")) for n in names])
    conversation = present(cleaned(v, "mind_conversation_id", "mindConversationId", "conversationId"))
    created = number("created_at_unix_timestamp", "createdAtUnixTimestamp")
    staged = df.select(
        "*", conversation.alias("conversation_id"),
        F.coalesce(present(cleaned(v, "id")), F.concat(
            conversation, F.lit("-"), F.coalesce(number("created_at_unix_timestamp"), F.lit(0)).cast("string"))).alias("id"),
        S.agent_role(R.as_text(R.child(v, "role"))).alias("role"), created.alias("created"),
        present(cleaned(v, "model", "modelId", "model_id", "modelName", "model_name")).alias("model"),
        output_segments(F.coalesce(R.child(v, "output_items"), R.child(v, "outputItems"))).alias("segments"),
        cleaned(v, "text", "content", "input").alias("_fallback"),
    ).where("conversation_id is not null").drop(record)
    shown = visible_text(F.col("segments"))
    return staged.withColumn("text", F.coalesce(present(shown), F.col("_fallback"))).drop("_fallback")


# ---------------------------------------------------------------- support threads

def support_messages(df: DataFrame) -> DataFrame:
    """One question/answer record becomes up to two messages.

    Input columns: id, thread_id, question, answer, content, role, created.
    """
    text = lambda c: S.clean(F.col(c))
    asked = (text("question") != "") | (text("answer") != "")
    def message(suffix: str, role: Column, content: Column) -> Column:
        return F.struct(F.concat(F.lit("support:"), "id", F.lit(suffix)).alias("id"), role.alias("role"), content.alias("text"))
    parts = F.when(asked, F.array(
        message(":question", F.lit("user"), text("question")), message(":answer", F.lit("assistant"), text("answer"))
    )).otherwise(F.array(message("", S.report_role(F.coalesce("role", F.lit("assistant"))), text("content"))))
    rows = df.withColumn("_part", F.explode(F.filter(parts, lambda p: p["text"] != "")))
    return rows.select(
        F.col("_part.id").alias("id"),
        F.concat(F.lit("support:"), F.coalesce(present(text("thread_id")), F.lit("unknown"))).alias("conversation_id"),
        F.col("_part.role").alias("role"), F.col("_part.text").alias("text"), "created",
    )


def support_threads(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads with fallback titles and times, plus threads only messages know.

    The first message is the one with the smallest (created, id).
    """
    order = F.struct("created", "id")
    starts = messages.select("conversation_id", "id", "created", F.substring("text", 1, 200).alias("_start"))
    first = starts.groupBy("conversation_id").agg(
        F.min_by("_start", order).alias("_first_text"),
        F.min("created").alias("_first"), F.max("created").alias("_last"))
    known = threads.select(
        F.concat(F.lit("support:"), "id").alias("conversation_id"), "name", F.lit(True).alias("known"),
        F.col("created").alias("_created"), F.col("updated").alias("_updated"))
    joined = known.join(first, "conversation_id", "full_outer")
    return joined.select(
        F.col("conversation_id").alias("id"), S.title_of(F.col("name"), F.col("_first_text")).alias("title"),
        F.coalesce("_created", "_first").alias("created"), F.coalesce("_updated", "_last").alias("updated"),
        F.col("known").isNull().alias("orphan"), F.lit("support").alias("kind"))


# ---------------------------------------------------------------- studio records

def studio_queue(df: DataFrame) -> DataFrame:
    """Queue state saved as JSON text: an array or one object gives rows; the rest is skipped.

    Input columns: key, value, redacted.
    """
    parsed = R.parse("value")
    kind = R.kind_of(parsed)
    items = F.when(kind == "array", array_of(parsed)).when(kind == "object", F.array(parsed))
    rows = df.where(~F.coalesce("redacted", F.lit(False)) & F.trim("key").rlike(K.STUDIO_QUEUE_KEY))
    return (
        rows.select("*", F.posexplode(items).alias("index", "record"))
        .where(R.kind_of(F.col("record")) == "object").drop("value", "redacted")
    )


def studio_conversations(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Studio sessions as conversations; turns without a session get a synthesized one.

    sessions: id, title, studio_type, created; turns: id, session_id, studio_type, prompt, created.
    """
    default = F.concat(S.capitalize(F.col("studio_type")), F.lit(" Studio"))
    titled = sessions.select("id", F.coalesce(S.first_string(F.col("title")), default).alias("title"), "studio_type", "created")
    missing = (
        turns.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti")
        .groupBy(F.col("session_id").alias("id"))
        .agg(F.min_by("studio_type", F.struct("created", "id")).alias("studio_type"), F.min("created").alias("created"))
        .select("id", default.alias("title"), "studio_type", "created")
    )
    return titled.unionByName(missing).withColumn("kind", F.lit("studio"))


def studio_messages(turns: DataFrame) -> DataFrame:
    """Turns as user messages; a turn without a session belongs to ``recovered``."""
    return turns.select(
        "id", F.coalesce(S.first_string(F.col("session_id").cast("string")), F.lit("recovered")).alias("conversation_id"),
        F.lit("user").alias("role"), F.coalesce("prompt", F.lit("")).alias("text"), "created", "studio_type")


# ---------------------------------------------------------------- media candidates of a message

def message_media(message: Column, message_id: Column) -> Column:
    """Array of candidates: content parts, attachments, URL fields, id arrays."""
    none = _none()

    def candidate(item: Column, source, forced=None, cid: Column | None = None, url: Column | None = None) -> Column:
        url = present(cleaned(item, *URL_FIELDS)) if url is None else url
        mime = present(cleaned(item, "mimeType", "mime_type", "contentType", "mediaType", "fileType", "mime")) if item is not None else none
        kind = F.lit(forced) if forced else guessed_kind(
            S.first_nonempty(R.as_text(R.child(item, "type")), R.as_text(R.child(item, "kind"))) if item is not None else none, mime, url)
        return F.struct(
            (cid if cid is not None else present(cleaned(item, "id"))).alias("id"), url.alias("url"), mime.alias("mime_type"),
            kind.alias("kind"),
            (present(cleaned(item, "fileName", "filename", "name")) if item is not None else none).alias("file_name"),
            (F.lit(source) if isinstance(source, str) else source).alias("source"),
        )

    def link(part: Column, name: str) -> Column:
        value = R.child(part, name)
        return F.when(R.kind_of(value) == "string", present(S.clean(R.as_text(value)))).otherwise(present(cleaned(value, *URL_FIELDS)))

    def from_part(part: Column) -> Column:
        kind = cleaned(part, "type")
        return (
            F.when(R.child(part, "image_url").isNotNull(), candidate(part, "message.content.image_url", "image", url=link(part, "image_url")))
            .when(R.child(part, "video_url").isNotNull(), candidate(part, "message.content.video_url", "video", url=link(part, "video_url")))
            .otherwise(candidate(part, F.concat(F.lit("message.content."), F.coalesce(present(kind), F.lit("asset")))))
        )

    parts = F.filter(array_of(R.child(message, "content")), lambda p: (R.kind_of(p) == "object") & (cleaned(p, "type") != "text"))
    attachments = F.transform(
        array_of(R.child(message, "attachments")),
        lambda a, i: candidate(a, "message.attachments", cid=F.coalesce(
            present(cleaned(a, "id")),
            F.concat(F.coalesce(message_id, F.lit("message")), F.lit("-attachment-"), (i + 1).cast("string")))))

    def by_field(name: str, forced: str | None) -> Column:
        url = present(S.clean(R.as_text(R.child(message, name))))
        kind = F.lit(forced) if forced else guessed_kind(none, none, url)
        made = F.struct(none.alias("id"), url.alias("url"), none.alias("mime_type"), kind.alias("kind"),
                        none.alias("file_name"), F.lit(f"message.{name}").alias("source"))
        return F.filter(F.array(made), lambda c: c["url"].isNotNull())

    def by_ids(name: str, forced: str) -> Column:
        ids = F.filter(F.transform(array_of(R.child(message, name)), lambda v: S.clean(R.as_text(v))), lambda t: t != "")
        return F.transform(ids, lambda i: F.struct(
            i.alias("id"), none.alias("url"), none.alias("mime_type"), F.lit(forced).alias("kind"),
            none.alias("file_name"), F.lit(f"message.{name}").alias("source")))

    groups = [F.transform(parts, from_part), attachments]
    groups += [by_field(*pair) for pair in (
        ("imageUrl", "image"), ("videoUrl", "video"), ("fileUrl", "file"), ("mediaUrl", None), ("previewUrl", "image"))]
    groups += [by_ids(*pair) for pair in (
        ("messageImageAttachmentIds", "image"), ("messageVideoAttachmentIds", "video"),
        ("messageAudioAttachmentIds", "audio"), ("messageFileAttachmentIds", "file"))]
    return F.filter(F.concat(*groups), lambda c: c["url"].isNotNull() | c["id"].isNotNull())


def message_blocks(message: Column, message_id: Column) -> Column:
    """Text and media blocks in order; a repeated URL shows once; nothing at all gives ``empty``."""
    content = R.child(message, "content")
    none = _none()

    def text_block(text: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), none.alias("kind"), none.alias("url"), F.trim(text).alias("text"))

    def media_block(url: Column, kind: Column) -> Column:
        return F.struct(F.lit("media").alias("type"), F.when(kind == "asset", "file").otherwise(kind).alias("kind"),
                        url.alias("url"), none.alias("text"))

    def from_part(part: Column) -> Column:
        text_part = (cleaned(part, "type") == "text") & (R.kind_of(R.child(part, "text")) == "string")
        picked = F.coalesce(R.child(part, "image_url"), R.child(part, "video_url"), part)
        url = F.when(R.kind_of(picked) == "string", S.clean(R.as_text(picked))).otherwise(cleaned(picked, *URL_FIELDS))
        kind = (
            F.when(R.child(part, "image_url").isNotNull(), "image").when(R.child(part, "video_url").isNotNull(), "video")
            .otherwise(guessed_kind(R.as_text(R.child(part, "type")), R.as_text(R.child(part, "mimeType")), url))
        )
        caption = S.first_nonempty(*[R.as_text(R.child(part, n)) for n in ("text", "caption", "alt", "prompt")])
        return F.when(text_part, F.array(text_block(R.as_text(R.child(part, "text"))))).otherwise(
            F.array(media_block(url, kind), text_block(caption)))

    body = F.when(R.kind_of(content) == "string", F.array(text_block(R.as_text(content)))).otherwise(
        F.flatten(F.transform(F.filter(array_of(content), lambda p: R.kind_of(p) == "object"), from_part)))
    plain = F.when(R.kind_of(R.child(message, "text")) == "string", F.array(text_block(R.as_text(R.child(message, "text"))))) \
        .otherwise(F.array().cast("array<struct<type:string,kind:string,url:string,text:string>>"))
    extra = F.transform(message_media(message, message_id), lambda c: media_block(c["url"], F.coalesce(c["kind"], F.lit("file"))))
    blocks = F.filter(F.concat(body, plain, extra), lambda b: F.coalesce(b["url"], b["text"], F.lit("")) != "")
    def without_repeats(all_blocks: Column) -> Column:
        return F.filter(all_blocks, lambda b, i: b["url"].isNull() | (F.array_position(
            F.transform(all_blocks, lambda other: other["url"]), b["url"]) == i + 1))

    result = R.bind(blocks, without_repeats)
    empty = F.struct(F.lit("empty").alias("type"), none.alias("kind"), none.alias("url"), F.lit(K.EMPTY_MESSAGE).alias("text"))
    return R.bind(result, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(empty)))


def segment_search_text(segments: Column) -> Column:
    """Search text of agent segments, tool arguments and outputs included."""
    def one(s: Column) -> Column:
        pairs = F.transform(F.coalesce(s["sources"], F.array().cast("array<struct<url:string,title:string>>")),
                            lambda p: F.concat_ws(" ", p["title"], p["url"]))
        return F.concat_ws(" ", *[F.when(c != "", c) for c in (
            s["type"], s["tool"], s["phase"], s["query"], s["text"], F.array_join(pairs, " "), s["arguments"], s["output"])])
    return F.array_join(F.transform(segments, one), " ")


def deep_search_text(parts: list[Column], candidates: Column | None = None, segments: Column | None = None) -> Column:
    """Message fields, media fields and agent segments in one searchable text."""
    texts = [F.when(p.cast("string") != "", p.cast("string")) for p in parts]
    if candidates is not None:
        texts.append(present(F.array_join(F.transform(candidates, lambda c: F.concat_ws(
            " ", c["id"], c["file_name"], c["mime_type"], c["source"])), " ")))
    if segments is not None:
        texts.append(present(segment_search_text(segments)))
    return F.concat_ws(" ", *texts)


# ---------------------------------------------------------------- deep walks

#: Rows a walk hands on at once.
WALKED = 20_000


def walk(df: DataFrame, keys: list[str], record: str, depth: int | None = None, skip: tuple[str, ...] = ("__encryptedData",),
         closed: str | None = None, blobs: bool = False, empty: bool = False) -> DataFrame:
    """Every scalar below a record, with its path, the key it stands under and its depth; to the end unless ``depth`` says less.

    ``value`` is a VARIANT; ``text`` is the same for a string, without the cost of one, and null for anything else.

    ``closed`` is a pattern: what stands under a key that matches it (without ``-``, ``_`` and ``.``) is one row and is not
    opened.  With ``blobs`` objects of more than 64 numeric keys are byte blobs and not opened either; with ``empty``
    empty containers are rows.  A walk to the end goes through each record once, in one narrow pass over Arrow batches; one of
    a stated depth opens containers level by level, with the same rows.
    """
    if depth is None:
        staged = df.select(*keys, F.to_json(record).alias("_record"))
        schema = T.StructType([
            *(df.select(*keys).schema.fields), T.StructField("path", T.StringType()), T.StructField("hint", T.StringType()),
            T.StructField("trail", T.ArrayType(T.IntegerType())), T.StructField("depth", T.IntegerType()),
            T.StructField("text", T.StringType()), T.StructField("_other", T.StringType())])
        found = staged.mapInArrow(_walked(keys, skip, closed, blobs, empty), schema)
        value = F.when(F.col("text").isNotNull(), F.col("text").cast("variant")).otherwise(F.parse_json("_other"))
        return found.select(*keys, value.alias("value"), "path", "hint", "trail", "depth", "text")
    spark = df.sparkSession
    rows = df.select(
        *keys, F.col(record).alias("value"), F.lit("").alias("path"), F.lit("").alias("hint"),
        F.array().cast("array<int>").alias("trail"), F.lit(0).alias("depth"))
    columns = ", ".join(f"t.{k}" for k in keys)
    skipped = ", ".join(f"'{name}'" for name in skip)

    def to_open(rows: DataFrame) -> DataFrame:
        members = F.col("members")
        shut = _typed_payload(members)
        if blobs:
            shut = shut | ((F.size(members) > 64) & F.forall(F.map_keys(members), lambda k: k.rlike(r"^\d+$")))
        listed = F.try_variant_get("value", "$", "array<variant>")
        some = (F.size(listed) > 0) | (F.size(members) > 0) if empty else F.lit(True)
        wanted = (listed.isNotNull() | (members.isNotNull() & ~shut)) & some
        if closed:
            wanted = wanted & ~F.regexp_replace("hint", "[-_.]", "").rlike(closed)
        return rows.withColumn("members", R.fields(F.col("value"))).withColumn("open", F.when(wanted, F.col("value")))

    for _ in range(depth):
        rows = spark.sql(f"""
            select {columns},
                   case when t.open is null then t.value else e.value end as value,
                   case when t.open is null then t.path
                        else concat_ws('.', nullif(t.path, ''), coalesce(e.key, cast(e.pos as string))) end as path,
                   case when t.open is null then t.hint else coalesce(e.key, t.hint) end as hint,
                   case when t.open is null then t.trail else concat(t.trail, array(e.pos)) end as trail,
                   case when t.open is null then t.depth else t.depth + 1 end as depth
            from {{opened}} t, lateral variant_explode_outer(t.open) e
            where t.open is null or e.pos is not null and coalesce(e.key, '') not in ({skipped})
        """, opened=to_open(rows))
    return rows.withColumn("text", F.when(R.kind_of(F.col("value")) == "string", R.as_text(F.col("value"))))


class _Saved(str):
    """A number as it is written."""


def _walked(names: list[str], skip: tuple[str, ...], closed: str | None, blobs: bool, empty: bool):
    """Function that opens the containers of JSON texts to the end, for :func:`walk`."""
    import json
    import re

    shut_keys: dict[str, bool] = {}

    def shut_by(hint: str) -> bool:
        if hint not in shut_keys:
            if len(shut_keys) > 100_000:
                shut_keys.clear()
            shut_keys[hint] = bool(re.search(closed, re.sub("[-_.]", "", hint)))
        return shut_keys[hint]

    def is_blob(members: dict) -> bool:
        if members.get("encoding") == "base64" and isinstance(members.get("data"), (str, int, float, bool)):
            return True
        return blobs and len(members) > 64 and all(re.fullmatch("[0-9]+", k) for k in members)

    def text(value) -> str:
        if isinstance(value, _Saved):
            return str(value)
        if isinstance(value, dict):
            return "{" + ",".join(json.dumps(k) + ":" + text(v) for k, v in value.items()) + "}"
        if isinstance(value, list):
            return "[" + ",".join(map(text, value)) + "]"
        return json.dumps(value)

    def run(batches):
        import pyarrow as pa

        decode = json.JSONDecoder(parse_float=_Saved, parse_int=_Saved).decode
        for batch in batches:
            which, path, hint, trail, depth, strings, others = out = [], [], [], [], [], [], []

            def told():
                kept = batch.select(names).take(pa.array(which, pa.int64()))
                made = [pa.array(path, pa.string()), pa.array(hint, pa.string()), pa.array(trail, pa.list_(pa.int32())), pa.array(depth, pa.int32()),
                        pa.array(strings, pa.string()), pa.array(others, pa.string())]
                return pa.RecordBatch.from_arrays([*kept.columns, *made], [*names, "path", "hint", "trail", "depth", "text", "_other"])

            for i, record in enumerate(batch.column("_record").to_pylist()):
                stack = [(None if record is None else decode(record), "", "", (), 0)]
                while stack:
                    value, at, under, steps, level = stack.pop()
                    kind = type(value)
                    if (kind is not dict and kind is not list) or (empty and not value) or (closed and shut_by(under)) or (kind is dict and is_blob(value)):
                        which.append(i)
                        path.append(at)
                        hint.append(under)
                        trail.append(steps)
                        depth.append(level)
                        strings.append(value if kind is str else None)
                        others.append(None if kind is str or record is None else text(value))
                    elif kind is dict:
                        stack.extend([(v, f"{at}.{k}" if at and k else at or k, k, (*steps, p), level + 1) for p, (k, v) in enumerate(value.items()) if k not in skip][::-1])
                    else:
                        stack.extend([(v, f"{at}.{p}" if at else str(p), under, (*steps, p), level + 1) for p, v in enumerate(value)][::-1])
                if len(which) >= WALKED:
                    yield told()
                    for column in out:
                        column.clear()
            yield told()

    return run


def _typed_payload(members: Column) -> Column:
    """Members of an object that carries base64 data itself: one payload, not a container."""
    text = lambda name: R.as_text(F.try_element_at(members, F.lit(name)))
    return F.coalesce((text("encoding") == "base64") & text("data").isNotNull(), F.lit(False))


def deep_references(df: DataFrame, keys: list[str], record: str = "record", depth: int | None = None) -> DataFrame:
    """Distinct media references anywhere in a record, first occurrence kept; byte blobs are not opened."""
    from threadlake.operators.ordered import first_of_group
    texts = walk(df, keys, record, depth, blobs=True).where("text is not null").withColumnRenamed("text", "url").drop("value")
    found = texts.where(R.bind(F.col("url"), lambda url: M.looks_like_reference(url, F.col("hint"))))
    return first_of_group(found, [*keys, "url"], ["trail"], ["hint", "path", "trail"])


def deep_payloads(df: DataFrame, keys: list[str], record: str = "record", depth: int | None = None, tag: str = "__archive") -> DataFrame:
    """Embedded payloads anywhere in a record, with their path and MIME type; ``tag`` starts the format's own keys."""
    rows = walk(df, keys, record, depth, ("__encryptedData", f"{tag}Redacted"))
    key = F.lower("hint")
    closed = key.contains("opaque") | key.contains("encrypted")
    may_hold = key.rlike("data|blob|file|payload|bytes|binary|base64|result|content")
    payload = lambda body, mime: F.struct(body.alias("base64"), mime.alias("mime_type"))

    def of_text(text: Column) -> Column:
        by_url = payload(F.regexp_extract(text, "(?s)^[^,]*,(.*)$", 1), present(F.regexp_extract(text, "(?i)^data:([^;,]+)[;,]", 1)))
        return (
            F.when(text.startswith("__") | closed, None).when(text.startswith("data:"), by_url)
            .when(may_hold & M.is_base64_payload(text), payload(text, _none()))
        )

    def of_object(members: Column) -> Column:
        data = R.as_text(F.try_element_at(members, F.lit("data")))
        return F.when(_typed_payload(members) & M.is_base64_text(data), payload(
            data, R.as_text(F.try_element_at(members, F.lit("mimeType")))))

    found = F.when(F.col("text").isNotNull(), R.bind(F.trim("text"), of_text)).otherwise(R.bind(R.fields(F.col("value")), of_object))
    # a condition on what was found would find it a second time; a list of one or none does not
    found = F.filter(F.array(found), lambda f: f["base64"] != "")
    return rows.select(*keys, "path", "trail", F.explode(found).alias("found")).select(
        *keys, "path", "trail", F.regexp_replace("found.base64", r"\s+", "").alias("base64"), "found.mime_type")


def structured_media(records: DataFrame, config: DataFrame, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Media of structured studio stores: references, or one embedded placeholder per record.

    records: store, record_id, record, inline; config: store, label, default_kind,
    metadata_only; turns: store, turn_id, session_id, conversation_id; sessions: store, session_id, conversation_id.
    """
    keys = ["store", "record_id"]
    refs = deep_references(records, keys)
    v = F.col("record")
    base = (
        records.join(config, "store")
        .select(*keys, "label", "default_kind", "metadata_only", "inline",
                R.as_text(R.child(v, "turnId")).alias("turn_id"), R.as_text(R.child(v, "sessionId")).alias("session_id"),
                R.as_text(R.child(v, "conversationId")).alias("own_conversation"),
                R.as_text(R.child(v, "mimeType")).alias("mime_type"))
    )
    context = (
        base.join(turns.select("store", "turn_id", F.col("session_id").alias("turn_session"),
                               F.col("conversation_id").alias("turn_conversation"), F.lit(True).alias("has_turn")), ["store", "turn_id"], "left")
        .withColumn("session_id", F.coalesce("session_id", "turn_session"))
        .join(sessions.select("store", "session_id", F.col("conversation_id").alias("session_conversation"),
                              F.lit(True).alias("has_session")),
              ["store", "session_id"], "left")
        .withColumn("conversation_id", F.coalesce("own_conversation", "turn_conversation", "session_conversation"))
    )
    rows = context.join(refs.select(*keys, "url", "hint"), keys, "left").where(
        F.col("url").isNotNull() | F.col("inline") | F.col("metadata_only"))
    guessed = guessed_kind(F.col("hint"), F.col("mime_type"), F.col("url"))
    return rows.select(
        *keys, "conversation_id", "url",
        F.when(guessed == "asset", F.col("default_kind")).otherwise(guessed).alias("kind"),
        F.concat("label", F.when(F.col("url").isNotNull(), ".reference").otherwise(".embedded")).alias("source"),
        F.coalesce("conversation_id", F.col("has_turn").cast("string"), F.col("has_session").cast("string")).isNull().alias("orphaned"))


def store_media_records(df: DataFrame, default_kinds: dict[str, str]) -> DataFrame:
    """Media records of the known stores in one shape; the default kind goes by store.

    Input columns: store, record.  Rows with no URL, payload or id are dropped.
    """
    v = F.col("record")
    kinds = F.create_map(*[F.lit(x) for pair in default_kinds.items() for x in pair])
    inline = F.coalesce(*[R.child(v, n) for n in ("contentBinary", "content_binary", "data", "base64", "bytes")]).isNotNull()
    return df.where(F.col("store").isin(*default_kinds)).select(
        "store", present(cleaned(v, "id")).alias("id"),
        present(cleaned(v, "conversationId", "mindConversationId", "mind_conversation_id")).alias("conversation_id"),
        present(cleaned(v, "messageId", "mindMessageId", "mind_message_id")).alias("message_id"),
        present(cleaned(v, *URL_FIELDS)).alias("url"),
        present(cleaned(v, "mimeType", "mime_type", "contentType", "content_type")).alias("mime_type"),
        present(cleaned(v, "filename", "fileName", "name")).alias("file_name"),
        present(cleaned(v, "prompt", "promptText", "caption")).alias("prompt"),
        inline.alias("inline"), F.element_at(kinds, F.col("store")).alias("default_kind"),
    ).where("url is not null or inline or id is not null")


# ---------------------------------------------------------------- transport values

def decode_transport(value: Column, tag: str = "__archive") -> Column:
    """Struct with the typed value of a tagged transport object; ``tag`` starts the format's own keys."""
    kind = R.as_text(R.child(value, f"{tag}Type"))
    text = R.as_text(R.child(value, "value"))
    encoded = R.as_text(R.child(value, "data"))
    number = F.when(kind == "number", text.try_cast("double")).when(R.kind_of(value) == "number", R.as_text(value).try_cast("double"))
    return F.struct(
        F.coalesce(kind, R.kind_of(value)).alias("type"),
        number.alias("number"),
        F.when(kind == "bigint", text.try_cast("decimal(38,0)")).alias("bigint"),
        F.when(kind == "date", F.unix_millis(F.try_to_timestamp(text))).alias("at_ms"),
        F.when(R.as_text(R.child(value, "encoding")) == "base64", F.try_to_binary(encoded, F.lit("base64"))).alias("content"),
        F.when(kind == "map", F.transform(array_of(R.child(value, "entries")), lambda e: F.struct(
            F.to_json(F.get(array_of(e), F.lit(0))).alias("key"), F.to_json(F.get(array_of(e), F.lit(1))).alias("value")))).alias("entries"),
        F.when(kind == "set", F.transform(array_of(R.child(value, "values")), lambda e: F.to_json(e))).alias("members"),
        F.when(R.kind_of(value) == "string", R.as_text(value)).alias("text"),
    )


def redacted_fields(df: DataFrame, keys: list[str], record: str = "record", depth: int | None = None) -> DataFrame:
    """Scalars and empty containers of a record by path; the whole value under a credential key is one blank row."""
    from threadlake.functions.predicates import sensitive_field
    rows = walk(df, keys, record, depth, closed=K.SENSITIVE_FIELD, empty=True)
    hit = sensitive_field(F.col("hint"))
    return rows.select(*keys, "path", hit.alias("redacted"), F.when(~hit, F.coalesce("text", R.as_text(F.col("value")))).alias("value"))


# ---------------------------------------------------------------- generation settings

def _setting_text(value: Column) -> Column:
    kind = R.kind_of(value)
    text = R.as_text(value)
    items = F.filter(F.transform(array_of(value), lambda v: S.clean(R.as_text(v))), lambda t: t != "")
    return (
        F.when(kind == "boolean", F.when(text == "true", "Yes").otherwise("No"))
        .when(kind == "array", F.array_join(items, ", "))
        .when(kind == "object", F.to_json(value))
        .otherwise(S.clean(text))
    )


def settings_entries(kind: Column, settings: Column) -> Column:
    """Label and value pairs of generation settings; blank values are dropped."""
    listed = lambda pairs: F.array(*[F.struct(F.lit(label).alias("label"), F.lit(name).alias("name")) for label, name in pairs])
    members = R.fields(settings)
    side = lambda m, name: F.coalesce(present(R.as_text(F.try_element_at(m, F.lit(name)))), F.lit("?"))

    def shown(name: Column, value: Column) -> Column:
        """Text of one setting; some values read differently or are left out."""
        def rules(text: Column) -> Column:
            number = text.try_cast("double")
            return (
                F.when((name == "steps") & (number == 0), "Auto")
                .when((name == "stylePreset") & (text == "None"), None)
                .when((name == "upscaleScale") & ~F.coalesce(number > 1, F.lit(False)), None)
                .when((name == "negativePrompt") & (F.length(text) > 140), F.concat(F.substring(text, 1, 137), F.lit("...")))
                .otherwise(text)
            )
        return R.bind(_setting_text(value), rules)

    def entries(m: Column) -> Column:
        sized = F.coalesce(F.try_element_at(m, F.lit("width")), F.try_element_at(m, F.lit("height"))).isNotNull()
        canvas = F.when(sized & (kind != "video"), F.concat(side(m, "width"), F.lit(" x "), side(m, "height")))
        head = F.array(F.struct(F.lit("Canvas").alias("label"), canvas.alias("value")))
        pairs = F.when(kind == "video", listed(K.VIDEO_SETTINGS)).otherwise(listed(K.IMAGE_SETTINGS))
        rest = F.transform(pairs, lambda p: F.struct(
            p["label"].alias("label"), R.bind(F.try_element_at(m, p["name"]), lambda v: shown(p["name"], v)).alias("value")))
        return F.filter(F.concat(head, rest), lambda e: F.coalesce(e["value"], F.lit("")) != "")

    return R.bind(members, entries)
