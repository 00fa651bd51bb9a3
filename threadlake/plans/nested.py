"""Queries over nested records: agent messages, media candidates, deep walks, transport values."""

from pyspark.sql import functions as F

from threadlake.functions import records as R
from threadlake.operators import nested as N
from threadlake.operators import report as P
from threadlake.operators import transport as V
from threadlake.plans.registry import Tables, query


def _json(*columns):
    return F.to_json(F.struct(*columns))


def _objects(*texts):
    return F.concat(F.lit("["), F.concat_ws(",", *texts), F.lit("]"))


def agent_items():
    """Six output items of an agent message, as JSON."""
    text = lambda value: F.array(F.struct(value.alias("text")))
    return _objects(
        _json(F.lit("reasoning").alias("type"), text(F.col("role")).alias("content")),
        _json(F.lit("webSearch").alias("type"), F.col("id").alias("query"), F.array(F.struct(F.lit("u").alias("link"), F.lit(" ").alias("title"))).alias("sources")),
        _json(F.lit("serverFunctionCall").alias("type"), F.concat(F.lit("f"), "seq").alias("name"), F.lit("c").alias("call_id"), F.lit('{"b":1,"a":2}').alias("arguments")),
        _json(F.lit("serverFunctionCallOutput").alias("type"), F.lit("c").alias("call_id"), F.lit("plain").alias("output")),
        _json(F.lit("message").alias("type"), F.array(F.struct(F.col("id").alias("text")), F.struct(F.lit(" x \n y").alias("text"))).alias("content")),
        _json(F.lit("custom").alias("type"), F.lit("tail").alias("content")))


_TEXT = "id || chr(10) || chr(10) || 'x y' || chr(10) || chr(10) || 'tail'"


@query("J1_output_segments", f"""
    select id, concat_ws('|', 'reasoning~' || role, 'tool~web_search~' || id, 'tool~f' || cast(seq as varchar) || '~call~{{{{"a":2,"b":1}}}}',
       'tool~f' || cast(seq as varchar) || '~output~plain', 'text~' || id || chr(10) || chr(10) || 'x y', 'text~tail') as segments, {_TEXT} as text, 'u' as first_url from {{msgs}}""")
def output_segments(t: Tables):
    rows = t.msgs.select("id", R.parse(agent_items()).alias("items")).withColumn("s", N.output_segments(F.col("items")))
    line = lambda s: F.concat_ws("~", s["type"], s["tool"], s["phase"], s["query"], s["text"], s["arguments"], s["output"])
    return rows.select("id", F.array_join(F.transform("s", line), "|").alias("segments"), N.visible_text(F.col("s")).alias("text"),
                       F.col("s")[1]["sources"][0]["url"].alias("first_url"))


@query("J2_agent_messages", f"""
    select case when seq % 3 = 0 then 'c' || cast(conversation_id as varchar) || '-' || cast(created_ms // 1000 as varchar) else id end as id, 'c' || cast(conversation_id as varchar) as conversation_id,
      case when role = 'assistant' then 'assistant' else 'user' end as role, created_ms // 1000 as created, model, case when seq % 2 = 0 then {_TEXT} else 'fallback' end as text
    from {{msgs}} where conversation_id % 7 <> 0""")
def agent_messages(t: Tables):
    items = F.when(F.col("seq") % 2 == 0, agent_items()).otherwise("[]")
    head = _json(F.when(F.col("seq") % 3 != 0, F.col("id")).alias("id"), F.when(F.col("conversation_id") % 7 != 0, F.concat(F.lit("c"), "conversation_id")).alias("mind_conversation_id"),
                 F.when(F.col("role") == "assistant", "AI").otherwise("human").alias("role"), F.floor(F.col("created_ms") / 1000).alias("created_at_unix_timestamp"), "model", F.lit("fallback").alias("input"))
    record = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"output_items":'), items, F.lit("}"))
    rows = N.agent_messages(t.msgs.select(R.parse(record).alias("record")))
    return rows.select("id", "conversation_id", "role", "created", "model", "text")


@query("J2_agent_conversations", """
    select 'c' || cast(id as varchar) as id, coalesce(title, 'Agentic session') as title, id * 1000 + 5 as created, case when id % 3 = 0 then id * 1000 + 9 else id * 1000 + 5 end as updated
    from {convs} where id % 8 <> 0""")
def agent_conversations(t: Tables):
    record = _json(F.when(F.col("id") % 8 != 0, F.concat(F.lit("c"), "id")).alias("id"), F.col("title").alias("name"), (F.col("id") * 1000 + 5).alias("createdAtUnixTimestamp"),
                   F.when(F.col("id") % 3 == 0, (F.col("id") * 1000 + 9).cast("string")).alias("updatedAtUnixTimestamp"))
    return N.agent_conversations(t.convs.select(R.parse(record).alias("record"))).select("id", "title", "created", "updated")


@query("J4_studio_queue", """
    with e as (select event_id, event_type, user_id % 4 as kind, cast(json_extract_string(props, '$.k') as bigint) as k from {events} where event_type in ('view', 'error'))
    select event_id, 0 as index, k from e where kind in (0, 1)
    union all select event_id, 1, k + 1 from e where kind = 0""")
def studio_queue(t: Tables):
    k = F.get_json_object("props", "$.k")
    kind = F.col("user_id") % 4
    value = F.when(kind == 0, F.concat(F.lit('[{"k":'), k, F.lit('},{"k":'), (k.cast("bigint") + 1).cast("string"), F.lit("},7]"))) \
        .when(kind == 1, F.concat(F.lit('{"k":'), k, F.lit("}"))).when(kind == 2, F.concat(F.lit('[{"k":'), k)).otherwise("3")
    key = F.when(F.col("event_type").isin("view", "click"), "video-studio-active-generations").when(F.col("event_type") == "error", "VIDEO-studio-failed-generations").otherwise("theme")
    rows = t.events.select("event_id", key.alias("key"), value.alias("value"), (F.col("event_type") == "click").alias("redacted"))
    return N.studio_queue(rows).select("event_id", "index", R.as_text(R.child(F.col("record"), "k")).cast("bigint").alias("k"))


def chat_message():
    """A message with content parts, attachments, URL fields and id arrays, as JSON."""
    link = lambda prefix: F.concat(F.lit(prefix), "id")
    parts = _objects(
        _json(F.lit("text").alias("type"), F.col("id").alias("text")),
        _json(F.lit("image_url").alias("type"), F.struct(link("https://h/i").alias("url")).alias("image_url")),
        _json(F.lit("clip").alias("type"), link("https://h/v").alias("video_url")),
        _json(F.lit("custom").alias("type"), F.concat(F.lit("https://h/"), "id", F.lit(".mp3")).alias("url"), F.lit(" a  caption ").alias("caption")))
    attachments = _objects(_json(F.lit("a.pdf").alias("filename"), F.lit("application/pdf").alias("mimeType")), _json(F.lit("own").alias("id"), link("https://h/i").alias("url")))
    return F.concat(F.lit('{"content":'), parts, F.lit(',"attachments":'), attachments, F.lit(',"imageUrl":'), F.lit('"https://h/top.png","messageVideoAttachmentIds":["v1"," "]}'))


_IMAGE, _VIDEO, _SOUND = "'https://h/i' || id", "'https://h/v' || id", "'https://h/' || id || '.mp3'"


@query("J5_message_media", f"""
    select id as message_id, unnest(['image~' || {_IMAGE} || '~message.content.image_url', 'video~' || {_VIDEO} || '~message.content.video_url', 'audio~' || {_SOUND} || '~message.content.custom',
        id || '-attachment-1~file~application/pdf~a.pdf~message.attachments', 'own~asset~' || {_IMAGE} || '~message.attachments', 'image~https://h/top.png~message.imageUrl', 'v1~video~message.messageVideoAttachmentIds']) as candidate
    from {{msgs}}""")
def message_media(t: Tables):
    rows = t.msgs.select("id", R.parse(chat_message()).alias("m")).select(
        F.col("id").alias("message_id"), F.explode(N.message_media(F.col("m"), F.col("id"))).alias("c"))
    return rows.select("message_id", F.concat_ws("~", "c.id", "c.kind", "c.mime_type", "c.file_name", "c.url", "c.source").alias("candidate"))


@query("J10_message_blocks", f"""
    select id, case when seq % 4 = 3 then 'empty:No readable content captured for this message.' else concat_ws('|', 'text:' || id, 'media:image:' || {_IMAGE}, 'media:video:' || {_VIDEO}, 'media:audio:' || {_SOUND}, 'text:a caption', 'media:image:https://h/top.png') end as blocks
    from {{msgs}}""")
def message_blocks(t: Tables):
    message = F.when(F.col("seq") % 4 == 3, '{"content":" "}').otherwise(chat_message())
    rows = t.msgs.select("id", R.parse(message).alias("m")).withColumn("b", N.message_blocks(F.col("m"), F.col("id")))
    return rows.select("id", F.array_join(F.transform("b", lambda b: F.concat_ws(":", b["type"], b["kind"], b["url"], b["text"])), "|").alias("blocks"))


@query("J6_deep_references", """
    select distinct page_id, 'https://h' || href || '.png' as url, 'links' as hint from {refs}
    union all select page_id, 'https://h/p' || cast(page_id as varchar), 'previewUrl' from {pages}
    union all select page_id, 'https://h/deep' || cast(page_id as varchar) || '.png', 'imageUrl' from {pages}""")
def deep_references(t: Tables):
    """References anywhere in nested records, 12 levels down too; encrypted parts and byte blobs are not opened, repeats count once."""
    hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    links = F.transform(hrefs, lambda h: F.concat(F.lit("https://h"), h, F.lit(".png")))
    record = _json(F.struct(F.struct(F.concat(links, links).alias("links"), F.lit("no link").alias("note")).alias("deep"),
                            F.concat(F.lit("https://h/p"), "page_id").alias("previewUrl")).alias("body"),
                   F.struct(F.lit("https://h/secret.png").alias("imageUrl")).alias("__encryptedData"))
    blob = "{" + ",".join(f'"{i}":"https://h/blob{i}.png"' for i in range(70)) + "}"
    deep = F.concat(F.lit('"deep":' + '{"a":[' * 5 + '{"__encryptedData":{"imageUrl":"https://h/hidden.png"},"imageUrl":"https://h/deep'), "page_id", F.lit('.png"}' + "]}" * 5 + ',"blob":' + blob + ","))
    record = F.concat(F.lit("{"), deep, F.substring(record, 2, 1 << 30))
    return N.deep_references(t.pages.select("page_id", R.parse(record).alias("record")), ["page_id"]).select("page_id", "url", "hint")


@query("J7_deep_payloads", """
    select doc_id, 'meta.payload' as path, to_base64(encode(text)) as base64, cast(null as varchar) as mime_type from {documents} where strlen(text) > 9
    union all select doc_id, 'files.1', to_base64(encode(lang)), 'image/png' from {documents}
    union all select doc_id, 'link', 'QUJD', 'text/plain' from {documents}
    union all select doc_id, 'many.' || '{a}.payload', to_base64(encode(text)), null from {documents} where strlen(text) > 9""".replace("{a}", ".".join(["69", *"aaaaaaaaaaa"])))
def deep_payloads(t: Tables):
    head = F.base64(F.col("text").cast("binary"))
    file = F.struct(F.lit("base64").alias("encoding"), F.base64(F.col("lang").cast("binary")).alias("data"), F.lit("image/png").alias("mimeType"))
    record = _json(F.struct(head.alias("payload"), F.lit("short").alias("data"), head.alias("encryptedData")).alias("meta"),
                   F.array(F.struct(F.lit("x").alias("encoding"), F.lit(None).cast("string").alias("data"), F.lit("y").alias("mimeType")), file).alias("files"),
                   F.lit("data:text/plain;base64,QUJD").alias("link"))
    # an object of 70 numeric keys, and twelve levels below its last one
    many = F.concat(F.lit('"many":{' + ",".join(f'"{i}":{i}' for i in range(69)) + ',"69":' + '{"a":' * 11 + '{"payload":"'), F.regexp_replace(head, r"\s+", ""), F.lit('"}' + "}" * 11 + "},"))
    record = F.concat(F.lit("{"), many, F.substring(record, 2, 1 << 30))
    return N.deep_payloads(t.documents.select("doc_id", R.parse(record).alias("record")), ["doc_id"]).select("doc_id", "path", "base64", "mime_type")


@query("J8_structured_media", """
    select case when doc_id % 2 = 0 then 'images' else 'sounds' end as store, doc_id as record_id, case when doc_id % 3 = 0 then 'own' when o_orderkey % 5 = 0 then c_name else o_orderstatus end as conversation_id,
       case when doc_id % 4 <> 1 then 'https://h/' || lang || cast(doc_id as varchar) || '.png' end as url,
       case when doc_id % 4 <> 1 or doc_id % 2 = 0 then 'image' else 'audio' end as kind,
       case when doc_id % 2 = 0 then 'studio.image' else 'studio.sound' end || case when doc_id % 4 <> 1 then '.reference' else '.embedded' end as source, o_orderkey is null and doc_id % 3 <> 0 as orphaned
    from {documents} left join {orders} on o_orderkey = doc_id * 20 left join {customer} on c_custkey = o_custkey where doc_id % 4 <> 1 or doc_id % 8 = 1""")
def structured_media(t: Tables):
    doc, key = F.col("doc_id"), F.col("o_orderkey")
    store = F.when(doc % 2 == 0, "images").otherwise("sounds").alias("store")
    record = _json((doc * 20).cast("string").alias("turnId"), F.when(doc % 3 == 0, "own").alias("conversationId"),
                   F.struct(F.when(doc % 4 != 1, F.concat(F.lit("https://h/"), "lang", doc.cast("string"), F.lit(".png"))).alias("url")).alias("result"))
    records = t.documents.select(store, doc.alias("record_id"), R.parse(record).alias("record"), (doc % 8 == 1).alias("inline"))
    stores = F.explode(F.array(F.lit("images"), F.lit("sounds"))).alias("store")
    turns = t.orders.select(stores, key.cast("string").alias("turn_id"), F.col("o_custkey").cast("string").alias("session_id"), F.when(key % 5 != 0, F.col("o_orderstatus")).alias("conversation_id"))
    sessions = t.customer.select(stores, F.col("c_custkey").cast("string").alias("session_id"), F.col("c_name").alias("conversation_id"))
    config = t.spark.createDataFrame([("images", "studio.image", "image", False), ("sounds", "studio.sound", "audio", False)], "store string, label string, default_kind string, metadata_only boolean")
    return N.structured_media(records, config, turns, sessions)


_STORE_KINDS = {"messageImages": "image", "messageVideos": "video", "messageAudioAttachments": "audio", "messageFileAttachments": "file",
                "messageImageAttachments": "image", "messageVideoAttachments": "video", "mindMedia": "file", "mindAttachments": "file"}


@query("J9_store_media", """
    select store, case when doc_id % 3 <> 0 then 'd' || cast(doc_id as varchar) end as id, cast(doc_id % 100 as varchar) as conversation_id, case when doc_id % 2 = 0 then 'https://h/' || cast(doc_id as varchar) end as url,
      doc_id % 5 = 0 as inline, case store when 'messageImages' then 'image' when 'messageVideos' then 'video' when 'messageAudioAttachments' then 'audio' else 'file' end as default_kind, lang as prompt
    from (select *, case doc_id % 5 when 0 then 'messageImages' when 1 then 'messageVideos' when 2 then 'messageAudioAttachments' when 3 then 'mindMedia' else 'other' end as store from {documents})
    where store <> 'other' and (doc_id % 3 <> 0 or doc_id % 2 = 0 or doc_id % 5 = 0)""")
def store_media(t: Tables):
    doc = F.col("doc_id")
    store = F.when(doc % 5 == 0, "messageImages").when(doc % 5 == 1, "messageVideos").when(doc % 5 == 2, "messageAudioAttachments").when(doc % 5 == 3, "mindMedia").otherwise("other")
    record = _json(F.when(doc % 3 != 0, F.concat(F.lit("d"), doc)).alias("id"), (doc % 100).cast("string").alias("mindConversationId"), F.when(doc % 2 == 0, F.concat(F.lit("https://h/"), doc)).alias("media_url"),
                   F.when(doc % 5 == 0, "QUJD").alias("base64"), F.col("lang").alias("caption"))
    rows = N.store_media_records(t.documents.select(store.alias("store"), R.parse(record).alias("record")), _STORE_KINDS)
    return rows.select("store", "id", "conversation_id", "url", "inline", "default_kind", "prompt")


@query("J12_transport_values", """
    select event_id, case event_id % 7 when 0 then 'number' when 1 then 'bigint' when 2 then 'date' when 3 then 'binary' when 4 then 'map' when 5 then 'set' else 'string' end as type,
      case when event_id % 7 = 0 then k end as number, case when event_id % 7 = 1 then '9007199254740993' || cast(k as varchar) end as bigint, case when event_id % 7 = 2 then epoch_us(ts) // 1000000 * 1000 end as at_ms,
      case when event_id % 7 = 3 then event_type end as content, case when event_id % 7 = 4 then '{{"a":1}}=' || cast(k as varchar) || ';"x"=null' end as entries, case when event_id % 7 = 5 then cast(k as varchar) || ';"' || event_type || '"' end as members
    from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from {events})""")
def transport_values(t: Tables):
    kind, k = F.col("event_id") % 7, F.get_json_object("props", "$.k")
    tagged = lambda name, rest: F.concat(F.lit('{"__archiveType":"' + name + '",'), rest, F.lit("}"))
    value = (
        F.when(kind == 0, tagged("number", F.concat(F.lit('"value":"'), k, F.lit('"'))))
        .when(kind == 1, tagged("bigint", F.concat(F.lit('"value":"9007199254740993'), k, F.lit('"'))))
        .when(kind == 2, tagged("date", F.concat(F.lit('"value":"'), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))))
        .when(kind == 3, tagged("binary", F.concat(F.lit('"encoding":"base64","data":"'), F.base64(F.col("event_type").cast("binary")), F.lit('"'))))
        .when(kind == 4, tagged("map", F.concat(F.lit('"entries":[[{"a":1},'), k, F.lit('],["x",null]]'))))
        .when(kind == 5, tagged("set", F.concat(F.lit('"values":['), k, F.lit(',"'), "event_type", F.lit('"]'))))
        .otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    )
    rows = t.events.select("event_id", R.parse(value).alias("v")).select("event_id", N.decode_transport(F.col("v")).alias("d"))
    return rows.select(
        "event_id", "d.type", F.col("d.number").cast("bigint").alias("number"), F.col("d.bigint").cast("string").alias("bigint"), "d.at_ms", F.col("d.content").cast("string").alias("content"),
        F.array_join(F.transform("d.entries", lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("null")))), ";").alias("entries"), F.array_join("d.members", ";").alias("members"))


_BIG, _DAY = "'9007199254740993' || k", "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
_MAP = f"""'[["k","NaN"],["' || {_BIG} || '",["' || {_DAY} || '"]]]'"""
#: path, type, number, bigint, at_ms, content, name, size, items, plain
_NESTED = [
    ("'c'", "'circular-reference'", *["null"] * 7, "'null'"),
    ("'f'", "'file'", "null", "null", "null", "event_type", "event_type || '.txt'", "length(event_type)", "null", """'{"bytes":' || length(event_type) || '}'"""),
    ("'password'", "'redacted'", *["null"] * 8),
    ("'s.0.0.key'", "'string'", *["null"] * 7, "'\"k\"'"),
    ("'s.0.0.value'", "'number'", "'NaN'", *["null"] * 6, "'\"NaN\"'"),
    ("'s.0.1.key'", "'bigint'", "null", _BIG, *["null"] * 5, f"'\"' || {_BIG} || '\"'"),
    ("'s.0.1.value.0'", "'date'", "null", "null", "epoch_us(ts) // 1000000 * 1000", *["null"] * 4, f"'\"' || {_DAY} || '\"'"),
    ("'s.0.1.value'", "'set'", *["null"] * 6, "1", f"""'["' || {_DAY} || '"]'"""),
    ("'s.0'", "'map'", *["null"] * 6, "2", _MAP),
    ("'s'", "'set'", *["null"] * 6, "1", f"'[' || {_MAP} || ']'"),
    ("'t'", "'Uint16Array'", "'1.0;2.0;65535.0'", *["null"] * 4, "6", "3", """'{"bytes":6}'"""),
    ("''", "'object'", *["null"] * 6, "5", f"""'{{"c":null,"f":{{"bytes":' || length(event_type) || '}},"password":null,"s":[' || {_MAP} || '],"t":{{"bytes":6}}}}'"""),
]


@query("J12_nested_transport", ("select event_id, " + ", ".join(f"unnest([{', '.join(str(row[i]) for row in _NESTED)}]) as {name}" for i, name in enumerate(
    ("path", "type", "number", "bigint", "at_ms", "content", "name", "size", "items", "plain")))).replace("{", "{{").replace("}", "}}")
    + " from (select *, json_extract_string(props, '$.k') as k from {events})")
def nested_transport(t: Tables):
    """A map inside a set, a set inside that map, a file, a typed array, a circular mark and a credential."""
    k, day = F.get_json_object("props", "$.k"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tagged = lambda kind, *rest: F.concat(F.lit('{"__archiveType":"' + kind + '"'), *rest, F.lit("}"))
    values = lambda *inner: F.concat(F.lit(',"values":['), *inner, F.lit("]"))
    big, date = tagged("bigint", F.lit(',"value":"9007199254740993'), k, F.lit('"')), tagged("date", F.lit(',"value":"'), day, F.lit('"'))
    pairs = tagged("map", F.lit(',"entries":[["k",{"__archiveType":"number","value":"NaN"}],['), big, F.lit(","), tagged("set", values(date)), F.lit("]]"))
    file = tagged("file", F.lit(',"encoding":"base64","mimeType":"text/plain","lastModified":1704067200000,"name":"'), "event_type", F.lit('.txt","size":'),
                  F.length("event_type").cast("string"), F.lit(',"data":"'), F.base64(F.col("event_type").cast("binary")), F.lit('"'))
    record = F.concat(
        F.lit('{"s":'), tagged("set", values(pairs)), F.lit(',"f":'), file, F.lit(',"t":{"__archiveType":"Uint16Array","encoding":"base64","data":"AQACAP//"},'
        '"c":{"__archiveType":"circular-reference"},"password":{"x":"s3cret"}}'))
    rows = V.transport_values(t.events.select("event_id", R.parse(record).alias("record")), ["event_id"])
    number = F.coalesce(F.array_join(F.col("numbers").cast("array<string>"), ";"), F.col("number").cast("string")).alias("number")
    return rows.select("event_id", "path", "type", number, "bigint", "at_ms", F.col("content").cast("string").alias("content"), "name", "size", "items", "plain").withColumn(
        "content", F.when(F.col("type") == "file", F.col("content")))


_REDACTED = {
    "k": "json_extract_string(props, '$.k')", "session.access-token": None, "session.user": "event_type", "list.0.Password": None, "list.1": "'true'",
    "password": None, "secret": None, ".".join(["deep", *"abcdefgh", "private_key"]): None, ".".join(["deep", *"abcdefgh", "ok", "0"]): "event_type",
    "none": "'{}'", "nil": "'[]'",
}


@query("J12_redacted_fields", "select event_id, " + ", ".join(
    f"unnest([{', '.join(values)}]) as {name}" for name, values in (
        ("path", [f"'{path}'" for path in _REDACTED]), ("redacted", [str(v is None).lower() for v in _REDACTED.values()]),
        ("value", [v or "null" for v in _REDACTED.values()]))).replace("{", "{{").replace("}", "}}") + " from {events}")
def redacted_fields(t: Tables):
    """A credential closes its whole value, an object or a list too, at any depth; empty containers are rows."""
    text = F.concat(
        F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"session":{"access-token":"t","user":"'), "event_type", F.lit('"},"list":[{"Password":"p"},true],'),
        F.lit('"password":{"v":"s3cret","w":[1,{"x":"s3cret"}]},"secret":[{"a":"s3cret"}],"none":{},"nil":[],"deep":' + "".join(f'{{"{c}":' for c in "abcdefgh")
              + '{"private_key":{"v":{"v":"s3cret"}},"ok":["'), "event_type", F.lit('"]}' + "}" * 8 + "}"))
    return N.redacted_fields(t.events.select("event_id", R.parse(text).alias("record")), ["event_id"])


@query("J13_report_sections", f"""
    with m as (select *, case seq % 3 when 0 then ['reasoning~~~' || role, 'tool~web_search~u~' || id, 'tool~f' || cast(seq as varchar) || ':call~~{{{{"a":2,"b":1}}}}', 'tool~f' || cast(seq as varchar) || ':output~~plain',
          'text~~~' || id || chr(10) || chr(10) || 'x y', 'text~~~tail'] when 1 then ['text~~~' || id] else ['empty~~~No readable content captured for this message.'] end as blocks from {{msgs}}),
      n as (select *, coalesce(sum(len(blocks) + 1) over (partition by conversation_id order by seq rows between unbounded preceding and 1 preceding), 0) as start from m),
      r as (select conversation_id, id, start as position, start + len(blocks) as until, 'message~' || upper(substring(role, 1, 1)) || substring(role, 2) || '~~' as block, true as head from n
        union all select conversation_id, id, start + i, start + i, blocks[i], false from (select *, unnest(range(1, len(blocks) + 1)) as i from n))
    select r.conversation_id, r.id as message_id, cast(position as bigint) as position, cast(until as bigint) as until, block,
      case when head then lower(concat_ws(' ', c.title, f.r_name)) when block like 'text~%' then lower(substring(block, 8)) end as search_text
    from r join {{convs}} c on c.id = r.conversation_id left join {{region}} f on f.r_regionkey = c.id % 7""")
def report_sections(t: Tables):
    """Reasoning, tool and text blocks between the messages, in one reading order."""
    agent = F.concat(F.lit('{"output_items":'), agent_items(), F.lit("}"))
    record = F.when(F.col("seq") % 3 == 0, agent).when(F.col("seq") % 3 == 1, _json(F.col("id").alias("content"))).otherwise('{"content":" "}')
    messages = t.msgs.select("conversation_id", "id", "seq", "role", "model", R.parse(record).alias("record"))
    folders = t.region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))
    rows = P.report_sections(t.convs.withColumn("folder_id", F.col("id") % 7), messages, folders)
    block = F.concat_ws("~", "type", *(F.coalesce(c, F.lit("")) for c in ("kind", "url", "text")))
    return rows.select("conversation_id", "message_id", "position", "until", block.alias("block"), "search_text")


@query("J14_studio_conversations", """
    with s as (select 's' || cast(c_custkey as varchar) as id, case when c_custkey % 3 = 0 then c_name else 'Image Studio' end as title, 'image' as studio_type, cast(c_custkey as bigint) as created from {customer} where c_custkey % 4 <> 0),
      m as (select 's' || cast(o_custkey as varchar) as id, 'Video Studio' as title, 'video' as studio_type, cast(min(o_orderkey) as bigint) as created from {orders} where o_custkey % 4 = 0 or o_custkey not in (select c_custkey from {customer}) group by 1)
    select *, 'studio' as kind from s union all select *, 'studio' from m""")
def studio_conversations(t: Tables):
    sessions = t.customer.where("c_custkey % 4 <> 0").select(
        F.concat(F.lit("s"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("0").alias("title"), F.lit("image").alias("studio_type"), F.col("c_custkey").alias("created"))
    return N.studio_conversations(sessions, studio_turns(t))


def studio_turns(t: Tables):
    return t.orders.select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("s"), "o_custkey").alias("session_id"), F.lit("video").alias("studio_type"),
                           F.col("o_orderpriority").alias("prompt"), F.col("o_orderkey").alias("created"))


@query("J14_studio_messages", """
    select cast(o_orderkey as varchar) as id, case when o_orderkey % 6 = 0 then 'recovered' else 's' || cast(o_custkey as varchar) end as conversation_id, 'user' as role, o_orderpriority as text, o_orderkey as created, 'video' as studio_type from {orders}""")
def studio_messages(t: Tables):
    turns = studio_turns(t).withColumn("session_id", F.when(F.col("created") % 6 != 0, F.col("session_id")).otherwise(" "))
    return N.studio_messages(turns)
