"""Queries for the per-row normalizers."""

from pyspark.sql import functions as F

from threadlake import constants as K
from threadlake.functions import media as M
from threadlake.functions import records as R
from threadlake.functions import scalars as S
from threadlake.functions import predicates as P
from threadlake.plans.registry import Tables, query


def json_records(t: Tables):
    """Documents as JSON records inside one to three envelopes, the way stores save them."""
    inner = F.to_json(F.struct(
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"),
        (F.col("doc_id") % 100).alias("conversation_id"),
        F.col("lang").alias("title"),
        F.col("text").alias("content"),
    ))
    one = F.concat(F.lit('{"title":"outer","rev":1,"data":'), inner, F.lit("}"))
    two = F.concat(F.lit('{"kind":"wrapped","doc":{"title":"middle","documentData":'), inner, F.lit("}}"))
    text = F.when(F.col("doc_id") % 3 == 0, inner).when(F.col("doc_id") % 3 == 1, one).otherwise(two)
    return t.documents.select("doc_id", R.parse(text).alias("record"))


@query("C1_unwrap", """
    select doc_id, concat('d', cast(doc_id as varchar)) as id, lang as title,
           case when doc_id % 3 = 1 then '1' end as rev,
           case when doc_id % 3 = 2 then 'wrapped' end as kind, sha256(text) as digest
    from {documents}""")
def unwrap(t: Tables):
    rows = R.unwrap(json_records(t))
    pick = lambda name: R.text("r", name).alias(name)
    return rows.select("doc_id", pick("id"), pick("title"), pick("rev"), pick("kind"), F.sha2(R.text("r", "content"), 256).alias("digest"))


@query("C2_first_text", """
    select doc_id, case doc_id % 4 when 0 then lang when 1 then source when 2 then '7' else lang end as value,
           sha256(nullif(trim(text, ' '), '')) as digest
    from {documents}""")
def first_text(t: Tables):
    doc = F.col("doc_id") % 4
    text = F.when(doc == 0, F.concat(F.lit('{"title":"  ","name":"'), F.col("lang"), F.lit('"}'))) \
        .when(doc == 1, F.concat(F.lit('{"title":"0","name":" '), F.col("source"), F.lit(' "}'))) \
        .when(doc == 2, F.lit('{"title":{"a":1},"name":7}')) \
        .otherwise(F.concat(F.lit('{"title":true,"name":"'), F.col("lang"), F.lit('"}')))
    rows = t.documents.select("doc_id", "text", R.fields(R.parse(text)).alias("r"))
    return rows.select(
        "doc_id", R.first_text("r", ("title", "name")).alias("value"),
        F.sha2(S.first_string(F.col("text")), 256).alias("digest"),
    )


@query("C3_record_id", """
    select doc_id, case doc_id % 3 when 0 then concat('d', cast(doc_id as varchar))
                        when 1 then cast(doc_id as varchar) else concat('docs-', cast(doc_id as varchar)) end as id
    from {documents}""")
def record_id(t: Tables):
    doc = F.col("doc_id")
    text = F.when(doc % 3 == 0, F.concat(F.lit('{"id":"d'), doc, F.lit('"}'))) \
        .when(doc % 3 == 1, F.concat(F.lit('{"id":" ","_id":'), doc, F.lit("}"))) \
        .otherwise(F.lit('{"name":"x"}'))
    rows = t.documents.select("doc_id", R.fields(R.parse(text)).alias("r"))
    return rows.select("doc_id", R.record_id("r", F.concat(F.lit("docs-"), "doc_id")).alias("id"))


@query("C4_flatten_text", """
    select doc_id, case doc_id % 5 when 0 then lang when 1 then concat(lang, chr(10), source)
                        when 2 then concat(source, chr(10), 'tail') when 3 then lang else concat(lang, chr(10), source, chr(10), 'end') end as text
    from {documents}""")
def flatten_text(t: Tables):
    doc = F.col("doc_id") % 5
    lang, source = F.to_json(F.array("lang")), F.to_json(F.array("source"))
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    lang, source = quoted("lang"), quoted("source")
    text = F.when(doc == 0, lang) \
        .when(doc == 1, F.concat(F.lit("["), lang, F.lit(',{"text":'), source, F.lit("}]"))) \
        .when(doc == 2, F.concat(F.lit('[{"content":['), source, F.lit(']},"tail"]'))) \
        .when(doc == 3, F.concat(F.lit('{"value":{"summary":'), lang, F.lit("}}"))) \
        .otherwise(F.concat(F.lit('[' * 6 + '{"text":{"value":[' * 3), lang, F.lit(","), source, F.lit(']}}' * 3 + ']' * 5 + ',"end"]')))
    return t.documents.withColumn("record", R.parse(text)).select("doc_id", R.readable_text("record").alias("text"))


@query("C5_response_text", """
    select id, sha256(trim(text || chr(10) || chr(10) || role || chr(10) || id, ' ')) as digest from {msgs}""")
def response_text(t: Tables):
    """Output items of every message: reasoning is left out, message parts are joined."""
    item = lambda kind, *texts: F.struct(F.lit(kind).alias("type"), F.array(*[F.struct(text.alias("text")) for text in texts]).alias("content"))
    items = F.array(item("reasoning", F.lit("hidden")), item("message", F.col("text")), item("message", F.col("role"), F.col("id")))
    rows = t.msgs.select("id", R.parse(F.to_json(items)).alias("items"))
    return rows.select("id", F.sha2(R.response_text("items"), 256).alias("digest"))


_TIMES = """
    select event_id, case event_id % 5
        when 0 then cast((epoch_us(ts) // 1000) // 1000 as varchar)
        when 1 then cast((epoch_us(ts) // 1000) as varchar)
        when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
        when 3 then '' else 'not a time' end as raw, (epoch_us(ts) // 1000) as ms from {events}"""


def raw_times(t: Tables):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 5
    return t.events.select(
        "event_id", ms.alias("ms"),
        F.when(kind == 0, F.floor(ms / 1000).cast("string")).when(kind == 1, ms.cast("string"))
        .when(kind == 2, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 3, "").otherwise("not a time").alias("raw"),
    )


@query("C6_to_timestamp", """
    select event_id, raw, cast(case event_id % 5 when 0 then (ms // 1000) * 1000 when 1 then ms
                          when 2 then (ms // 1000) * 1000 end as bigint) as at_ms,
           strftime(make_timestamp(case event_id % 5 when 0 then (ms // 1000) * 1000 when 1 then ms
                          when 2 then (ms // 1000) * 1000 end * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') as at_iso
    from (""" + _TIMES + ")")
def to_timestamp(t: Tables):
    at = S.to_millis(F.col("raw"))
    return raw_times(t).select("event_id", "raw", at.alias("at_ms"), S.iso_time(at).alias("at_iso"))


@query("C6b_to_timestamp_strict", """
    select event_id, cast(case event_id % 3 when 0 then ms when 1 then (ms // 1000) * 1000 end as bigint) as at_ms
    from (select event_id, (epoch_us(ts) // 1000) as ms from {events})""")
def to_timestamp_strict(t: Tables):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    kind = F.col("event_id") % 3
    number = F.when(kind == 0, ms).when(kind == 1, F.floor(ms / 1000)).otherwise(0)
    return t.events.select("event_id", S.to_millis_strict(number).alias("at_ms"))


@query("C7_token_counts", """
    select event_id, cast(k as bigint) as tokens_in, cast(case when event_id % 3 = 0 then null else event_id % 50 end as bigint) as tokens_out,
           cast(case when event_id % 4 = 0 then event_id
                     else k + case when event_id % 3 = 0 then 0 else event_id % 50 end end as bigint) as tokens_total
    from (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from {events})""")
def token_counts(t: Tables):
    rows = t.events.withColumn("r", R.fields(R.parse("props"))).select(
        "event_id", R.finite_nonneg(R.text("r", "missing"), R.text("r", "k")).cast("bigint").alias("tokens_in"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 50).alias("tokens_out"),
        F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("explicit"),
    )
    return rows.select(
        "event_id", "tokens_in", "tokens_out",
        S.total_tokens(F.col("explicit"), F.col("tokens_in"), F.col("tokens_out")).alias("tokens_total"),
    )


@query("C8_media_kind", """
    select media_id, case when media_id % 2 = 0 then kind when source like '%image%' then 'image'
             when source like '%video%' then 'video' when source like '%audio%' then 'audio' else 'file' end as by_mime,
           case when media_id % 3 = 0 then 'image' when media_id % 3 = 1 then 'audio' else 'file' end as by_source
    from {media}""")
def media_kind(t: Tables):
    mime = F.when(F.col("media_id") % 2 == 0, F.concat(F.upper("kind"), F.lit("/x"))).otherwise("")
    mime = F.when(F.col("kind") == "file", "").otherwise(mime)
    store = F.when(F.col("media_id") % 3 == 0, "messageImages").when(F.col("media_id") % 3 == 1, "voiceAUDIO").otherwise("other")
    return t.media.select(
        "media_id", M.media_kind(mime, F.col("source")).alias("by_mime"),
        M.media_kind(F.lit(None).cast("string"), store).alias("by_source"),
    )


_EXT = "case media_id % 6 when 0 then 'png' when 1 then 'mov' when 2 then 'JPEG' when 3 then 'opus' when 4 then 'xyz' else 'pdf' end"


@query("C9_mime_types", f"""
    select media_id, mime, case mime when 'image/png' then 'png' when 'video/quicktime' then 'mov' when 'image/jpeg' then 'jpg'
             when 'audio/opus' then 'opus' when 'application/pdf' then 'pdf' when 'image/webp' then 'webp' when 'video/mp4' then 'mp4'
             when 'audio/mpeg' then 'mp3' else 'octet-stream' end as extension, default_mime
    from (select media_id, default_mime, case media_id % 6 when 0 then 'image/png' when 1 then 'video/quicktime' when 2 then 'image/jpeg'
             when 3 then 'audio/opus' when 5 then 'application/pdf' else default_mime end as mime
          from (select media_id, case kind when 'image' then 'image/webp' when 'video' then 'video/mp4' when 'audio' then 'audio/mpeg'
                  else 'application/octet-stream' end as default_mime from {{media}}))""")
def mime_types(t: Tables):
    ext = F.expr(_EXT)
    url = F.concat(F.lit("https://host/a.b/"), F.col("media_id"), F.lit("."), ext, F.lit("?x=1.png#f"))
    mime = M.mime_from_url(url, F.col("kind"))
    return t.media.select(
        "media_id", mime.alias("mime"), M.extension_for_mime(mime, F.col("kind")).alias("extension"),
        M.default_mime(F.col("kind")).alias("default_mime"),
    )


@query("C10_media_candidates", """
    select page_id, pos,
           case when ends_with(href, '.png') then 'image' else 'asset' end as kind,
           case when ends_with(href, '.png') then 'image/png' else 'application/octet-stream' end as mime_type,
           case when ends_with(href, '.png') then 'png' else 'octet-stream' end as extension,
           starts_with(href, 'http') as exportable,
           case when starts_with(href, 'http') then 'candidate' else 'unresolved' end as status,
           case when not starts_with(href, 'http') then 'No bytes, inline payload, or fetchable media URL was available.' end as reason
    from (select page_id, pos, case pos % 3 when 0 then 'https://h/x' || cast(page_id as varchar) || '.png'
                                    when 1 then 'https://h/y' else '/local/z' end as href from {refs})""")
def media_candidates(t: Tables):
    href = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("https://h/x"), "page_id", F.lit(".png"))) \
        .when(F.col("pos") % 3 == 1, "https://h/y").otherwise("/local/z")
    none = F.lit(None).cast("string")
    result = M.classify_candidate(href, none, none, F.lit(0), F.lit(False))
    return t.refs.select("page_id", F.col("pos").cast("bigint").alias("pos"), result.alias("c")).select("page_id", "pos", "c.*")


@query("C11_media_disposition", """
    select media_id, case when disposition is not null then disposition when media_id % 20 = 4 then 'input' end as saved,
           case when disposition is not null then disposition when media_id % 20 = 4 then 'input'
                when role = 'user' then 'input' else 'media' end as resolved
    from (select m.*, s.role from {media} m left join {msgs} s on s.conversation_id = m.conversation_id and s.id = m.message_id)""")
def media_disposition(t: Tables):
    messages = t.msgs.select("conversation_id", F.col("id").alias("message_id"), "role", "model")
    linked = t.media.join(messages, ["conversation_id", "message_id"], "left")
    store = F.when(F.col("media_id") % 20 == 4, "fileAttachments").otherwise("other")
    none = F.lit(None).cast("string")
    return linked.select(
        "media_id", M.media_disposition(F.col("disposition"), store).alias("saved"),
        M.resolved_disposition(F.col("disposition"), store, none, F.lit(False), F.col("model"), F.col("role"), none).alias("resolved"),
    )


@query("C12_normalize_role", """
    select id, case seq % 5 when 0 then 'user' when 1 then 'assistant' when 2 then 'assistant' when 3 then role else 'assistant' end as agent_role,
           case seq % 5 when 0 then 'user' when 1 then 'ai' when 2 then 'assistant' when 3 then role else 'message' end as report_role
    from {msgs}""")
def normalize_role(t: Tables):
    kind = F.col("seq") % 5
    raw = F.when(kind == 0, " Human").when(kind == 1, "AI").when(kind == 2, "model").when(kind == 3, F.col("role"))
    return t.msgs.select("id", S.agent_role(raw).alias("agent_role"), S.report_role(raw).alias("report_role"))


@query("C13_model_label", """
    select p_partkey, case when p_partkey % 4 = 0 then p_type when p_partkey % 4 = 1 then p_brand
                           else p_brand || ' (' || p_type || ')' end as label from {part}""")
def model_label(t: Tables):
    none = F.lit(None).cast("string")
    kind = F.col("p_partkey") % 4
    return t.part.select("p_partkey", S.model_label(
        F.when(kind == 0, none).otherwise(F.col("p_brand")),
        F.when(kind == 1, F.col("p_brand")).otherwise(F.col("p_type")), F.lit("chat")).alias("label"))


@query("C14_media_path", """
    select doc_id, case when safe then cast(doc_id % 100 as varchar) end as conversation_id,
           case when safe then cast(doc_id % 100 as varchar) || '-' || cast((doc_id // 100) % 3 as varchar)
             || case when doc_id % 6 = 0 and doc_id % 3 <> 0 then '__m2' else '' end end as message_id,
           case when safe then doc_id % 3 = 0 end as attachment
    from (select doc_id, doc_id % 17 <> 3 and doc_id % 19 <> 4 as safe from {documents})""")
def media_path(t: Tables):
    return t.paths.select("doc_id", M.path_parts(F.col("path")).alias("p")).select(
        "doc_id", "p.conversation_id", "p.message_id", "p.attachment")


@query("C15_page_conversation", """
    select page_id, case when regexp_matches(path, '/chat/[0-9a-f]{{6,}}') then regexp_extract(path, '/chat/([0-9a-f]{{6,}}[0-9a-f-]*)', 1) end as conversation_id
    from (select page_id, case when page_id % 2 = 0 then url || '/chat/' || substring(sha256(url), 1, 12) || '-' || 'ab' else url end as path from {pages})""")
def page_conversation(t: Tables):
    path = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/chat/"), F.substring(F.sha2("url", 256), 1, 12), F.lit("-ab"))).otherwise(F.col("url"))
    return t.pages.select("page_id", M.page_conversation(path).alias("conversation_id"))


@query("C16_media_dimensions", """
    select p_partkey, cast(case when p_partkey % 2 = 0 then p_size else p_size + 10 end as bigint) as width,
           cast(case when p_partkey % 2 = 0 then p_size + 1 else p_size + 20 end as bigint) as height from {part}""")
def media_dimensions(t: Tables):
    direct = lambda extra: F.when(F.col("p_partkey") % 2 == 0, (F.col("p_size") + extra).cast("string")).otherwise("0")
    text = F.concat(F.col("p_size") + 10, F.lit(" X "), F.col("p_size") + 20)
    return t.part.select(
        "p_partkey", M.dimension(direct(0), text, "width").alias("width"), M.dimension(direct(1), text, "height").alias("height"))


@query("C18_conversation_kind", """
    select doc_id, target, case when store like 'studio%' then 'image' end as studio_type,
           case when doc_id % 5 = 0 then 'studio' when store like 'mind%' then 'agentic' else 'chat' end as kind
    from (select doc_id, store, case store when 'conversations' then 'conversation' when 'mindMessages' then 'message'
            when 'studioImageSessions' then 'studio_session' when 'idb:images' then 'lossless' else 'media' end as target
          from (select doc_id, case doc_id % 5 when 0 then 'studioImageSessions' when 1 then 'conversations' when 2 then 'mindMessages'
                  when 3 then 'idb:images' else 'messageImages' end as store from {documents}))""")
def conversation_kind(t: Tables):
    store = F.expr("case doc_id % 5 when 0 then 'studioImageSessions' when 1 then 'conversations' when 2 then 'mindMessages' when 3 then 'idb:images' else 'messageImages' end")
    explicit = F.when(F.col("doc_id") % 5 == 0, "Image")
    studio = P.studio_conversation_type(explicit, F.lit("x"))
    return t.documents.select(
        "doc_id", P.store_target(store).alias("target"), P.studio_type(store).alias("studio_type"),
        P.conversation_kind(store, studio).alias("kind"))


@query("C19_message_metrics", """
    select id, cast(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as bigint) as words,
           cast(case when seq % 4 = 1 then 17 when length(text) = 0 then 0 else greatest(1, ceil(length(text) / 4.0)) end as bigint) as tokens,
           seq % 4 = 1 as exact
    from {msgs}""")
def message_metrics(t: Tables):
    saved = F.when(F.col("seq") % 4 == 1, 17)
    return t.msgs.select(
        "id", S.word_count(F.col("text")).alias("words"),
        S.shown_tokens(saved, F.lit(None).cast("int"), F.col("text")).alias("tokens"),
        (F.col("seq") % 4 == 1).alias("exact"))


@query("C20_generation_settings", """
    select p_partkey, concat_ws(';', 'Canvas=' || cast(p_size as varchar) || ' x ?',
             'Steps=' || case when p_partkey % 3 = 0 then 'Auto' else cast(p_partkey % 3 as varchar) end,
             'Variants=' || cast(p_size as varchar),
             case when p_partkey % 2 = 0 then 'Style Preset=' || p_type end,
             'Creativity=' || case when p_partkey % 5 = 0 then 'Yes' else 'No' end,
             case when p_partkey % 4 > 1 then 'Upscale Scale=' || cast(p_partkey % 4 as varchar) end) as settings
    from {part}""")
def generation_settings(t: Tables):
    from threadlake.operators.nested import settings_entries
    k = F.col("p_partkey")
    settings = F.struct(
        F.col("p_size").alias("width"), (k % 3).alias("steps"), F.col("p_size").alias("variants"),
        F.when(k % 2 == 0, F.col("p_type")).otherwise("None").alias("stylePreset"),
        (k % 5 == 0).alias("enhanceCreativity"), (k % 4).alias("upscaleScale"))
    rows = t.part.select("p_partkey", settings_entries(F.lit("image"), R.parse(F.to_json(settings))).alias("e"))
    pairs = F.transform("e", lambda e: F.concat(e["label"], F.lit("="), e["value"]))
    return rows.select("p_partkey", F.array_join(pairs, ";").alias("settings"))


@query("C21_sanitize_media", """
    select page_id, pos, case when not (kind = 0) and length(href) <= 12 then href end as url,
           case when kind <> 0 and length(href) > 12 then substring(href, 1, 9) || '...' end as url_preview,
           case when kind = 0 then 'inline-data' else 'reference' end as url_kind, kind = 0 as url_omitted
    from (select page_id, cast(pos as bigint) as pos, href, pos % 4 as kind from {refs})""")
def sanitize_media(t: Tables):
    from threadlake.operators.gallery import sanitized_url
    inline = F.col("pos") % 4 == 0
    url = F.when(inline, F.concat(F.lit("data:image/png;base64,"), "href")).otherwise(F.col("href"))
    result = sanitized_url(url, inline, include_urls=True, limit=12)
    return t.refs.select("page_id", F.col("pos").cast("bigint").alias("pos"), result.alias("u")).select("page_id", "pos", "u.*")


@query("C22_canonical_json", """
    select event_id, '{{"a":{{"x":' || json_extract_string(props, '$.k') || ',"y":[2,1]}},"k":' || json_extract_string(props, '$.k')
           || ',"z":"' || event_type || '"}}' as canonical from {events}""")
def canonical_json(t: Tables):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{ "z":"'), "event_type", F.lit('", "k":'), k, F.lit(', "a": {"y":[2,1], "x":'), k, F.lit("}}"))
    return t.events.select("event_id", R.canonical_json(R.parse(text)).alias("canonical"))


@query("C23_store_name_hash", """
    with recursive names as (select distinct event_type || '/' || cast(user_id % 20 as varchar) as n from {events}),
      h(n, i, v) as (
        select n, 0, cast(2166136261 as bigint) from names
        union all
        select n, i + 1, cast((cast(xor(v, cast(ascii(substring(n, i + 1, 1)) as bigint)) as hugeint) * 16777619) % 4294967296 as bigint)
        from h where i < length(n))
    select n as name, lpad(lower(printf('%x', v)), 8, '0') as hash,
           'stores/store--' || regexp_replace(n, '[^a-zA-Z0-9._-]+', '-', 'g') || '--' || lpad(lower(printf('%x', v)), 8, '0') || '.json' as path
    from h where i = length(n)""")
def store_name_hash(t: Tables):
    names = t.events.select(F.concat("event_type", F.lit("/"), F.col("user_id") % 20).alias("name")).distinct()
    return names.select("name", S.fnv1a32(F.col("name")).alias("hash"), S.store_path(F.col("name")).alias("path"))


@query("C24_estimate_bytes", """
    select event_id, cast(strlen('{{"k":' || json_extract_string(props, '$.k') || '}}') as bigint) as bytes from {events}""")
def estimate_bytes(t: Tables):
    return t.events.select("event_id", R.estimate_bytes(R.parse("props")).alias("bytes"))


@query("C25_correct_extension", """
    select media_id, case media_id % 4 when 0 then 'a.JPEG' when 1 then 'b' || cast(media_id as varchar) || '.jpg' when 2 then 'noext' else null end as name
    from {media}""")
def correct_extension(t: Tables):
    kind = F.col("media_id") % 4
    name = F.when(kind == 0, "a.JPEG").when(kind == 1, F.concat(F.lit("b"), "media_id", F.lit(".png"))).when(kind == 2, "noext").otherwise(" ")
    return t.media.select("media_id", M.correct_extension(name, F.lit(".jpg")).alias("name"))
