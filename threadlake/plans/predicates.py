"""Queries for row predicates."""

from pyspark.sql import functions as F

from threadlake.functions import media as M
from threadlake.functions import predicates as P
from threadlake.operators import links as L
from threadlake.plans.registry import Tables, query

_KEYS = """select event_id, case event_id % 8
    when 0 then concat(event_type, '.access_token') when 1 then 'posthog-' || event_type when 2 then event_type || ':theme'
    when 3 then 'encryptionKey' when 4 then 'walletconnect_' || event_type when 5 then case when event_id % 16 = 5 then 'chatActiveSessions' else 'otherActiveSessions' end
    when 6 then 'my-tokens-' || event_type else 'PASSWORD' end as key from {events}"""


@query("D4_redact_keys", "select event_id, key, " + """
    event_id % 8 in (0, 1, 3, 4, 7) or event_id % 16 = 5 as redacted,
    case when event_id % 8 in (0, 3, 4, 7) then 'Authentication or credential state is intentionally excluded.'
         when event_id % 8 = 1 or event_id % 16 = 5 then 'Volatile telemetry state is intentionally excluded.' end as reason
    from (""" + _KEYS + ")")
def redact_keys(t: Tables):
    return t.sql(_KEYS).select("event_id", "key", P.redaction(F.col("key"), site="chat").alias("r")).select("event_id", "key", "r.*")


@query("D5_thumbnails", """
    select doc_id, doc_id % 4 in (0, 1) as thumbnail, doc_id % 4 = 3 as sidecar,
       case doc_id % 4 when 0 then cast(doc_id as varchar) || '_a' when 1 then cast(doc_id as varchar) || '_a' when 2 then 'plain.tar' else sha256(text) end as stem
    from {documents}""")
def thumbnails(t: Tables):
    kind = F.col("doc_id") % 4
    doc = F.col("doc_id").cast("string")
    path = F.when(kind == 0, F.concat(F.lit("a\\Thumbnails\\"), doc, F.lit("_A.png"))).when(kind == 1, "media/x").otherwise("media/y")
    name = F.when(kind == 1, F.concat(doc, F.lit("_A_v12_thumb.webp"))).when(kind == 2, "plain.tar.gz").when(kind == 3, F.concat(F.sha2("text", 256), F.lit(".meta")))
    return t.documents.select("doc_id", M.is_thumbnail(path, name).alias("thumbnail"), M.is_sidecar(path, name).alias("sidecar"),
                              M.thumbnail_stem(path, name).alias("stem"))


@query("D6_media_references", """
    select page_id, cast(pos as bigint) as pos, u, pos % 6 in (0, 2, 3, 5) as reference, pos % 6 in (0, 5) as attachment from
      (select page_id, pos, case pos % 6 when 0 then 'https://h' || href || '.PNG?x' when 1 then 'https://h/p' when 2 then '//cdn/image/' || cast(page_id as varchar)
          when 3 then 'blob:' || href when 4 then 'ftp://h/a.png' || 'x' else 'http://h/q' end as u from {refs})""")
def media_references(t: Tables):
    kind = F.col("pos") % 6
    url = F.when(kind == 0, F.concat(F.lit("https://h"), "href", F.lit(".PNG?x"))).when(kind == 1, "https://h/p") \
        .when(kind == 2, F.concat(F.lit("//cdn/image/"), F.col("page_id").cast("string"))).when(kind == 3, F.concat(F.lit("blob:"), "href")) \
        .when(kind == 4, "ftp://h/a.pngx").otherwise("http://h/q")
    hint = F.when(kind == 5, "previewUrl").otherwise("x")
    none = F.lit(None).cast("string")
    return t.refs.select("page_id", F.col("pos").cast("bigint").alias("pos"), url.alias("u"),
                         M.looks_like_reference(url, hint).alias("reference"),
                         M.is_attachment_reference(url, hint, none, F.lit(False)).alias("attachment"))


@query("D7_base64", r"""
    select doc_id, length(b) % 4 <> 1 and regexp_matches(b, '^[A-Za-z0-9+/_-]*={{0,2}}$') and b <> '' and not starts_with(b, '__') as valid,
       length(b) % 4 <> 1 and regexp_matches(b, '^[A-Za-z0-9+/_-]*={{0,2}}$') and length(b) >= 16 and not starts_with(b, '__') as payload
    from (select doc_id, regexp_replace(v, '\s+', '', 'g') as b from (select doc_id, case doc_id % 4 when 0 then to_base64(encode(text))
        when 1 then '__' || substring(sha256(text), 1, 22) when 2 then text else substring(sha256(text), 1, cast(doc_id % 40 as bigint)) end as v from {documents}))""")
def base64(t: Tables):
    kind = F.col("doc_id") % 4
    value = F.when(kind == 0, F.base64(F.col("text").cast("binary"))).when(kind == 1, F.concat(F.lit("__"), F.substring(F.sha2("text", 256), 1, 22))) \
        .when(kind == 2, F.col("text")).otherwise(F.expr("substring(sha2(text, 256), 1, cast(doc_id % 40 as int))"))
    return t.documents.select("doc_id", M.is_base64_text(value).alias("valid"), M.is_base64_payload(value).alias("payload"))


@query("D8_safe_paths", """
    select doc_id, doc_id % 17 <> 3 and doc_id % 19 <> 4 and doc_id % 23 <> 5 and doc_id % 29 <> 6 as safe from {documents}""")
def safe_paths(t: Tables):
    path = F.when(F.col("doc_id") % 23 == 5, F.concat("path", F.lit("\\x"))).when(F.col("doc_id") % 29 == 6, F.concat(F.lit("other/"), "path")).otherwise(F.col("path"))
    return t.paths.select("doc_id", P.safe_path(path, ["media", "captures"]).alias("safe"))


@query("D9_path_category", """
    select doc_id, case doc_id % 6 when 0 then 'captures' when 1 then 'media' when 2 then 'stores' when 3 then 'recovered-media' when 4 then 'captures' else 'indexes' end as layer,
       case doc_id % 6 when 0 then 'standalone-asset' when 1 then 'standalone-asset' when 2 then 'filesystem-metadata' when 3 then 'standalone-asset'
            when 4 then 'extracted-source' else 'derived-or-metadata' end as category from {documents}""")
def path_category(t: Tables):
    doc = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 6
    path = F.when(kind == 0, F.concat(F.lit("captures/c1/opfs/"), doc)).when(kind == 1, F.concat(F.lit("media/sha256/ab/"), doc)) \
        .when(kind == 2, F.concat(F.lit("stores/._"), doc)).when(kind == 3, F.concat(F.lit("recovered-media/media/"), doc)) \
        .when(kind == 4, F.concat(F.lit("captures/c1/stores/"), doc, F.lit(".jsonl"))).otherwise(F.concat(F.lit("indexes/"), doc))
    return t.documents.select("doc_id", P.path_layer(path).alias("layer"), P.path_category(path).alias("category"))


@query("D10_inline_media_stores", """
    select event_id, event_id % 5 in (0, 3) as inline_media from {events}""")
def inline_media_stores(t: Tables):
    kind = F.col("event_id") % 5
    name = F.when(kind == 0, F.concat("event_type", F.lit(":messageImages"))).when(kind == 1, F.concat(F.lit("idb:"), "event_type", F.lit("Media"))) \
        .when(kind == 2, F.concat("event_type", F.lit("MediaIndex"))).when(kind == 3, F.concat(F.lit("studioVideo"), "event_type", F.lit("Media"))) \
        .otherwise(F.col("event_type"))
    return t.events.select("event_id", P.inline_media_store(name).alias("inline_media"))


@query("D11_unresolved_media", """
    select media_id, 'No bytes, inline payload, or fetchable media URL was available.' as reason from {media}
    where not available and media_id % 4 <> 2""")
def unresolved_media(t: Tables):
    from threadlake.operators.content import unresolved
    items = t.media.select(
        "media_id", F.when(F.col("available"), F.concat(F.lit("media/"), F.col("media_id").cast("string"))).alias("path"),
        F.when(F.col("media_id") % 4 == 2, "https://h/x").alias("url"), F.lit(None).cast("string").alias("original_url"))
    return unresolved(items, ["path", "url", "original_url"]).select("media_id", "reason")


@query("E17_drop_covered_failures", """
    with items as (select doc_id as item_id, case when doc_id % 4 = 0 then null else doc_id % 400 end as record_id, source,
          doc_id % 300 as message_id, case when doc_id % 3 <> 0 then doc_id end as path, doc_id % 3 = 0 as failed from {documents}),
      keyed as (select *, coalesce(record_id, item_id) as identity from items)
    select item_id, record_id, source, message_id, path, case when failed then 'failed' else 'materialized' end as status from keyed k
    where not failed or not (
      identity in (select identity from keyed where path is not null)
      or exists (select 1 from keyed g where g.path is not null and g.source = k.source and g.message_id = k.message_id and g.identity = k.identity)
      or (record_id is null and exists (select 1 from keyed g where g.path is not null and g.source = k.source and g.message_id = k.message_id)))""")
def drop_covered_failures(t: Tables):
    doc = F.col("doc_id")
    items = t.documents.select(
        doc.alias("item_id"), F.when(doc % 4 != 0, doc % 400).alias("record_id"), "source", (doc % 300).alias("message_id"),
        F.when(doc % 3 != 0, doc).alias("path"), F.when(doc % 3 == 0, "failed").otherwise("materialized").alias("status"))
    return L.drop_covered_failures(items)
