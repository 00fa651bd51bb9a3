"""Views that give the provided tables the shape of a conversation archive.

Each entry is (text for both engines, text for DuckDB or None when the same).
"""

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, tuple[str, str | None]] = {
    # messages: one row per turn; `seq` is unique inside a conversation
    "msgs": (
        """select conv_id as conversation_id,
                  concat(cast(conv_id as string), '-', cast(turn as string)) as id,
                  turn as seq, role, text,
                  case when role = 'assistant' then concat('model-', cast(conv_id % 3 as string)) end as model,
                  1704067200000 + conv_id * 3600000 + turn * 60000 as created_ms
           from {conversations}""",
        None,
    ),
    # conversation records; every eleventh is missing, so some messages are orphans
    "convs": (
        """select distinct conv_id as id,
                  case when conv_id % 5 = 0 then null else concat('Conversation ', cast(conv_id as string)) end as title,
                  case conv_id % 4 when 0 then 'chat' when 1 then 'agentic' when 2 then 'studio' else 'support' end as kind
           from {conversations} where conv_id % 11 <> 0""",
        None,
    ),
    "media": (
        """select doc_id as media_id, doc_id % 100 as conversation_id,
                  concat(cast(doc_id % 100 as string), '-', cast(cast(floor(doc_id / 100) as bigint) % 3 as string)) as message_id,
                  case doc_id % 4 when 0 then 'image' when 1 then 'video' when 2 then 'audio' else 'file' end as kind,
                  doc_id % 6 <> 0 as available,
                  case when doc_id % 10 = 3 then 'input' when doc_id % 10 = 4 then null else 'output' end as disposition,
                  source, lang, text
           from {documents}""",
        None,
    ),
    "payloads": (
        """select doc_id, source as layer, lang as category, sha2(text, 256) as sha,
                  cast(octet_length(text) as bigint) as bytes from {documents}""",
        """select doc_id, source as layer, lang as category, sha256(text) as sha,
                  cast(strlen(text) as bigint) as bytes from {documents}""",
    ),
    # media rows with content identity and the fields a gallery shows
    "files": (
        """select m.media_id, m.conversation_id, m.message_id, m.kind, m.available, m.disposition, m.source,
                  p.sha, p.bytes,
                  case when m.media_id % 9 = 5 then null else concat(m.kind, '-', cast(m.media_id as string), '.',
                    case m.kind when 'image' then 'png' when 'video' then 'mp4' when 'audio' then 'mp3' else 'pdf' end) end as file_name,
                  case m.kind when 'image' then 'image/png' when 'video' then 'video/mp4' when 'audio' then 'audio/mpeg' else 'application/pdf' end as mime_type,
                  case when m.media_id % 3 = 0 then null else m.text end as prompt,
                  case when m.media_id % 7 = 0 then null else 1704067200000 + m.media_id * 1000 end as created_ms,
                  m.media_id % 8 = 1 as is_thumbnail,
                  coalesce(m.disposition = 'input', false) as is_uploaded,
                  case when m.available then case when m.media_id % 4 = 1 then 'materialized' else 'deduped' end else 'metadata-only' end as status,
                  case when m.media_id % 5 = 2 then 'recovered media' else 'capture' end as archive_source,
                  m.media_id % 12 = 7 as format_corrected
           from {media} m join {payloads} p on p.doc_id = m.media_id""",
        None,
    ),
    "prefs": (
        """select concat('id:', cast(doc_id as string)) as pref_key, quality = 1 as favourite, toxic = 1 as hidden
           from {labels}""",
        None,
    ),
    "snap_a": (
        """select o_orderkey as id, o_custkey as parent_id, o_orderstatus as body
           from {orders} where o_orderkey % 7 <> 0""",
        None,
    ),
    "snap_b": (
        """select o_orderkey as id, o_custkey as parent_id,
                  case when o_orderkey % 5 = 0 then concat(o_orderstatus, '*') else o_orderstatus end as body
           from {orders} where o_orderkey % 11 <> 0""",
        None,
    ),
    # a third snapshot, for registries that live over several rounds
    "snap_c": (
        """select o_orderkey as id, o_custkey as parent_id, o_orderstatus as body
           from {orders} where o_orderkey % 13 <> 0""",
        None,
    ),
    "refs": (
        """select page_id, pos + 1 as pos, href from
             (select page_id, posexplode(regexp_extract_all(html, r'href="([^"]*)"', 1)) as (pos, href) from {pages})""",
        """select page_id, unnest(generate_series(1, len(l))) as pos, unnest(l) as href
           from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as l from {pages})""",
    ),
    # file paths of a media tree, one per document, with attachments and unsafe rows mixed in
    "paths": (
        """select doc_id, concat(
                    case when doc_id % 17 = 3 then '../' when doc_id % 19 = 4 then '/' else '' end,
                    'media/', cast(doc_id % 100 as string), '/',
                    case when doc_id % 3 = 0 then 'attachments/' else '' end,
                    cast(doc_id % 100 as string), '-', cast(cast(floor(doc_id / 100) as bigint) % 3 as string),
                    case when doc_id % 6 = 0 then '__m2' else '' end,
                    case when doc_id % 5 = 0 then '' else '.png' end) as path
           from {documents}""",
        None,
    ),
}
