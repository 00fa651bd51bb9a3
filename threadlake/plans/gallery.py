"""Queries over the media library."""

from pyspark.sql import functions as F

from threadlake.operators import content as C
from threadlake.operators import gallery as G
from threadlake.operators import links as L
from threadlake.operators import merge as X
from threadlake.plans.conversations import ROLLUP, rolled
from threadlake.plans.registry import Tables, query

_PREFS = """pref as (select f.*, coalesce(p.favourite, false) as favourite, coalesce(p.hidden, false) as hidden from {files} f
    left join {prefs} p on p.pref_key = concat('id:', cast(f.media_id as varchar)))"""


def preferred(t: Tables):
    return G.with_preferences(t.files, t.prefs, G.preference_key(F.lit(None).cast("string"), F.col("media_id")))


@query("E16_preferences", "with " + _PREFS + " select media_id, favourite, hidden from pref")
def preferences(t: Tables):
    return preferred(t).select("media_id", "favourite", "hidden")


_STAGE = """staged as (select * from pref where not is_thumbnail and available and contains(lower(concat_ws(' ', coalesce(file_name, ''), coalesce(prompt, ''), mime_type, source)), 'e'))"""


@query("D2_filter_media", "with " + _PREFS + ", " + _STAGE + " select media_id, kind, favourite from staged where not is_uploaded and not hidden and kind = 'video'")
def filter_media(t: Tables):
    stages = G.listing_stages(preferred(t), "E")
    return G.listing_rows(stages, "video").select("media_id", "kind", "favourite")


@query("D2_favourite_media", "with " + _PREFS + " select media_id, kind, hidden from pref where favourite and source = 'src0'")
def favourite_media(t: Tables):
    stages = G.listing_stages(preferred(t), status="all", source="src0", uploads=True, thumbnails=True, favourites_only=True)
    return G.listing_rows(stages, include_hidden=True).select("media_id", "kind", "hidden")


@query("F4_gallery_facets", "with " + _PREFS + ", " + _STAGE + """
    select cast(count_if(is_uploaded) as bigint) as uploads, cast(count_if(not is_uploaded and kind = 'image' and hidden) as bigint) as hidden,
       cast(count_if(not is_uploaded and not hidden and favourite) as bigint) as favourites, cast(count_if(not is_uploaded and not hidden) as bigint) as "all",
       cast(count_if(not is_uploaded and not hidden and kind = 'image') as bigint) as image, cast(count_if(not is_uploaded and not hidden and kind = 'video') as bigint) as video,
       cast(count_if(not is_uploaded and not hidden and kind = 'audio') as bigint) as audio, cast(count_if(not is_uploaded and not hidden and kind = 'file') as bigint) as file,
       cast(count_if(not is_uploaded and not hidden and kind = 'image') as bigint) as total from staged""")
def gallery_facets(t: Tables):
    return G.listing_facets(G.listing_stages(preferred(t), "E"), "image")


@query("F7_gallery_summary", """
    select count(*) as total, cast(count_if(available) as bigint) as exported, cast(count_if(not available and media_id % 5 = 1) as bigint) as linked,
      cast(count_if(not available and media_id % 5 <> 1) as bigint) as metadata_only, cast(count_if(not available) as bigint) as unresolved,
      cast(count_if(kind = 'image') as bigint) as images, cast(count_if(kind = 'video') as bigint) as videos, cast(count_if(kind = 'audio') as bigint) as audios,
      cast(count_if(kind = 'file') as bigint) as files, cast(count_if(conversation_id % 11 = 0) as bigint) as orphaned, cast(sum(bytes) as bigint) as bytes from {files}""")
def gallery_summary(t: Tables):
    rows = t.files.select(
        F.when(F.col("available"), "x").alias("local_path"), F.when(F.col("media_id") % 5 == 1, "u").alias("source_url"),
        "kind", (F.col("conversation_id") % 11 == 0).alias("orphaned"), "bytes")
    return G.gallery_summary(rows)


@query("C26_gallery_rows", """
    with g as (select f.media_id, case when available and f.media_id % 2 = 0 then 'p/' || cast(f.media_id % 50 as varchar) else null end as path,
         f.kind, f.file_name, f.sha, f.source, f.status, f.created_ms, f.prompt, f.mime_type, m.created_ms as said_ms, m.model, m.role, m.text, c.title
       from {files} f left join {msgs} m on m.conversation_id = f.conversation_id and m.id = f.message_id left join {convs} c on c.id = f.conversation_id),
     r as (select coalesce(path, cast(media_id as varchar)) as key, media_id, case when kind in ('image', 'video', 'audio') then kind else 'attachment' end as kind,
         case when file_name is not null then file_name else substring(sha, 1, 12) || '.' || case mime_type when 'image/png' then 'png' when 'video/mp4' then 'mp4' when 'audio/mpeg' then 'mp3' else 'pdf' end end as name,
         coalesce(title, '') as conversation_title, coalesce(created_ms, said_ms) as created_ms, coalesce(model, '') as model,
         sha256(trim(coalesce(nullif(prompt, ''), case when role <> 'assistant' then text end, ''), ' ')) as prompt_digest,
         path is not null as local, path is null as review from g)
    select * exclude (rn) from (select *, row_number() over (partition by key order by media_id) as rn from r) where rn = 1""")
def gallery_rows(t: Tables):
    path = F.when(F.col("available") & (F.col("media_id") % 2 == 0), F.concat(F.lit("p/"), F.col("media_id") % 50))
    rows = G.gallery_rows(t.files.withColumns({"path": path, "url": F.lit(None).cast("string")}), t.msgs, t.convs)
    return G.unique_gallery(rows).select(
        "key", "media_id", "kind", "name", "conversation_title", "created_ms", "model", F.sha2("prompt", 256).alias("prompt_digest"), "local", "review")


@query("E6_inherit_message", """
    select f.media_id, coalesce(f.created_ms, m.created_ms) as created_ms, sha256(coalesce(nullif(f.prompt, ''), m.text)) as prompt_digest
    from {files} f left join {msgs} m on m.conversation_id = f.conversation_id and m.id = f.message_id""")
def inherit_message(t: Tables):
    rows = G.inherit_from_message(t.files, t.msgs)
    return rows.select("media_id", "created_ms", F.sha2("prompt", 256).alias("prompt_digest"))


@query("E7_media_conversation", ROLLUP + """
    select f.media_id, r.title as conversation_title, r.kind as conversation_kind, coalesce(r.message_count, 0) as conversation_messages
    from {files} f left join rolled r on r.id = f.conversation_id""")
def media_conversation(t: Tables):
    return L.with_conversation(t.files.select("media_id", "conversation_id"), rolled(t)).drop("conversation_id")


@query("H4_display_message", """
    with m as (select *, last_value(case when role = 'user' then id end ignore nulls) over (partition by conversation_id order by seq rows between unbounded preceding and 1 preceding) as user_id from {msgs}),
      j as (select f.media_id, f.message_id, m.role, m.model, m.user_id, coalesce(f.disposition, case when m.role = 'user' then 'input' else 'media' end) as disposition
            from {files} f left join m on m.conversation_id = f.conversation_id and m.id = f.message_id)
    select media_id, disposition, case when role = 'assistant' and disposition = 'input' then coalesce(user_id, message_id) else message_id end as display_message_id,
       case when disposition <> 'input' and (disposition = 'output' or role = 'assistant') then model end as model,
       disposition = 'input' or coalesce(role = 'user', false) as uploaded from j""")
def display_message(t: Tables):
    return G.display_message(t.files, t.msgs).select("media_id", "disposition", "display_message_id", "model", "uploaded")


@query("E15_recover_by_hash", """
    with best as (select sha, media_id as donor_id, archive_source as donor_source, kind as donor_kind from (select *, row_number() over (partition by sha order by
           case when format_corrected then 0 else 4 end + case when status = 'materialized' then 2 else 0 end + case when archive_source like 'recovered%' then 1 else 0 end desc, media_id) as rn
           from {files} where available) where rn = 1),
      j as (select f.*, b.donor_id, b.donor_source, b.donor_kind, not f.available and b.donor_id is not null and not exists (select 1 from {files} g where g.available and g.sha = f.sha
           and g.message_id = f.message_id and g.kind = f.kind) as recovered from {files} f left join best b on b.sha = f.sha)
    select media_id, available or recovered as available, case when recovered then 'deduped' else status end as status,
       case when recovered then donor_source else archive_source end as archive_source, case when recovered then donor_kind else kind end as kind,
       recovered, case when recovered then donor_id end as donor_id from j""")
def recover_by_hash(t: Tables):
    return G.recover_by_hash(t.files).select("media_id", "available", "status", "archive_source", "kind", "recovered", "donor_id")


_COVER = """items as (select media_id, conversation_id, case when media_id % 8 = 3 then null else message_id end as message_id, kind, available, sha, media_id % 8 = 1 as is_thumbnail,
    case when media_id % 16 = 1 then concat(cast(conversation_id as varchar), '_', message_id) else 'none' end as stem from {files})"""


@query("L5_suppress_covered", "with " + _COVER + """,
    linked as (select * from items where available and message_id is not null),
    kept as (select * from items i where not (i.is_thumbnail and i.stem in (select lower(concat(cast(conversation_id as varchar), '_', message_id)) from linked where not is_thumbnail))
      and not (not i.available and i.message_id is not null and exists (select 1 from linked l where l.message_id = i.message_id and l.kind = i.kind))
      and not (i.available and i.message_id is null and exists (select 1 from linked l where l.sha = i.sha and l.conversation_id = i.conversation_id)))
    select media_id from (select *, row_number() over (partition by conversation_id, message_id, kind, sha, available order by media_id) as rn from kept)
    where rn = 1 or not available or message_id is null""")
def suppress_covered(t: Tables):
    message = F.when(F.col("media_id") % 8 != 3, F.col("message_id"))
    stem = F.when(F.col("media_id") % 16 == 1, F.concat(F.col("conversation_id").cast("string"), F.lit("_"), "message_id")).otherwise("none")
    items = t.files.withColumn("stem", stem).withColumn("message_id", message).withColumn("is_thumbnail", F.col("media_id") % 8 == 1)
    return G.suppress_covered(items.select("media_id", "conversation_id", "message_id", "kind", "available", "sha", "is_thumbnail", "stem")).select("media_id")


@query("E3_unclaimed_files", """
    select 'file:' || path as media_id, conversation_id, message_id, path as original_path from (
      select p.path, p.doc_id, case when safe then cast(p.doc_id % 100 as varchar) end as conversation_id,
         case when safe then cast(p.doc_id % 100 as varchar) || '-' || cast((p.doc_id // 100) % 3 as varchar) || case when p.doc_id % 6 = 0 and p.doc_id % 3 <> 0 then '__m2' else '' end end as message_id
      from (select *, doc_id % 17 <> 3 and doc_id % 19 <> 4 as safe from {paths}) p) where doc_id % 4 <> 0""")
def unclaimed_files(t: Tables):
    archived = F.concat(F.lit("opfs/"), F.col("doc_id").cast("string"))
    files = t.paths.select(archived.alias("archived_path"), "path", F.lit("x.png").alias("file_name"), F.lit("image/png").alias("mime_type"))
    media = t.paths.select(F.when(F.col("doc_id") % 4 == 0, archived).alias("path"))
    return L.unclaimed_files(files, media).select("media_id", "conversation_id", "message_id", "original_path")


@query("E2_attach_files", """
    with f as (select doc_id, 'a/' || cast(doc_id as varchar) as archived_path, doc_id * 3 as bytes from {documents} where doc_id % 2 = 0)
    select cast(m.doc_id % 100 as varchar) as conversation_id, 'r' || cast(m.doc_id as varchar) as media_id, f.archived_path as path,
      case when f.doc_id is null then 'source-record' else 'materialized' end as status, f.bytes,
      case when f.doc_id is null then null when m.doc_id % 10 = 0 then 'audio/mpeg' else 'image/png' end as mime_type,
      case when f.doc_id is null then null when m.doc_id % 10 = 0 then 'note.mp3' else 'f' || cast(m.doc_id as varchar) || '.png' end as file_name,
      case when f.doc_id is not null and m.doc_id % 10 = 0 then m.doc_id end as created_ms,
      case when f.doc_id is null then 'file' when m.doc_id % 10 = 0 then 'audio' else 'image' end as kind
    from {documents} m left join f on f.doc_id = m.doc_id""")
def attach_files(t: Tables):
    doc = F.col("doc_id")
    text = doc.cast("string")
    none = F.lit(None).cast("string")
    media = t.documents.select((doc % 100).cast("string").alias("conversation_id"), F.concat(F.lit("r"), text).alias("media_id"), none.alias("message_id"),
                               F.lit("store").alias("source"), F.lit("source-record").alias("status"), none.alias("mime_type"), none.alias("file_name"), F.lit(None).cast("bigint").alias("created_ms"))
    path = F.concat(F.lit("media/"), (doc % 100).cast("string"), F.when(doc % 4 == 0, "/attachments/").otherwise("/"), F.lit("r"), text, F.lit(".bin"))
    files = t.documents.where(doc % 2 == 0).select(path.alias("path"), F.concat(F.lit("a/"), text).alias("archived_path"), F.concat(F.lit("f"), text, F.lit(".png")).alias("file_name"),
                                                   (doc * 3).alias("bytes"), F.lit("image/png").alias("mime_type"))
    sidecars = t.documents.where(doc % 10 == 0).select(path.alias("target_path"), F.lit("note.mp3").alias("file_name"), F.lit("audio/mpeg").alias("mime_type"), doc.alias("stored_ms"))
    return L.attach_files(media, files, sidecars).select("conversation_id", "media_id", "path", "status", "bytes", "mime_type", "file_name", "created_ms", "kind")


@query("E4_link_by_path", """
    select doc_id as file_id, case when m.id is not null or n.id is not null then cast(doc_id % 100 as varchar) end as conversation_id, coalesce(m.id, n.id) as message_id
    from (select doc_id, doc_id % 100 as c, case when doc_id % 3 = 0 then 'x' || cast(doc_id as varchar) else cast(doc_id % 100 as varchar) || '-' || cast((doc_id // 100) % 3 as varchar) end as mid from {documents}) d
    left join {msgs} m on m.conversation_id = d.c and m.id = d.mid
    left join {msgs} n on n.conversation_id = d.c and d.doc_id % 3 = 0 and d.doc_id = n.conversation_id + 100 * (3 * n.seq + (3 - n.conversation_id % 3) % 3)""")
def link_by_path(t: Tables):
    doc, conversation = F.col("doc_id"), F.col("conversation_id")
    text = lambda c: c.cast("string")
    name = F.when(doc % 3 == 0, F.concat(F.lit("x"), text(doc))).otherwise(F.concat(text(doc % 100), F.lit("-"), text(F.floor(doc / 100) % 3)))
    files = t.documents.select(doc.alias("file_id"), F.concat(F.lit("media/"), text(doc % 100), F.lit("/"), name, F.lit(".png")).alias("path"))
    saved = conversation + 100 * (3 * F.col("seq") + (3 - conversation % 3) % 3)
    messages = t.msgs.select(text(conversation).alias("conversation_id"), "id", "seq",
                             F.concat(text(conversation), F.lit("/x"), text(saved), F.lit(".png")).alias("file_name"))
    return L.link_by_path(files, messages).select("file_id", "conversation_id", "message_id")


@query("E5_enrich_by_link", """
    select doc_id as media_id, case when doc_id % 4 = 0 then 'own' when doc_id % 3 = 0 then 'prompt-' || cast(doc_id as varchar) when doc_id % 5 = 0 then 'prompt-' || cast(doc_id + 1 as varchar) end as prompt,
       case when doc_id % 3 = 0 then lang when doc_id % 5 = 0 then 'path' end as model from {documents}""")
def enrich_by_link(t: Tables):
    doc = F.col("doc_id")
    media = t.documents.select(
        doc.alias("media_id"), F.when(doc % 5 == 0, doc + 10_000_000).alias("path_id"), F.when(doc % 4 == 0, "own").alias("prompt"), F.lit(None).cast("string").alias("model"))
    links = t.documents.where(doc % 3 == 0).select(doc.alias("link_id"), F.concat(F.lit("prompt-"), doc.cast("string")).alias("prompt"), F.col("lang").alias("model")).unionByName(
        t.documents.where(doc % 5 == 0).select((doc + 10_000_000).alias("link_id"), F.concat(F.lit("prompt-"), (doc + 1).cast("string")).alias("prompt"), F.lit("path").alias("model")))
    return L.enrich_by_link(media, links, ["prompt", "model"]).drop("path_id")


@query("E11_generation_metadata", """
    select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then l_returnflag || ' (' || l_linestatus || ')' when l_linenumber % 3 = 1 then coalesce(o_orderstatus, '') else 'default-model' end as model_label,
       case when l_linenumber % 3 = 0 then 'Media record' when l_linenumber % 3 = 1 then 'Linked message' else 'Workspace settings fallback' end as model_source,
       case when l_linenumber % 3 = 0 then 'r' when l_linenumber % 3 = 1 then 'w' else 'w' end as settings,
       case when l_linenumber % 3 = 0 then 'Media record' else 'Workspace settings fallback' end as settings_source
    from {lineitem} join {orders} on o_orderkey = l_orderkey""")
def generation_metadata(t: Tables):
    none = F.lit(None).cast("string")
    line = F.col("l_linenumber") % 3
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    rows = t.lineitem.join(orders, "l_orderkey").select(
        "l_orderkey", "l_linenumber", F.when(line == 0, F.col("l_returnflag")).alias("record_model"), F.when(line == 0, F.col("l_linestatus")).alias("record_model_id"),
        F.when(line == 0, "r").alias("record_settings"), none.alias("message_model"), F.when(line == 1, F.col("o_orderstatus")).alias("message_model_id"), none.alias("message_settings"),
        none.alias("parent_model"), none.alias("parent_model_id"), none.alias("parent_settings"), F.lit("default-model").alias("settings_model_id"), F.lit("w").alias("settings_settings"))
    return L.generation_metadata(rows)


@query("E14_missing_matches", """
    with c as (select parent_id as message_id, substring(body, 1, 1) as kind, body as sha from {snap_b}),
      k as (select message_id, kind, count(*) as matches, count(distinct sha) as identities, min(sha) as identity from c group by 1, 2),
      n as (select lower('f' || cast(id % 500 as varchar)) as name, count(*) as name_matches from {snap_b} group by 1)
    select a.id, k.matches, k.identities, case when identities = 1 then 'high' else 'ambiguous' end as confidence, case when identities = 1 then identity end as identity,
      coalesce(n.name_matches, 0) as name_matches
    from {snap_a} a join k on k.message_id = a.parent_id and k.kind = a.body left join n on n.name = 'f' || cast(a.id % 600 as varchar) where a.id % 3 = 0""")
def missing_matches(t: Tables):
    missing = t.snap_a.where("id % 3 = 0").select("id", F.col("parent_id").alias("message_id"), F.col("body").alias("kind"), F.concat(F.lit("F"), F.col("id") % 600).alias("file_name"))
    candidates = t.snap_b.select(F.col("parent_id").alias("message_id"), F.substring("body", 1, 1).alias("kind"), F.col("body").alias("sha"),
                                 F.lit("x").alias("file"), F.lit(1).alias("bytes"), F.concat(F.lit("f"), F.col("id") % 500).alias("file_name"))
    return L.missing_matches(missing, candidates)


@query("E18_supplement", """
    select f.media_id, coalesce(f.file_name, 'title-' || cast(f.media_id as varchar)) as file_name, coalesce(f.prompt, d.lang) as prompt
    from {files} f left join (select doc_id, case when doc_id % 2 = 0 then lang end as lang from {documents}) d on d.doc_id = f.media_id""")
def supplement(t: Tables):
    projection = t.documents.select(F.col("doc_id").alias("media_id"), F.concat(F.lit("title-"), F.col("doc_id").cast("string")).alias("file_name"),
                                    F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("prompt"))
    return L.supplement(t.files.select("media_id", "file_name", "prompt"), projection, "media_id", ["file_name", "prompt"])


@query("E19_attach_to_messages", """
    with shown as (select conversation_id, id as message_id, seq, conversation_id * 10 + seq as record_id, 'm' || cast(conversation_id + seq as varchar) as media_id from {msgs}),
      last as (select conversation_id, arg_max(id, seq) as last_id from {msgs} group by 1)
    select d.doc_id as file_id, d.doc_id % 120 as conversation_id,
      coalesce(s.message_id, case when p.message_id is null then l.last_id end) as message_id,
      case when s.message_id is not null then 'record' when p.message_id is not null then 'present' when l.last_id is not null then 'last' else 'none' end as attached_by
    from {documents} d left join shown s on s.conversation_id = d.doc_id % 120 and s.record_id = (d.doc_id % 120) * 10 + (d.doc_id // 120)
    left join last l on l.conversation_id = d.doc_id % 120
    left join shown p on p.conversation_id = d.doc_id % 120 and p.message_id = l.last_id and p.media_id = 'm' || cast(d.doc_id % 120 + (d.doc_id // 120) % 4 as varchar)""")
def attach_to_messages(t: Tables):
    conversation, nth = F.col("doc_id") % 120, F.floor(F.col("doc_id") / 120)
    files = t.documents.select(F.col("doc_id").alias("file_id"), conversation.alias("conversation_id"), (conversation * 10 + nth).alias("record_id"),
                               F.concat(F.lit("m"), (conversation + nth % 4).cast("string")).alias("media_id"))
    shown = t.msgs.select("conversation_id", F.col("id").alias("message_id"), "seq", (F.col("conversation_id") * 10 + F.col("seq")).alias("record_id"),
                          F.concat(F.lit("m"), (F.col("conversation_id") + F.col("seq")).cast("string")).alias("media_id"))
    return L.attach_to_messages(files, shown, t.msgs)


def _shown(text: str) -> str:
    """A text in SQL, cut to 260 characters and cleaned, null when nothing is left."""
    return f"nullif(trim(regexp_replace(case when length({text}) > 260 then substring({text}, 1, 257) || '...' else {text} end, '\\s+', ' ', 'g')), '')"


_PLACE = "case when f.media_id % 5 = 0 then 'Media record' when m.model is not null then 'Linked message' when p.model is not null then 'Prompt message' else 'Workspace settings fallback' end"


@query("J11_gallery_items", f"""
    with i as (select f.*, p.id as parent_id, c.title, {_shown('p.text')} as asked, {_shown('m.text')} as said, {_PLACE} as model_source, coalesce(m.model, p.model) as said_model,
        coalesce(o.n_nationkey, s.n_nationkey, 7) as setting, case when o.n_nationkey is not null then 'item_owner' when s.n_nationkey is not null then 'conversation_owner' else 'default' end as matched_by
      from {{files}} f left join {{msgs}} m on m.conversation_id = f.conversation_id and m.id = f.message_id left join {{msgs}} p on p.conversation_id = m.conversation_id and p.seq = m.seq - 1
      left join {{convs}} c on c.id = f.conversation_id left join {{nation}} s on s.n_nationkey = f.conversation_id left join {{nation}} o on o.n_nationkey = f.media_id),
      d as (select i.*, n_name, coalesce(title, asked, said, cast(media_id as varchar)) as display_title from i join {{nation}} n on n.n_nationkey = setting)
    select media_id, display_title, parent_id, model_source, case when media_id % 5 = 0 then 'rec (rid)' when said_model is not null then said_model || ' (' || n_name || ')' else n_name end as model_label,
      case when media_id % 5 = 0 then 'r' else 'w' || cast(setting as varchar) end as settings, case when media_id % 5 = 0 then 'Media record' else 'Workspace settings fallback' end as settings_source,
      matched_by,
      sha256(lower(concat_ws(' ', display_title, title, asked, said, cast(media_id as varchar), message_id, source, mime_type, kind))) as digest from d""")
def gallery_items(t: Tables):
    none, own = F.lit(None).cast("string"), F.col("media_id") % 5 == 0
    media = t.files.select("media_id", "conversation_id", "message_id", "source", "mime_type", "kind", F.when(own, "rec").alias("model"), F.when(own, "rid").alias("model_id"), F.when(own, "r").alias("settings"))
    parent = F.when(F.col("seq") > 0, F.concat_ws("-", F.col("conversation_id").cast("string"), (F.col("seq") - 1).cast("string")))
    messages = t.msgs.select("conversation_id", "id", parent.alias("parent_id"), "text", "model", none.alias("model_id"), none.alias("settings"))
    key = F.col("n_nationkey").cast("string")
    settings = t.nation.select(
        key.alias("owner_id"), F.concat(F.lit("s"), key).alias("settings_id"), (F.col("n_nationkey") == 7).alias("is_default"), F.col("n_nationkey").alias("line_no"),
        none.alias("model"), F.col("n_name").alias("model_id"), F.concat(F.lit("w"), key).alias("settings"))
    return G.described_items(media, messages, t.convs, settings).select(
        "media_id", "display_title", "parent_id", "model_source", "model_label", "settings", "settings_source", "matched_by", F.sha2("search_text", 256).alias("digest"))


@query("L4_reconcile_media", """
    select f.media_id, f.available and f.media_id % 13 <> 0 as available, case when f.available and f.media_id % 13 <> 0 then 'materialized' else 'missing' end as status,
      case when f.available and f.media_id % 13 <> 0 and f.media_id % 4 = 1 and f.file_name is not null then replace(f.file_name, '.mp4', '.webm') else f.file_name end as file_name,
      case when f.available and f.media_id % 13 <> 0 and f.media_id % 4 = 1 then 'video/webm' else f.mime_type end as mime_type,
      f.available and f.media_id % 13 <> 0 and f.media_id % 4 = 1 as format_corrected from {files} f""")
def reconcile_media(t: Tables):
    path = F.concat(F.lit("media/"), F.col("media_id").cast("string"))
    webm = F.col("media_id") % 4 == 1
    mime = F.when(webm, "video/webm").otherwise(F.col("mime_type"))
    dot = F.when(webm, ".webm").otherwise(F.element_at(F.create_map(*[F.lit(x) for x in ("image/png", ".png", "audio/mpeg", ".mp3", "application/pdf", ".pdf", "video/mp4", ".mp4")]), F.col("mime_type")))
    none = F.lit(None).cast("bigint")
    objects = t.files.where("media_id % 13 <> 0").select(path.alias("path"), "bytes", dot.alias("extension"), mime.alias("detected_mime"),
                                                       F.col("kind").alias("detected_kind"), none.alias("width"), none.alias("height"))
    rows = C.reconcile(t.files.select("media_id", path.alias("path"), "file_name", "mime_type", "kind", "available"), objects)
    return rows.select("media_id", "available", "status", "file_name", "mime_type", "format_corrected")


@query("I7_skip_imported", """
    select layer, item_id from (select case doc_id % 3 when 0 then 'capture' when 1 then 'imported' else 'recovery' end as layer, doc_id as item_id,
       case when doc_id % 40 = 7 then 'recovered' else cast(doc_id % 97 as varchar) end as conversation_id from {documents}) r
    where not (layer = 'imported' and (conversation_id = 'recovered' or conversation_id in (select cast(id as varchar) from {convs} where id % 2 = 0)))""")
def skip_imported(t: Tables):
    kind = F.col("doc_id") % 3
    rows = t.documents.select(F.when(kind == 0, "capture").when(kind == 1, "imported").otherwise("recovery").alias("layer"), F.col("doc_id").alias("item_id"),
                              F.when(F.col("doc_id") % 40 == 7, "recovered").otherwise((F.col("doc_id") % 97).cast("string")).alias("conversation_id"))
    captured = t.convs.where("id % 2 = 0").select(F.col("id").cast("string").alias("id"))
    return X.skip_imported(rows, captured, "conversation_id").select("layer", "item_id")


@query("H1_media_identity", """
    select identity, count(*) as copies from (select case when doc_id % 3 = 0 then 'relationship:' || cast(doc_id % 100 as varchar) || ':m:' || case when doc_id % 2 = 0 then cast(doc_id % 200 as varchar) else 'p' end
      when doc_id % 3 = 1 and doc_id % 2 = 0 then 'id:' || cast(doc_id % 200 as varchar) when doc_id % 5 <> 0 then 'sha256:' || sha256(text)
      when doc_id % 2 = 0 then 'id:' || cast(doc_id % 200 as varchar) else source || ':' || cast(doc_id as varchar) end as identity from {documents}) group by 1""")
def media_identity(t: Tables):
    doc = F.col("doc_id")
    rows = t.documents.select(
        F.when(doc % 3 == 0, doc % 100).alias("conversation_id"), F.when(doc % 3 == 0, "m").alias("message_id"), F.when(doc % 2 == 0, doc % 200).alias("stable_id"),
        F.lit("p").alias("path"), doc.alias("local_id"), F.when(doc % 5 != 0, F.sha2("text", 256)).alias("sha"), F.col("source").alias("source_name"), (doc % 3 == 1).alias("recovery"))
    return rows.groupBy(X.media_identity(F.col("recovery")).alias("identity")).agg(F.count("*").alias("copies"))
