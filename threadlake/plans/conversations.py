"""Queries over conversations and messages: joins, roll-ups, filters, reports."""

from pyspark.sql import functions as F

from threadlake.functions import scalars as S
from threadlake.operators import gallery as G
from threadlake.operators import links as L
from threadlake.operators import merge as X
from threadlake.operators import nested as N
from threadlake.operators import rollups as U
from threadlake.plans.registry import Tables, query

# conversation roll-up in SQL, shared by several twins
PLACED = """placed as (
    select id, coalesce(title, 'Untitled conversation') as title, kind from {convs}
    union all
    select distinct conversation_id, 'Recovered conversation', 'recovered' from {msgs}
    where conversation_id not in (select id from {convs}))"""
ROLLUP = "with " + PLACED + """,
  counted as (select conversation_id, count(*) as message_count, max(created_ms) as updated_ms, min(created_ms) as created_ms,
      arg_min(substring(text, 1, 260), seq) filter (where text <> '') as preview from {msgs} group by 1),
  seen as (select conversation_id, string_agg(model, ',' order by first_seq) as models from
      (select conversation_id, model, min(seq) as first_seq from {msgs} where model is not null group by 1, 2) group by 1),
  linked as (select conversation_id, count(*) as media_count from {media} where conversation_id is not null group by 1),
  rolled as (select p.id, p.title, p.kind, coalesce(c.message_count, 0) as message_count, coalesce(l.media_count, 0) as media_count,
      coalesce(s.models, '') as models, coalesce(c.preview, '') as preview, c.created_ms, c.updated_ms
    from placed p left join counted c on c.conversation_id = p.id left join seen s on s.conversation_id = p.id
    left join linked l on l.conversation_id = p.id) """


def rolled(t: Tables):
    return U.roll_up(t.convs, t.msgs, t.media)


def flat(df):
    return df.withColumn("models", F.array_join("models", ","))


@query("E1_message_conversation", "with " + PLACED + """
    select m.id, m.conversation_id, p.title, p.kind from {msgs} m left join placed p on p.id = m.conversation_id""")
def message_conversation(t: Tables):
    placed = U.with_placeholders(t.convs, t.msgs).withColumnRenamed("id", "conversation_id")
    return t.msgs.select("id", "conversation_id").join(placed, "conversation_id", "left")


@query("F1_conversation_rollup", ROLLUP + "select * from rolled")
def conversation_rollup(t: Tables):
    return flat(rolled(t))


@query("G1_recent_conversations", ROLLUP + "select * from rolled order by coalesce(updated_ms, -1) desc, id limit 60")
def recent_conversations(t: Tables):
    return flat(U.list_conversations(rolled(t), "recent", 60))


for _sort, _order in (("title", "lower(title), id"), ("messages", "message_count desc, id"), ("oldest", "coalesce(updated_ms, -1), id"),
                      ("media", "media_count desc, id"), ("created", "coalesce(created_ms, -1) desc, id")):
    query(f"G1_{_sort}_conversations", ROLLUP + f"select id, title, message_count, media_count from rolled order by {_order} limit 25")(
        lambda t, sort=_sort: U.list_conversations(rolled(t), sort, 25).select("id", "title", "message_count", "media_count"))


@query("G3_recent_top", ROLLUP + """
    select 'conversation' as item, cast(id as bigint) as id, updated_ms as at_ms from
      (select id, updated_ms from rolled order by coalesce(updated_ms, -1) desc, id limit 10)
    union all
    select 'media', media_id, created_ms from
      (select f.media_id, f.created_ms from {files} f left join {prefs} p on p.pref_key = concat('id:', cast(f.media_id as varchar))
       where f.available and not f.is_thumbnail and not f.is_uploaded and not coalesce(p.hidden, false)
       order by coalesce(f.created_ms, -1) desc, f.media_id limit 12)""")
def recent_top(t: Tables):
    conversations = U.list_conversations(rolled(t), "recent", 10).select(
        F.lit("conversation").alias("item"), "id", F.col("updated_ms").alias("at_ms"))
    key = F.concat(F.lit("id:"), F.col("media_id").cast("string"))
    shown = G.with_preferences(t.files, t.prefs, key).where("available and not is_thumbnail and not is_uploaded and not hidden")
    media = shown.orderBy(*G.listing_order("recent")).limit(12).select(
        F.lit("media").alias("item"), F.col("media_id").alias("id"), F.col("created_ms").alias("at_ms"))
    return conversations.unionByName(media)


@query("D1_filter_conversations", ROLLUP + """
    select id, title, kind from rolled where contains(lower(concat_ws(' ', title, preview, replace(models, ',', ' '))), 'model-1') and kind = 'agentic'""")
def filter_conversations(t: Tables):
    return U.filter_conversations(rolled(t), "MODEL-1", "agentic").select("id", "title", "kind")


_TOKENS = ["assistant", "en", "1"]
_META = "with " + PLACED + """,
    said as (select conversation_id, count(*) as message_count, """ + ", ".join(
        f"bool_or(contains(lower(concat_ws(' ', id, role, model, text)), '{w}')) as said_{i}" for i, w in enumerate(_TOKENS)) + """
      from {msgs} group by 1),
    shown as (select conversation_id, count(*) as media_count, count_if(disposition = 'input') as attachments, count_if(available) as local_media,
        count_if(lower(status) in ('failed', 'unresolved', 'metadata-only')) as review_media, """ + ", ".join(
        f"bool_or(contains(lower(concat_ws(' ', file_name, source, prompt, status)), '{w}')) as shown_{i}" for i, w in enumerate(_TOKENS)) + """
      from {files} group by 1),
    meta as (select coalesce(s.conversation_id, f.conversation_id) as conversation_id, coalesce(message_count, 0) as message_count,
        cast(coalesce(media_count, 0) as bigint) as media_count, cast(coalesce(attachments, 0) as bigint) as attachments,
        cast(coalesce(local_media, 0) as bigint) as local_media, cast(coalesce(review_media, 0) as bigint) as review_media, """ + ", ".join(
        f"coalesce(said_{i}, false) or coalesce(shown_{i}, false) as has_{i}" for i in range(len(_TOKENS))) + """
      from said s full join shown f on s.conversation_id = f.conversation_id) """


@query("F3_viewer_meta", _META + "select * from meta")
def viewer_meta(t: Tables):
    return U.viewer_meta(t.msgs, t.files, _TOKENS)


@query("D3_viewer_filters", _META + """
    select p.id, p.title, p.kind from placed p left join meta m on m.conversation_id = p.id
    where """ + " and ".join(
        f"(coalesce(has_{i}, false) or contains(lower(concat_ws(' ', cast(p.id as varchar), p.title, p.kind)), '{w}'))"
        for i, w in enumerate(_TOKENS)) + """ and coalesce(attachments, 0) > 0 and coalesce(local_media, 0) > 0""")
def viewer_filters(t: Tables):
    placed = U.with_placeholders(t.convs, t.msgs)
    return U.viewer_filter(placed, U.viewer_meta(t.msgs, t.files, _TOKENS), _TOKENS, "with-attachments", "local-media")


_TITLES = """first as (select conversation_id, substring(arg_min(trim(regexp_replace(text, '\\s+', ' ', 'g')), seq), 1, 160) as f from {msgs}
        where trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' group by 1),
    named as (select c.id, coalesce(c.title, f.f, '') as t from {convs} c left join first f on f.conversation_id = c.id),
    titled as (select id, case when t = '' then 'Untitled conversation' when length(t) <= 120 then t
        else concat(trim(substring(t, 1, 120)), '...') end as title from named)"""


@query("C17_conversation_title", "with " + _TITLES + " select id, title from titled")
def conversation_title(t: Tables):
    return U.conversation_titles(t.convs, t.msgs).select("id", "title")


@query("H2_first_text", """
    select conversation_id, arg_min(case when length(text) > 180 then concat(substring(text, 1, 177), '...') else text end, seq) as preview
    from {msgs} where text <> '' group by 1""")
def first_text(t: Tables):
    firsts = U.first_texts(t.msgs, 181)
    return firsts.select("conversation_id", S.short_preview(F.col("preview")).alias("preview"))


@query("B4_artifact_path", "with " + _TITLES + """
    select t.id, case when p.id % 6 = 0 then 'conversations/kept-' || cast(t.id as varchar) || '.md'
       else 'conversations/' || cast(t.id as varchar) || '--' || slug || '.md' end as path
    from (select id, case when s = '' then 'untitled-conversation' else s end as slug from
           (select id, regexp_replace(substring(regexp_replace(lower(regexp_replace(strip_accents(title), '[^a-zA-Z0-9]+', '-', 'g')), '^-+|-+$', '', 'g'), 1, 80), '-+$', '') as s from titled)) t
    left join {convs} p on p.id = t.id""")
def artifact_path(t: Tables):
    titled = U.conversation_titles(t.convs, t.msgs)
    previous = F.when(F.col("id") % 6 == 0, F.concat(F.lit("conversations/kept-"), "id", F.lit(".md"))) \
        .when(F.col("id") % 6 == 1, "conversations/../escape.md")
    return titled.select("id", S.artifact_path(F.col("id").cast("string"), F.col("title"), previous, ".md").alias("path"))


_ISO = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"


@query("B3_render_markdown", ROLLUP + """
    select conversation_id, cast(seq as bigint) as seq, sha256(section) as digest from (
      select id as conversation_id, -1 as seq, concat_ws(chr(10), '# ' || title, '', '- Conversation id: ' || cast(id as varchar),
        '- Created: ' || coalesce(""" + _ISO.format("created_ms") + """, 'unknown'), '- Updated: ' || coalesce(""" + _ISO.format("updated_ms") + """, 'unknown'),
        '- Messages: ' || cast(message_count as varchar), '- Media references: ' || cast(media_count as varchar), '') as section from rolled
      union all
      select conversation_id, seq, concat_ws(chr(10), '## ' || upper(substring(role, 1, 1)) || substring(role, 2) || ' - ' || """ + _ISO.format("created_ms") + """,
        chr(10) || 'Model: ' || model, '', coalesce(nullif(text, ''), '_No readable text captured for this message._'), '') from {msgs})""")
def render_markdown(t: Tables):
    sections = U.markdown_sections(rolled(t), t.msgs)
    return sections.select("conversation_id", "seq", F.sha2("section", 256).alias("digest"))


@query("E12_folder_names", """
    select c.id, c.kind, r.r_name as folder_name from {convs} c left join {region} r on r.r_regionkey = c.id % 7""")
def folder_names(t: Tables):
    folders = t.region.select(F.col("r_regionkey").cast("bigint").alias("folder_id"), F.col("r_name").alias("folder_name"))
    return t.convs.select("id", "kind", (F.col("id") % 7).alias("folder_id")).join(folders, "folder_id", "left").drop("folder_id")


@query("J13_conversation_report", """
    select m.conversation_id, m.id, m.seq, m.role, upper(substring(m.role, 1, 1)) || substring(m.role, 2) as role_label,
           coalesce(m.model, '') as model_label, c.title, r.r_name as folder_name,
           sha256(lower(concat_ws(' ', c.title, r.r_name, trim(m.text, ' ')))) as search_digest
    from {msgs} m join {convs} c on c.id = m.conversation_id left join {region} r on r.r_regionkey = c.id % 7""")
def conversation_report(t: Tables):
    folders = t.region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))
    rows = U.report_messages(t.convs.withColumn("folder_id", F.col("id") % 7), t.msgs, folders)
    return rows.withColumn("search_digest", F.sha2("search_text", 256)).drop("search_text")


@query("E8_parent_message", """
    select m.id, p.id as parent_id, p.role as parent_role, cast(length(p.text) as bigint) as parent_length
    from {msgs} m left join {msgs} p on p.conversation_id = m.conversation_id and p.seq = m.seq - 1""")
def parent_message(t: Tables):
    parent = F.when(F.col("seq") > 0, F.concat_ws("-", F.col("conversation_id").cast("string"), (F.col("seq") - 1).cast("string")))
    messages = t.msgs.withColumn("length", F.length("text").cast("bigint"))
    rows = L.with_parent(messages, parent, ["role", "length"])
    return rows.select("id", F.when(F.col("parent_role").isNotNull(), F.col("parent_id")).alias("parent_id"), "parent_role", "parent_length")


@query("E9_context_chain", """
    select l_orderkey as turn_id, l_linenumber as line, o_custkey as session_id,
           coalesce(case when l_linenumber % 3 = 0 then l_returnflag end, case when o_orderkey % 2 = 0 then o_orderstatus end, c_mktsegment) as label
    from {lineitem} left join {orders} on o_orderkey = l_orderkey left join {customer} on c_custkey = o_custkey""")
def context_chain(t: Tables):
    records = t.lineitem.select(
        F.col("l_orderkey").alias("turn_id"), F.col("l_linenumber").alias("line"), F.lit(None).cast("bigint").alias("session_id"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).alias("label"))
    turns = t.orders.select(F.col("o_orderkey").alias("turn_id"), F.col("o_custkey").alias("session_id"),
                            F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("label"))
    sessions = t.customer.select(F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("label"))
    return L.context_chain(records, turns, sessions, ["label"])


@query("E10_resolve_settings", """
    select c_custkey, coalesce(n.n_name, s.s_name, d.n_name) as name,
           case when n.n_name is not null then 'first_owner' when s.s_name is not null then 'second_owner' else 'default' end as matched_by
    from {customer}
    left join {nation} n on n.n_nationkey = c_nationkey + 10
    left join (select n_nationkey as k, n_name as s_name from {nation}) s on s.k = c_nationkey - 20
    left join (select n_name from {nation} where n_nationkey = 7) d on true""")
def resolve_settings(t: Tables):
    settings = t.nation.select(F.col("n_nationkey").alias("owner_id"), (F.col("n_nationkey") == 7).alias("is_default"),
                               F.col("n_nationkey").alias("line_no"), F.col("n_name").alias("name"))
    owners = t.customer.select("c_custkey", (F.col("c_nationkey") + 10).alias("first_owner"), (F.col("c_nationkey") - 20).alias("second_owner"))
    return L.resolve_settings(owners, ["first_owner", "second_owner"], settings, "owner_id").select("c_custkey", "name", "matched_by")


@query("E13_restore_selection", """
    with chosen as (select id from {convs} where kind = 'chat'),
      picked as (select conversation_id, id from {msgs} where conversation_id in (select id from chosen)),
      ids as (select conversation_id, case when seq % 3 = 2 then 'stale-' || id else id end as id from {msgs})
    select 'message' as item, id from picked
    union all
    select 'id', i.id from ids i where i.conversation_id in (select id from chosen) and i.id in (select id from picked)
    union all
    select 'image', cast(media_id as varchar) from {media} where message_id in (select id from picked) or conversation_id in (select id from chosen)""")
def restore_selection(t: Tables):
    chosen = t.convs.where("kind = 'chat'")
    # one saved id in three belongs to no message any more
    ids = t.msgs.select("conversation_id", F.when(F.col("seq") % 3 == 2, F.concat(F.lit("stale-"), "id")).otherwise(F.col("id")).alias("message_id"))
    messages, picked, images = L.restore_selection(chosen, t.msgs, ids, t.media)
    return (
        messages.select(F.lit("message").alias("item"), "id")
        .unionByName(picked.select(F.lit("id").alias("item"), F.col("message_id").alias("id")))
        .unionByName(images.select(F.lit("image").alias("item"), F.col("media_id").cast("string").alias("id")))
    )


_TOTALS = """(select count(*) from {{convs}} where id % {0} <> 0) as conversations, (select count(*) from {{msgs}} where conversation_id % {0} <> 0) as messages,
    (select count(*) from {{media}} where media_id % {0} <> 0) as media"""


@query("F13_sync_delta", "with b as (select " + _TOTALS.format(3) + "), a as (select " + _TOTALS.format(5) + """)
    , d as (select greatest(0, a.conversations - b.conversations) as conversations, greatest(0, a.messages - b.messages) as messages,
        greatest(0, a.media - b.media) as media from a, b)
    select conversations, messages, media, case when conversations + messages + media > 0 then concat('Found and saved ',
       conversations, case when conversations = 1 then ' conversation' else ' conversations' end, ', ',
       messages, case when messages = 1 then ' message' else ' messages' end, ', ', media, ' media.') else 'No new content found.' end as message from d""")
def sync_delta(t: Tables):
    def totals(mod: int):
        media = t.media.where(F.col("media_id") % mod != 0).agg(F.count("*").alias("media"))
        return U.overview(t.convs.where(F.col("id") % mod != 0), t.msgs.where(F.col("conversation_id") % mod != 0), media)
    return U.sync_delta(totals(3), totals(5))


@query("F2_overview", """
    select (select count(*) from {convs}) as conversations, (select count(*) from {msgs}) as messages,
      count_if(available)::bigint as media, count_if(not available)::bigint as unavailable,
      count_if(available and kind = 'image')::bigint as image, count_if(available and kind = 'video')::bigint as video,
      count_if(available and kind = 'audio')::bigint as audio, count_if(available and kind = 'file')::bigint as file
    from {files} where not is_thumbnail""")
def overview(t: Tables):
    return U.overview(t.convs, t.msgs, G.media_overview(t.files))


@query("F6_snapshot_stats", """
    select (select count(*) from {convs}) as conversations, (select count(*) from {msgs}) as messages, count(*) as media,
      count_if(kind = 'image')::bigint as image, count_if(kind = 'video')::bigint as video, count_if(kind = 'audio')::bigint as audio,
      count_if(kind = 'file')::bigint as file, count_if(media_id % 50 = 9)::bigint as orphans,
      (select count(*) from {msgs} where conversation_id not in (select id from {convs})) as messages_missing_conversation
    from {media}""")
def snapshot_stats(t: Tables):
    media = t.media.withColumn("conversation_id", F.when(F.col("media_id") % 50 != 9, F.col("conversation_id")))
    return U.snapshot_stats(t.convs, t.msgs, media)


@query("F12_sampled_size", """
    select source, records, cast(round(avg_size * records) as bigint) as estimated_bytes from
     (select source, count(*) as records, avg(strlen(text)) filter (where rn <= 12) as avg_size from
       (select source, text, row_number() over (partition by source order by doc_id) as rn from {documents}) group by source)""")
def sampled_size(t: Tables):
    return U.sampled_size(t.documents, "source", "doc_id", F.octet_length("text"))


# ---------------------------------------------------------------- set operations

@query("I1_union_stores", """
    select 'legacy' as store, cast(conversation_id as varchar) || ':' || id as id, role, cast(null as varchar) as label from {msgs}
    union all select 'current', cast(o_orderkey as varchar), cast(null as varchar), o_orderstatus from {orders}
    union all select 'support', cast(p_partkey as varchar), 'user', p_type from {part}""")
def union_stores(t: Tables):
    legacy = t.msgs.select(F.lit("legacy").alias("store"), F.concat_ws(":", F.col("conversation_id").cast("string"), "id").alias("id"), "role")
    current = t.orders.select(F.lit("current").alias("store"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("label"))
    support = t.part.select(F.lit("support").alias("store"), F.col("p_partkey").cast("string").alias("id"), F.lit("user").alias("role"), F.col("p_type").alias("label"))
    return legacy.unionByName(current, allowMissingColumns=True).unionByName(support, allowMissingColumns=True)


@query("I2_merge_current", """
    select coalesce(b.id, a.id) as id, coalesce(b.body, a.body) as body, coalesce(b.line_no, a.line_no) as line_no from
      (select case when id % 17 = 0 then 'legacy:' || cast(id as varchar) else cast(id as varchar) end as id, body, id as line_no from {snap_a}) a
      full join (select case when id % 19 = 0 then 'current:' || cast(id as varchar) else cast(id as varchar) end as id, body, id as line_no from {snap_b}) b
      on a.id = b.id""")
def merge_current(t: Tables):
    def side(df, mod):
        return df.select(F.when(F.col("id") % mod != 0, F.col("id").cast("string")).otherwise(" ").alias("id"), "body", F.col("id").alias("line_no"))
    return X.merge_current(side(t.snap_a, 17), side(t.snap_b, 19))


@query("J3_support_threads", """
    with m as (select conversation_id, id, role, text, created from (
        select 'support:' || cast(p_partkey % 300 as varchar) as conversation_id, 'support:' || cast(p_partkey as varchar) || ':question' as id, 'user' as role, p_name as text, p_partkey as created from {part} where p_partkey % 9 <> 0
        union all select 'support:' || cast(p_partkey % 300 as varchar), 'support:' || cast(p_partkey as varchar) || ':answer', 'assistant', p_type, p_partkey from {part} where p_partkey % 9 <> 0
        union all select 'support:' || cast(p_partkey % 300 as varchar), 'support:' || cast(p_partkey as varchar), 'assistant', p_brand, p_partkey from {part} where p_partkey % 9 = 0)),
      first as (select conversation_id, arg_min(substring(text, 1, 200), concat(lpad(cast(created as varchar), 12, '0'), id)) as t, min(created) as a, max(created) as b from m group by 1),
      known as (select distinct 'support:' || cast(p_partkey % 300 as varchar) as id, case when p_partkey % 300 % 2 = 0 then 'Thread' end as name from {part} where p_partkey % 300 < 200)
    select coalesce(k.id, f.conversation_id) as id, coalesce(k.name, f.t, 'Untitled conversation') as title, f.a as created, f.b as updated, k.id is null as orphan, 'support' as kind
    from known k full join first f on f.conversation_id = k.id""")
def support_threads(t: Tables):
    plain = F.col("p_partkey") % 9 == 0
    records = t.part.select(
        F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 300).cast("string").alias("thread_id"),
        F.when(~plain, F.col("p_name")).alias("question"), F.when(~plain, F.col("p_type")).alias("answer"),
        F.col("p_brand").alias("content"), F.lit(None).cast("string").alias("role"), F.col("p_partkey").alias("created"))
    none = F.lit(None).cast("bigint")
    threads = t.part.select((F.col("p_partkey") % 300).alias("n")).distinct().where("n < 200").select(
        F.col("n").cast("string").alias("id"), F.when(F.col("n") % 2 == 0, "Thread").alias("name"), none.alias("created"), none.alias("updated"))
    return N.support_threads(threads, N.support_messages(records))


@query("J3_support_messages", """
    select 'support:' || cast(p_partkey % 300 as varchar) as conversation_id, 'support:' || cast(p_partkey as varchar) || ':question' as id, 'user' as role, p_name as text from {part} where p_partkey % 9 <> 0
    union all select 'support:' || cast(p_partkey % 300 as varchar), 'support:' || cast(p_partkey as varchar) || ':answer', 'assistant', p_type from {part} where p_partkey % 9 <> 0
    union all select 'support:' || cast(p_partkey % 300 as varchar), 'support:' || cast(p_partkey as varchar), 'user', p_brand from {part} where p_partkey % 9 = 0""")
def support_messages(t: Tables):
    plain = F.col("p_partkey") % 9 == 0
    records = t.part.select(
        F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 300).cast("string").alias("thread_id"),
        F.when(~plain, F.col("p_name")).alias("question"), F.when(~plain, F.col("p_type")).alias("answer"),
        F.col("p_brand").alias("content"), F.lit("Human").alias("role"), F.col("p_partkey").alias("created"))
    return N.support_messages(records).drop("created")


@query("H1_catalog", """
    with named as (select id, coalesce(case when id % 2 = 0 then title end, 'Old ' || cast(id as varchar)) as title from {convs})
    select m.conversation_id as id, coalesce(any_value(n.title), 'Recovered conversation') as title, count(*) as message_count,
       arg_min(substring(m.text, 1, 260), m.seq) filter (where m.text <> '') as preview, max(m.created_ms) as updated_ms
    from (select cast(conversation_id as varchar) as conversation_id, conversation_id as c, seq, text, created_ms from {msgs}) m left join named n on n.id = m.c group by 1""")
def catalog(t: Tables):
    """A capture with every second conversation over a recovery layer with all of them."""
    from threadlake.operators.catalog import build_catalog
    layer = lambda df, name, rank, line: df.withColumns({"layer": F.lit(name), "source_rank": F.lit(rank), "line_no": F.col(line)})
    none = lambda kind: F.lit(None).cast(kind)
    convs = t.convs.select(F.col("id").cast("string").alias("id"), F.col("id").alias("n"), "title", none("string").alias("preview"), "kind",
                           none("bigint").alias("created_ms"), none("bigint").alias("updated_ms"))
    conversations = layer(convs.where("n % 2 = 0"), "capture", 0, "n").unionByName(
        layer(convs.withColumn("title", F.concat(F.lit("Old "), "id")), "recovery", 1, "n")).drop("n")
    said = t.msgs.select(F.col("conversation_id").cast("string").alias("conversation_id"), "id", "role", "model", "text", "created_ms", "seq",
                         F.col("conversation_id").alias("n"))
    messages = layer(said.where("n % 2 = 0"), "capture", 0, "seq").unionByName(
        layer(said.withColumn("text", F.when(F.col("n") % 2 == 0, "stale").otherwise(F.col("text"))), "recovery", 1, "seq")).drop("seq", "n")
    media = layer(t.files.withColumn("line", F.col("media_id")), "capture", 0, "line").select(
        "layer", "source_rank", "line_no", F.col("media_id").cast("string").alias("stable_id"), F.col("media_id").cast("string").alias("local_id"),
        F.lit("capture").alias("source_name"), "available", F.col("conversation_id").cast("string").alias("conversation_id"), "message_id", "kind", "file_name",
        "prompt", none("string").alias("model"), "disposition", "source", "created_ms", F.when(F.col("available"), F.col("sha")).alias("path"), "sha", "bytes",
        "mime_type", "status", "archive_source", none("string").alias("original_path"), "format_corrected")
    built = build_catalog(conversations, messages, media)
    return built.conversations.where("message_count > 0").select("id", "title", "message_count", "preview", "updated_ms")
