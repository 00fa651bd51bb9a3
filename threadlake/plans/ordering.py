"""Queries for sorts, pages, windows over message order, merges and set operations."""

from pyspark.sql import functions as F

from threadlake.functions import predicates as P
from threadlake.operators import gallery as G
from threadlake.operators import merge as X
from threadlake.operators import ordered as O
from threadlake.operators import overlay as V
from threadlake.operators import paging as B
from threadlake.operators import sets as Z
from threadlake.plans.conversations import ROLLUP, rolled
from threadlake.plans.registry import Tables, query

_LISTED = """files_m as (select f.*, case when f.media_id % 6 <> 2 then concat('model-', cast(f.media_id % 4 as varchar)) end as model from {files} f)"""
_NATURAL = r"""array_to_string(list_transform(regexp_extract_all(lower(coalesce(file_name, '')), '[0-9]+|[^0-9]+'),
    lambda p: case when p[1] between '0' and '9' then lpad(cast(length(ltrim(p, '0')) as varchar), 10, '0') || ltrim(p, '0') else p end), '')"""


def listed(t: Tables):
    return t.files.withColumn("model", F.when(F.col("media_id") % 6 != 2, F.concat(F.lit("model-"), F.col("media_id") % 4)))


for _sort, _order in (
    ("recent", "coalesce(created_ms, -1) desc, media_id"), ("oldest", "coalesce(created_ms, -1), media_id"),
    ("model", "lower(coalesce(model, '￿')), coalesce(created_ms, -1) desc, media_id"),
    ("name", _NATURAL + ", coalesce(created_ms, -1) desc, media_id"), ("largest", "coalesce(bytes, 0) desc, media_id"),
):
    query(f"G2_media_by_{_sort}", "with " + _LISTED + f" select media_id, file_name, model, bytes, created_ms from files_m order by {_order} limit 40")(
        lambda t, sort=_sort: listed(t).orderBy(*G.listing_order(sort)).limit(40).select("media_id", "file_name", "model", "bytes", "created_ms"))


@query("G2_media_by_session", ROLLUP + """
    , ranked as (select id, row_number() over (order by coalesce(updated_ms, -1) desc, id) as rank from rolled where kind <> 'recovered')
    select media_id, conversation_id, conversation_rank from (
      select f.media_id, f.conversation_id, cast(r.rank as bigint) as conversation_rank, f.created_ms from {files} f left join ranked r on r.id = f.conversation_id)
    order by conversation_rank nulls last, cast(conversation_id as varchar), coalesce(created_ms, -1), media_id limit 40""")
def media_by_session(t: Tables):
    from threadlake.operators.digests import global_rank
    order = global_rank(rolled(t).where("kind <> 'recovered'").select("id", "updated_ms"),
                        [F.coalesce("updated_ms", F.lit(-1)).desc(), F.col("id").asc()], "conversation_rank")
    rows = t.files.join(order.select(F.col("id").alias("conversation_id"), "conversation_rank"), "conversation_id", "left")
    return rows.orderBy(*G.listing_order("session")).limit(40).select("media_id", "conversation_id", "conversation_rank")


@query("G4_row_pages", """
    select source, page, count(*) as rows, cast(sum(bytes) as bigint) as bytes, min(doc_id) as first, max(doc_id) as last from
      (select source, doc_id, strlen(text) as bytes, (row_number() over (partition by source order by doc_id) - 1) // 100 as page from {documents})
    group by 1, 2""")
def row_pages(t: Tables):
    records = t.documents.select("source", "doc_id", F.octet_length("text").cast("bigint").alias("bytes"))
    placed = O.position(records, ["source"], "doc_id", "pos")
    return B.page_summary(placed.withColumn("page", F.floor(F.col("pos") / 100).cast("bigint")), "source", "doc_id", "bytes")


@query("G4_byte_pages", """
    with recursive n as (select source, doc_id, strlen(text) as bytes, row_number() over (partition by source order by doc_id) as rn from {documents}),
      walk as (
        select source, doc_id, rn, 0 as page, 1 as held, bytes as total from n where rn = 1
        union all
        select n.source, n.doc_id, n.rn,
          case when w.held >= 20 or w.total + n.bytes > 9000 then w.page + 1 else w.page end,
          case when w.held >= 20 or w.total + n.bytes > 9000 then 1 else w.held + 1 end,
          case when w.held >= 20 or w.total + n.bytes > 9000 then n.bytes else w.total + n.bytes end
        from walk w join n on n.source = w.source and n.rn = w.rn + 1)
    select source, cast(page as bigint) as page, count(*) as rows, cast(max(total) as bigint) as bytes, min(doc_id) as first, max(doc_id) as last
    from walk group by 1, 2""")
def byte_pages(t: Tables):
    records = t.documents.select("source", "doc_id", F.octet_length("text").cast("bigint").alias("bytes"))
    return B.page_summary(B.pages(records, "source", "doc_id", "bytes", 20, 9000), "source", "doc_id", "bytes")


@query("G5_bounded_batch", """
    with recursive n as (select doc_id, strlen(text) as bytes, row_number() over (order by doc_id) as rn from {documents}),
      walk as (
        select doc_id, rn, bytes, case when bytes <= 60000 then 1 else 0 end as taken, case when bytes <= 60000 then 1 else 0 end as held,
               case when bytes <= 60000 then bytes else 0 end as total from n where rn = 1
        union all
        select n.doc_id, n.rn, n.bytes, case when w.held < 128 and w.total + n.bytes <= 60000 then 1 else 0 end,
          w.held + case when w.held < 128 and w.total + n.bytes <= 60000 then 1 else 0 end,
          w.total + case when w.held < 128 and w.total + n.bytes <= 60000 then n.bytes else 0 end
        from walk w join n on n.rn = w.rn + 1)
    select doc_id, cast(bytes as bigint) as bytes, taken = 1 as selected from walk""")
def bounded_batch(t: Tables):
    items = t.documents.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"))
    return B.bounded_batch(items, "doc_id", "bytes", 128, 60000)


@query("G6_conversation_media", """
    select f.conversation_id, f.media_id, s.seq as message_position,
       case coalesce(f.disposition, case when s.role = 'user' then 'input' else 'media' end) when 'input' then 0 when 'output' then 1 else 2 end as disposition_rank,
       f.created_ms
    from {files} f left join (select conversation_id, id, row_number() over (partition by conversation_id order by seq) - 1 as seq, role from {msgs}) s
      on s.conversation_id = f.conversation_id and s.id = f.message_id""")
def conversation_media(t: Tables):
    placed = O.position(t.msgs.select("conversation_id", "id", "seq", "role"), ["conversation_id"], "seq", "message_position")
    order = placed.select("conversation_id", F.col("id").alias("message_id"), "message_position", "role")
    rows = t.files.join(order, ["conversation_id", "message_id"], "left")
    shown = F.coalesce("disposition", F.when(F.col("role") == "user", "input").otherwise("media"))
    return rows.select("conversation_id", "media_id", "message_position", G.disposition_rank(shown).alias("disposition_rank"), "created_ms").orderBy(
        "conversation_id", F.col("message_position").asc_nulls_last(), "disposition_rank", F.coalesce("created_ms", F.lit(-1)), "media_id")


# ---------------------------------------------------------------- order of messages

LAYERS = """layers as (
    select 0 as source_rank, o_orderkey as line_no, o_orderkey as id, case when o_orderkey % 4 = 0 then '' else o_orderstatus end as status,
           case when o_orderkey % 6 = 0 then o_totalprice end as price, o_orderkey % 5 = 0 as available, cast(null as varchar) as path from {orders} where o_orderkey % 3 = 0
    union all
    select 1, o_orderkey, o_orderkey, case when o_orderkey % 10 = 0 then null else o_orderpriority end, 0.0, o_orderkey % 7 = 0,
           concat('one/', cast(o_orderkey as varchar)) from {orders} where o_orderkey % 2 = 0
    union all
    select 2, o_orderkey, o_orderkey, 'late', o_totalprice, o_orderkey % 11 = 0, concat('two/', cast(o_orderkey as varchar)) from {orders} where o_orderkey % 5 <> 1)"""


def layers(t: Tables):
    key = F.col("o_orderkey")
    none = F.lit(None).cast("string")

    def layer(rank, keep, status, price, available, path):
        return t.orders.where(keep).select(
            F.lit(rank).alias("source_rank"), key.alias("line_no"), key.alias("id"), status.alias("status"),
            price.alias("price"), available.alias("available"), path.alias("path"))

    return (
        layer(0, key % 3 == 0, F.when(key % 4 == 0, "").otherwise(F.col("o_orderstatus")), F.when(key % 6 == 0, F.col("o_totalprice")), key % 5 == 0, none)
        .unionByName(layer(1, key % 2 == 0, F.when(key % 10 != 0, F.col("o_orderpriority")), F.lit(0.0), key % 7 == 0, F.concat(F.lit("one/"), key.cast("string"))))
        .unionByName(layer(2, key % 5 != 1, F.lit("late"), F.col("o_totalprice"), key % 11 == 0, F.concat(F.lit("two/"), key.cast("string")))))


@query("H1_prefer_first", "with " + LAYERS + """
    select id, arg_min(status, source_rank) filter (where status <> '') as status, arg_min(price, source_rank) filter (where price is not null) as price
    from layers group by id""")
def prefer_first(t: Tables):
    return X.prefer_first(layers(t), ["id"], ["source_rank", "line_no"], ["status", "price"])


@query("H1_prefer_first_media", "with " + LAYERS + """
    select id, arg_min(price, source_rank) filter (where price is not null) as price, bool_or(available) as available,
       coalesce(arg_min(path, source_rank) filter (where available and source_rank = first_rank), arg_min(path, source_rank) filter (where path <> '')) as path
    from (select *, min(source_rank) filter (where available) over (partition by id) as first_rank from layers) group by id""")
def prefer_first_media(t: Tables):
    return X.prefer_first_media(layers(t), ["id"], ["source_rank", "line_no"], ["price", "path"], ["path"])


@query("H3_latest_message", """
    select conversation_id, id, role, created_ms from (select *, row_number() over (partition by conversation_id order by created_ms // 180000 desc, seq desc) as rn from {msgs}) where rn = 1""")
def latest_message(t: Tables):
    rows = t.msgs.withColumn("at", F.floor(F.col("created_ms") / 180000))
    return O.last_of_group(rows, ["conversation_id"], ["at", "seq"], ["id", "role", "created_ms"])


@query("H4_preceding_user", """
    select conversation_id, id, last_value(case when role = 'user' then id end ignore nulls) over
       (partition by conversation_id order by seq rows between unbounded preceding and 1 preceding) as user_id from {msgs}""")
def preceding_user(t: Tables):
    rows = O.last_before(t.msgs.select("conversation_id", "id", "seq", "role"), ["conversation_id"], "seq", ["id"], "u", F.col("role") == "user")
    return rows.select("conversation_id", "id", F.col("u.id").alias("user_id"))


@query("H5_prompt_navigator", """
    select conversation_id, id, position, prompt_number, lag(id) over w as previous_prompt, lead(id) over w as next_prompt from (
      select *, row_number() over (partition by conversation_id order by seq) as prompt_number from
        (select conversation_id, id, seq, role, row_number() over (partition by conversation_id order by seq) - 1 as position from {msgs}) where role = 'user')
    window w as (partition by conversation_id order by seq)""")
def prompt_navigator(t: Tables):
    key = ["conversation_id"]
    placed = O.position(t.msgs.select("conversation_id", "id", "seq", "role"), key, "seq", "position")
    prompts = O.position(placed.where("role = 'user'"), key, "position", "before")
    linked = O.next_after(O.last_before(prompts, key, "before", ["id"], "p"), key, "before", ["id"], "n")
    return linked.select("conversation_id", "id", "position", (F.col("before") + 1).alias("prompt_number"),
                         F.col("p.id").alias("previous_prompt"), F.col("n.id").alias("next_prompt"))


@query("H6_keep_first", """
    select href, page_id, cast(pos as bigint) as pos from (select *, row_number() over (partition by href order by page_id, pos) as rn from {refs}) where rn = 1""")
def keep_first(t: Tables):
    return X.keep_first(t.refs.withColumn("pos", F.col("pos").cast("bigint")), ["href"], ["page_id", "pos"])


@query("H7_best_copy", """
    select sha, media_id, score from (select *, row_number() over (partition by sha order by score desc, media_id) as rn from
      (select sha, media_id, cast(case when format_corrected then 0 else 4 end + case when status = 'materialized' then 2 else 0 end
           + case when archive_source like 'recovered%' then 1 else 0 end as bigint) as score from {files} where available)) where rn = 1""")
def best_copy(t: Tables):
    score = (F.when(F.col("format_corrected"), 0).otherwise(4) + F.when(F.col("status") == "materialized", 2).otherwise(0)
             + F.when(F.col("archive_source").startswith("recovered"), 1).otherwise(0)).cast("bigint")
    rows = t.files.where("available").withColumn("score", score).withColumn("worse", -F.col("score"))
    return O.first_of_group(rows, ["sha"], ["worse", "media_id"], ["media_id", "score"])


_GENERATIONS = """gens as (select distinct cast(year(o_orderdate) as varchar) as gen_id, cast(year(o_orderdate) - 1 as varchar) as base_gen_id from {orders}),
    entries as (select cast(year(o_orderdate) as varchar) as gen_id, concat('media/', cast(o_custkey as varchar)) as path, max(o_orderkey) as sha, count(*) as bytes from {orders} group by 1, 2)"""


def generations(t: Tables):
    year = F.year("o_orderdate")
    gens = t.orders.select(year.cast("string").alias("gen_id"), (year - 1).cast("string").alias("base_gen_id")).distinct()
    entries = t.orders.groupBy(year.cast("string").alias("gen_id"), F.concat(F.lit("media/"), F.col("o_custkey").cast("string")).alias("path")).agg(
        F.max("o_orderkey").alias("sha"), F.count("*").alias("bytes"))
    return gens, entries


@query("H8_generation_overlay", "with recursive " + _GENERATIONS + """,
    chain(gen_id, base_gen_id, depth) as (select gen_id, base_gen_id, 0 from gens where gen_id = '1997'
       union all select g.gen_id, g.base_gen_id, c.depth + 1 from chain c join gens g on g.gen_id = c.base_gen_id)
    select path, gen_id, sha, bytes, depth from (select e.path, c.gen_id, e.sha, e.bytes, c.depth, row_number() over (partition by e.path order by c.depth) as rn
       from entries e join chain c on c.gen_id = e.gen_id) where rn = 1""")
def generation_overlay(t: Tables):
    gens, entries = generations(t)
    return V.overlay(entries, V.generation_chain(gens, "1997"))


@query("L12_tree_selection", "with " + _GENERATIONS + """
    select path, gen_id, sha, bytes from entries where starts_with(path, 'media/12')""")
def tree_selection(t: Tables):
    return V.select_tree(generations(t)[1], "media/12").select("path", "gen_id", "sha", "bytes")


@query("L12_restore_plan", "with " + _GENERATIONS + """
    select path, sha, bytes, case when sha % 5 <> 1 then 'objects/' || cast(sha as varchar) end as object_path,
       case when sha % 5 = 1 then 'missing object' when sha % 5 = 2 then 'wrong size' else 'ready' end as status from entries where starts_with(path, 'media/1')""")
def restore_plan(t: Tables):
    entries = generations(t)[1]
    sizes = entries.groupBy("sha").agg(F.max("bytes").alias("n"))
    objects = sizes.where("sha % 5 <> 1").select(
        "sha", F.concat(F.lit("objects/"), "sha").alias("object_path"), (F.col("n") + F.when(F.col("sha") % 5 == 2, 1).otherwise(0)).alias("object_bytes"))
    return V.restore_plan(entries, objects, "media/1")


@query("H9_snapshot_retention", """
    with s as (select distinct strftime(ts, '%Y%m%d') as snapshot_id from {events}),
      f as (select snapshot_id, cast(snapshot_id as int) % 3 <> 0 as verified, cast(snapshot_id as int) % 7 <> 1 as managed from s)
    select snapshot_id, verified, managed, case when not (verified and managed) then 'untouched'
       when row_number() over (partition by verified and managed order by snapshot_id desc) <= 2 then 'keep' else 'prune' end as action from f""")
def snapshot_retention(t: Tables):
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")
    snapshots = t.events.select(day.alias("snapshot_id")).distinct().select(
        "snapshot_id", (F.col("snapshot_id").cast("int") % 3 != 0).alias("verified"), (F.col("snapshot_id").cast("int") % 7 != 1).alias("managed"))
    return V.retention_plan(snapshots, 2)


# ---------------------------------------------------------------- sets

@query("I3_multiset_equality", """
    with d as (select coalesce(a.parent_id, b.parent_id) as k, coalesce(a.n, 0) - coalesce(b.n, 0) as d from
      (select parent_id, body, count(*) as n from {snap_a} group by 1, 2) a full join (select parent_id, body, count(*) as n from {snap_b} group by 1, 2) b
      on a.parent_id = b.parent_id and a.body = b.body)
    select count_if(d <> 0) = 0 as equal, cast(sum(greatest(d, 0)) as bigint) as left_only, cast(sum(greatest(-d, 0)) as bigint) as right_only from d""")
def multiset_equality(t: Tables):
    return Z.multiset_equal(t.snap_a, t.snap_b, ["parent_id", "body"])


@query("I4_key_changes", """
    select id, 'added' as change from (select id from {snap_b} except select id from {snap_a})
    union all select id, 'removed' from (select id from {snap_a} except select id from {snap_b})
    union all select id, 'kept' from (select id from {snap_a} intersect select id from {snap_b})""")
def key_changes(t: Tables):
    return Z.key_changes(t.snap_a, t.snap_b, "id")


@query("I5_distinct_hashes", "select distinct sha from {payloads} order by sha")
def distinct_hashes(t: Tables):
    return t.payloads.select("sha").distinct().orderBy("sha")


_STORES = """select event_id, case event_id % 9 when 0 then 'conversations' when 1 then 'rxMessages' when 2 then 'studioVideoTurns' when 3 then 'studioAudioSessions'
    when 4 then 'messageImages' when 5 then 'idb:messages' when 6 then 'rxdb-physical:x' when 7 then 'supportBotThreads' else concat('settings-', event_type) end as store from {events}"""


@query("I6_store_routing", "with s as (" + _STORES + """)
    select store, case when store in ('conversations', 'supportBotThreads') then 'conversation' when store = 'rxMessages' then 'message'
       when store = 'studioVideoTurns' then 'studio_turn' when store = 'studioAudioSessions' then 'studio_session' when store = 'messageImages' then 'media' else 'lossless' end as target,
       count(*) as records from s group by 1, 2""")
def store_routing(t: Tables):
    stores = t.sql(_STORES).groupBy("store").agg(F.count("*").alias("records"))
    return stores.select("store", P.store_target(F.col("store")).alias("target"), "records")


@query("I7_drop_recovered", """
    with rows as (select case when seq % 4 = 3 then 'recovered' else cast(conversation_id as varchar) end as conversation_id, 'm' || cast(seq as varchar) as id, text
                  from {msgs} where seq % 4 <> 3 or conversation_id < 20)
    select conversation_id, id, count(*) as copies from rows where conversation_id <> 'recovered'
       or id not in (select id from rows where conversation_id <> 'recovered') group by 1, 2""")
def drop_recovered(t: Tables):
    rows = t.msgs.where("seq % 4 <> 3 or conversation_id < 20").select(
        F.when(F.col("seq") % 4 == 3, "recovered").otherwise(F.col("conversation_id").cast("string")).alias("conversation_id"),
        F.concat(F.lit("m"), "seq").alias("id"), "text")
    return X.drop_superseded_recovered(rows).groupBy("conversation_id", "id").agg(F.count("*").alias("copies"))
