"""Queries for content addressing, digests, duplicates and recovery."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadlake.functions import records as R
from threadlake.operators import content as C
from threadlake.operators import digests as H
from threadlake.operators import materialize as L
from threadlake.operators import merge as X
from threadlake.operators import recovery as Y
from threadlake.operators import verify as V
from threadlake.plans.registry import Tables, query
from threadlake.session import materialize, workspace


@query("B2_write_objects", """
    select doc_id, sha, case when rn = 1 and doc_id % 2 = 0 then 'materialized' when rn = 1 and not seen then 'materialized' else 'deduped' end as status, pooled from (
      select doc_id, sha, row_number() over (partition by sha, doc_id % 2 order by doc_id) as rn,
        bool_or(doc_id % 2 = 0) over (partition by sha) as seen, (select count(distinct sha) from {payloads}) as pooled from {payloads})""")
def write_objects(t: Tables):
    """Two runs into one pool: even documents first, then odd ones."""
    from threadlake.sources.sinks import write_objects as sink
    pool_path = workspace(t.spark, "objects")
    items = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("content"))
    first = sink(items.where("doc_id % 2 = 0"), pool_path, None, ["doc_id"], "doc_id", shard_digits=1)
    # the pool as it stands before the second run, kept apart from the folder the run appends to
    pool = materialize(t.spark.read.parquet(pool_path).select("sha"), "pool")
    second = sink(items.where("doc_id % 2 = 1"), pool_path, pool, ["doc_id"], "doc_id", shard_digits=1)
    pooled = t.spark.read.parquet(pool_path).agg(F.count("*")).scalar()
    return first.unionByName(second).select("doc_id", "sha", "status", pooled.alias("pooled"))


_DIGEST = """l0 as (select {store} as store, row_number() over (partition by {store} order by {ordinal}) - 1 as n, sha256({record}) as d from {table}),
    l1 as (select store, n // 4096 as n, sha256(string_agg(d, '' order by n)) as d from l0 group by 1, 2),
    l2 as (select store, n // 4096 as n, sha256(string_agg(d, '' order by n)) as d from l1 group by 1, 2),
    l3 as (select store, n // 4096 as n, sha256(string_agg(d, '' order by n)) as d from l2 group by 1, 2),
    l4 as (select store, sha256(string_agg(d, '' order by n)) as digest from l3 group by 1)"""


def _digest(store: str, ordinal: str, record: str, table: str) -> str:
    text = _DIGEST
    for name, value in (("{store}", store), ("{ordinal}", ordinal), ("{record}", record), ("{table}", "{" + table + "}")):
        text = text.replace(name, value)
    return text


@query("F10_store_inventory", "with " + _digest("event_type", "event_id", "props || cast(event_id as varchar)", "events") + """
    select e.event_type, count(*) as records, cast(sum(strlen(props || cast(event_id as varchar))) as bigint) as bytes, any_value(digest) as fingerprint
    from {events} e join l4 on l4.store = e.event_type group by 1""")
def store_inventory(t: Tables):
    return H.store_inventory(t.events, "event_type", "event_id", F.concat("props", F.col("event_id").cast("string")))


@query("F11_conversation_hash", "with " + _digest("conversation_id", "seq", "concat_ws('|', id, role, coalesce(model, ''), text)", "msgs") + """
    select store as conversation_id, digest as record_hash from l4""")
def conversation_hash(t: Tables):
    record = F.concat_ws("|", "id", "role", F.coalesce("model", F.lit("")), "text")
    return H.ordered_digest(t.msgs.withColumn("sha", F.sha2(record, 256)), ["conversation_id"], "seq", "sha", "record_hash")


@query("F11_hash_ignores_gaps", """
    select conversation_id, count(*) < 2 as swapped_same, true as gaps_same, false as edited_same from {msgs} group by 1""")
def hash_ignores_gaps(t: Tables):
    """The same records under other ordinals give the same digest, swapped or edited ones another."""
    rows = t.msgs.select("conversation_id", "seq", F.sha2(F.concat_ws("|", "id", "text"), 256).alias("sha"))
    digest = lambda df, name: H.ordered_digest(df, ["conversation_id"], "seq", "sha", name)
    plain = digest(rows, "plain")
    for name, df in (
        ("gaps_same", rows.withColumn("seq", F.col("seq") * 5000 + 7)), ("swapped_same", rows.withColumn("seq", -F.col("seq"))),
        ("edited_same", rows.withColumn("sha", F.when(F.col("seq") == 0, F.sha2("sha", 256)).otherwise(F.col("sha")))),
    ):
        plain = plain.join(digest(df, "_other"), "conversation_id").withColumn(name, F.col("plain") == F.col("_other")).drop("_other")
    return plain.drop("plain")


@query("F11_canonical_hash", """
    select event_id, sha256('{{"k":' || json_extract_string(props, '$.k') || '}}') as record_hash from {events}""")
def canonical_hash(t: Tables):
    return t.events.select("event_id", F.sha2(R.canonical_json(R.parse("props")), 256).alias("record_hash"))


@query("F15_store_manifest", "with " + _digest("source", "doc_id", "text", "documents") + """,
    per as (select source as store, count(*) as records, cast(sum(strlen(text)) as bigint) as bytes, any_value(digest) as sha256 from {documents} join l4 on l4.store = source group by 1)
    select *, case when store <> 'src7' then records + case when store like '%3' then 1 else 0 end end as expected_records,
       store <> 'src7' and store not like '%3' as complete, store like '%5' as encrypted,
       (select sha256(string_agg(store || ':' || sha256, chr(10) order by store)) from per) as export_sha256 from per""")
def store_manifest(t: Tables):
    """Stores that end with 3 lack a record, one was not expected at all."""
    name = F.col("source")
    expected = t.documents.where(name != "src7").groupBy(name.alias("store")).agg(F.count("*").alias("n")).select(
        "store", (F.col("n") + F.col("store").endswith("3").cast("int")).alias("expected_records"), F.col("store").endswith("5").alias("encrypted"))
    return H.store_manifest(t.documents, "source", "doc_id", F.col("text"), expected)


@query("F10_unordered_digest", "select source, count(*) as records from {documents} group by 1")
def unordered_digest(t: Tables):
    """The digest of a set is the same in any order: compare it with a reversed copy."""
    rows = t.documents.select("source", "doc_id", "text")
    straight = H.unordered_digest(rows, ["source"], F.col("text"))
    shuffled = H.unordered_digest(rows.repartition(5, "doc_id"), ["source"], F.col("text")).withColumnRenamed("digest", "other")
    counts = rows.groupBy("source").agg(F.count("*").alias("records"))
    return counts.join(straight.join(shuffled, "source").where("digest = other"), "source").select("source", "records")


_SUMMARY = """count(*) as distinct_contents, cast(sum(copies) as bigint) as files, cast(sum(copies * bytes) as bigint) as logical_bytes, cast(sum(bytes) as bigint) as unique_bytes,
    cast(sum((copies - 1) * bytes) as bigint) as repeated_bytes, cast(count_if(copies > 1) as bigint) as duplicate_groups,
    cast(coalesce(sum(case when bytes = 0 then copies - 1 end), 0) as bigint) as duplicate_empty_files, cast(count_if(held) as bigint) as already_in_pool,
    cast(coalesce(sum(case when not held then bytes end), 0) as bigint) as additional_bytes"""
_POOL = "pool as (select distinct sha from {payloads} where doc_id % 3 = 0)"


def pool(t: Tables):
    return t.payloads.where("doc_id % 3 = 0").select("sha")


@query("F8_duplicate_summary", "with " + _POOL + ", h as (select sha, count(*) as copies, min(bytes) as bytes, sha in (select sha from pool) as held from {payloads} group by 1) select " + _SUMMARY + " from h")
def duplicate_summary(t: Tables):
    return C.duplicate_summary(t.payloads, pool(t))


@query("F8_duplicates_by_layer", "with " + _POOL + ", h as (select layer, sha, count(*) as copies, min(bytes) as bytes, sha in (select sha from pool) as held from {payloads} group by 1, 2) select layer, " + _SUMMARY + " from h group by 1")
def duplicates_by_layer(t: Tables):
    return C.duplicate_summary(t.payloads, pool(t), ["layer"])


@query("F9_duplicate_groups", """
    select sha, count(*) as copies, min(bytes) as bytes, count(distinct layer) as layers, count(distinct category) as categories, cast((count(*) - 1) * min(bytes) as bigint) as repeated_bytes
    from {payloads} group by 1 having count(*) > 1""")
def duplicate_groups(t: Tables):
    return C.duplicate_groups(t.payloads)


@query("F9_duplicate_members", """
    select sha, layer, category, count(*) as copies from {payloads} where sha in (select sha from {payloads} group by 1 having count(*) > 1) group by 1, 2, 3""")
def duplicate_members(t: Tables):
    return C.duplicate_members(t.payloads)


@query("L9_duplicate_audit", "with " + _POOL + """,
    f as (select 'p' || cast(doc_id as varchar) as path, sha from {payloads} where doc_id % 5 <> 0)
    select 'checksum mismatch' as finding, path, false as resolvable from f where cast(substring(path, 2) as bigint) % 50 = 1
    union all
    select 'missing reference', 'p' || cast(doc_id as varchar), sha in (select sha from f) or sha in (select sha from pool) from {payloads} where doc_id % 5 = 0 and doc_id % 2 = 0""")
def duplicate_audit(t: Tables):
    path = F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path")
    files = t.payloads.where("doc_id % 5 <> 0").select(path, "sha", "bytes", "layer", "category")
    declared = t.payloads.select(path, F.when(F.col("doc_id") % 50 == 1, "wrong").otherwise(F.col("sha")).alias("sha"))
    references = t.payloads.where("doc_id % 2 = 0").select(path, "sha")
    return V.duplicate_audit(files, pool(t), declared, references)


@F.pandas_udf(StringType())
def _listed(text: pd.Series) -> pd.Series:
    """UTF-8 bytes of a text as a JSON array of numbers."""
    return text.map(lambda t: None if t is None else f"[{','.join(map(str, t.encode()))}]")


@F.pandas_udf(StringType())
def _keyed(text: pd.Series) -> pd.Series:
    """UTF-8 bytes of a text as a JSON object with numeric keys."""
    return text.map(lambda t: None if t is None else "{" + ",".join(f'"{i}":{n}' for i, n in enumerate(t.encode())) + "}")


@query("L1_decode_payloads", """
    select doc_id, case when doc_id % 5 = 4 then sha256(substring(sha256(text), 3, 5)) else sha256(text) end as sha from {documents}""")
def decode_payloads(t: Tables):
    """Whole texts in every encoding a store uses: base64, data URL, number list, numeric keys; and a view of a hash."""
    encoded = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s+", "")  # one line, as JSON needs it
    kind = F.col("doc_id") % 5
    quoted = lambda head, text: F.concat(F.lit(f'"{head}'), text, F.lit('"'))
    payload = F.when(kind == 0, quoted("", encoded)).when(kind == 1, quoted("data:image/png;base64,", encoded)) \
        .when(kind == 2, _listed(F.when(kind == 2, F.col("text")))).when(kind == 3, _keyed(F.when(kind == 3, F.col("text")))) \
        .otherwise(F.concat(F.lit('{"encoded":"'), F.regexp_replace(F.base64(F.sha2("text", 256).cast("binary")), r"\s+", ""), F.lit('","byteOffset":2,"length":5}')))
    rows = t.documents.select("doc_id", R.parse(payload).alias("payload"))
    return rows.select("doc_id", F.sha2(C.decode_payload(F.col("payload")), 256).alias("sha"))


_HEADS = (
    ("89504E470D0A1A0A0000000D494844520000012C000000C8", ".png", "image/png", "image", 300, 200),
    ("FFD8FFE000104A46494600010100000100010000FFC0000B080002000301011100FFD90000000000", ".jpg", "image/jpeg", "image", 3, 2),
    ("4749463839610A001400", ".gif", "image/gif", "image", 10, 20),
    ("52494646000000005745425056503858000000000000000009000004000000000000", ".webp", "image/webp", "image", 10, 5),
    ("000000186674797069736F6D0000000069736F6D", ".mp4", "video/mp4", "video", None, None),
    ("255044462D312E37", ".pdf", "application/pdf", "file", None, None),
    ("4F67675300", ".ogg", "audio/ogg", "audio", None, None),
    ("00112233", ".wav", "audio/wav", "audio", None, None),
)


def _case(index: int) -> str:
    return "case media_id % 8 " + " ".join(
        f"when {i} then {'null' if h[index] is None else repr(h[index])}" for i, h in enumerate(_HEADS)) + " end"


@query("L2_inspect_media", f"""
    select media_id, {_case(1)} as extension, {_case(2)} as detected_mime, {_case(3)} as detected_kind, cast({_case(4)} as bigint) as width, cast({_case(5)} as bigint) as height from {{media}}""")
def inspect_media(t: Tables):
    """Objects whose bytes start like one of eight formats; the names say something else."""
    head = F.unhex(F.expr(_case(0)))
    rows = t.media.select("media_id", F.concat(head, F.encode(F.col("source"), "utf-8")).alias("content"),
                          F.when(F.col("media_id") % 8 == 7, "a.wav").otherwise("a.bin").alias("file_name"), F.lit("").alias("mime_type"))
    found = C.inspect_objects(rows, "content", "file_name", "mime_type")
    return found.select("media_id", "extension", "detected_mime", "detected_kind", "width", "height")


@query("L3_payload_versions", """
    with v as (select doc_id, c as capture, sha256(case when c = 1 and doc_id % 2 = 0 then text || 'x' when c = 3 and doc_id % 3 = 0 then text || 'y' else text end) as sha
               from {documents}, (values (0), (1), (2), (3)) x(c))
    select doc_id, cast(capture as bigint) as capture, sha, coalesce(sha <> lag(sha) over w, true) as changed,
      coalesce(sha <> lag(sha) over w, true) and capture = min(capture) over (partition by doc_id, sha) as version_added
    from v window w as (partition by doc_id order by capture)""")
def payload_versions(t: Tables):
    doc, capture = F.col("doc_id"), F.col("capture")
    text = F.when((capture == 1) & (doc % 2 == 0), F.concat("text", F.lit("x"))).when((capture == 3) & (doc % 3 == 0), F.concat("text", F.lit("y"))).otherwise(F.col("text"))
    records = t.documents.withColumn("capture", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        "doc_id", F.col("capture").cast("bigint").alias("capture"), F.sha2(text, 256).alias("sha"))
    return C.payload_versions(records, ["doc_id"], "capture", "sha").select("doc_id", "capture", "sha", "changed", "version_added")


@query("L3_link_materialized", """
    select f.media_id, coalesce(case when f.media_id % 2 = 0 then f.conversation_id end, m.conversation_id) as conversation_id, coalesce(f.created_ms, m.created_ms) as created_ms,
       sha256(coalesce(nullif(f.prompt, ''), m.text, '')) as prompt_digest, case when m.role = 'assistant' then m.model end as model
    from {files} f left join {msgs} m on m.id = f.message_id""")
def link_materialized(t: Tables):
    items = t.files.select("media_id", "message_id", F.when(F.col("media_id") % 2 == 0, F.col("conversation_id")).alias("conversation_id"), "created_ms", "prompt",
                           F.lit(None).cast("string").alias("model"))
    linked = C.link_materialized(items, t.msgs)
    return linked.select("media_id", "conversation_id", "created_ms", F.sha2("prompt", 256).alias("prompt_digest"), "model")


_VERSIONS = """with c as (select doc_id, v.capture, 'GIF89aABCD' || text || case when v.capture = 2 and doc_id % 2 = 0 then 'y' else '' end as content, doc_id % 5 = 4 as junk
        from {documents}, (values (1), (2), (3)) v(capture) where v.capture < 3 or doc_id % 4 = 0),
      a as (select doc_id, sha256(content) as sha, strlen(content) as bytes, min(capture) as first, case when min(capture) = 1 and doc_id % 4 = 0 then 3 else min(capture) end as capture,
            case when doc_id % 2 = 1 or doc_id % 4 = 0 then min(capture) = 1 else min(capture) = 2 end as is_latest from c where not junk group by doc_id, content)"""


@query("L3_materialize", _VERSIONS + """
    select 'embedded:images:' || cast(doc_id as varchar) || ':' || left(sha, 16) as media_id, sha, cast(bytes as bigint) as bytes, 16961::bigint as width, 17475::bigint as height, 'image/gif' as mime_type,
      cast(a.capture as bigint) as capture, is_latest, cast(m.conversation_id as varchar) as conversation_id,
      case when doc_id % 3 = 0 then 'my_pic.gif' when m.id is not null then cast(m.conversation_id as varchar) || '_' || m.id || '.gif' when doc_id % 3 = 1 then 'pic.gif' else 'none-' || cast(doc_id as varchar) || '.gif' end as file_name,
      sha256(coalesce(m.text, '')) as prompt_digest
    from a left join {msgs} m on m.id = case when doc_id % 7 = 0 then 'none-' || cast(doc_id as varchar) else cast(doc_id % 100 as varchar) || '-' || cast(doc_id // 100 % 3 as varchar) end""".replace(
        "else 'none-' || cast(doc_id as varchar) || '.gif' end", "else case when doc_id % 7 = 0 then 'none-' || cast(doc_id as varchar) else cast(doc_id % 100 as varchar) || '-' || cast(doc_id // 100 % 3 as varchar) end || '.gif' end"))
def materialized(t: Tables):
    """Four runs over a growing set of captures: A, then B for even records, then A again for every fourth; the last run adds nothing."""
    return L.items(t.spark, _published(t)).select(
        "media_id", "sha", "bytes", "width", "height", "mime_type", "capture", "is_latest", "conversation_id", "file_name", F.sha2(F.coalesce("prompt", F.lit("")), 256).alias("prompt_digest"))


@query("L3_materialize_runs", _VERSIONS + """, r as (select unnest([0, 1, 2, 3]) as version)
    select version, (select count(*) from c where capture = version + 1) as records, (select count(*) from c where capture = version + 1) as payloads,
      (select count(*) from a where first = version + 1) as added from r""")
def materialize_runs(t: Tables):
    """What each run looked at and added; content that comes back and a run without new captures add nothing."""
    return L.manifest(t.spark, _published(t)).select("version", "records", "payloads", "added")


def _published(t: Tables) -> str:
    base, doc = workspace(t.spark, "materialized"), F.col("doc_id")
    content = F.concat(F.lit("GIF89aABCD"), "text", F.when((F.col("capture") == 2) & (doc % 2 == 0), "y").otherwise(""))
    message = F.when(doc % 7 == 0, F.concat(F.lit("none-"), doc)).otherwise(F.concat_ws("-", (doc % 100).cast("string"), (F.floor(doc / 100) % 3).cast("string")))
    record = F.to_json(F.struct(
        F.base64(F.when(doc % 5 == 4, F.lit("junk").cast("binary")).otherwise(content.cast("binary"))).alias("contentBinary"),
        F.when(doc % 5 != 4, F.when(doc % 3 == 0, "my_pic.png").when(doc % 3 == 1, "pic.png")).alias("fileName"), message.alias("messageId")))
    records = t.documents.withColumn("capture", F.explode(F.array(*(F.lit(i).cast("bigint") for i in (1, 2, 3))))).where((F.col("capture") < 3) | (doc % 4 == 0)).select(
        F.lit("images").alias("store"), doc.cast("string").alias("record_id"), "capture", doc.alias("line"), R.parse(record).alias("record"))
    for captures in (1, 2, 3, 3):
        L.publish(base, records.where(F.col("capture") <= captures), t.msgs)
    return base


@query("L11_recovery_import", """
    with known as (select id from {snap_a}), incoming as (select * from {snap_b}),
      fresh as (select id, min(body) as body from incoming where id not in (select id from known) group by 1)
    select (select count(*) from fresh) as first_run, 0::bigint as second_run, cast(sum(id) as bigint) as id_sum from fresh""")
def recovery_import(t: Tables):
    """An import applied twice: the second run adds nothing."""
    doubled = t.snap_b.unionByName(t.snap_b)
    # what the first run adds is written, as an import does, so the second run does not derive it again
    added = materialize(X.recover_messages(t.snap_a, doubled, ["id"], ["body"]), "added")
    again = X.recover_messages(t.snap_a.select("id").unionByName(added.select("id")), doubled, ["id"], ["body"])
    return added.agg(F.count("*").alias("first_run"), F.sum("id").alias("id_sum")).select(
        "first_run", again.agg(F.count("*")).scalar().alias("second_run"), "id_sum")


_IMPORT = """with ec as (select id from {convs} where id % 3 <> 0), em as (select conversation_id, id from {msgs} where conversation_id % 3 <> 0), eh as (select distinct sha from {files} where media_id % 2 = 0),
      ic as (select id, title, kind, r.rank as rank, id as line from {convs}, (values (0), (1)) r(rank)),
      im as (select case when seq % 6 = 5 then null else conversation_id end as conversation_id, id, seq, role, text, model, created_ms, 0 as rank, conversation_id * 1000 + seq as line from {msgs}),
      ih as (select sha, media_id, message_id, bytes, file_name, 0 as rank, media_id as line from {files}),
      pc as (select *, case when id in (select id from ec) then 'known' when row_number() over (partition by id order by rank, line) = 1 then 'add' else 'repeated' end as action from ic),
      pm as (select *, case when conversation_id is null then 'unusable' when (conversation_id, id) in (select (conversation_id, id) from em) then 'known' else 'add' end as action from im),
      ph as (select *, case when sha in (select sha from eh) then 'known' when row_number() over (partition by sha order by rank, line) = 1 then 'add' else 'repeated' end as action from ih)"""


def _imports(t: Tables):
    existing = {"conversations": t.convs.where("id % 3 <> 0"), "messages": t.msgs.where("conversation_id % 3 <> 0"), "media": t.files.where("media_id % 2 = 0")}
    imported = {
        "conversations": t.convs.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("rank"), F.col("id").alias("line")),
        "messages": t.msgs.select(F.when(F.col("seq") % 6 != 5, F.col("conversation_id")).alias("conversation_id"), "id", "seq", "role", "text", "model", "created_ms",
                                  F.lit(0).alias("rank"), (F.col("conversation_id") * 1000 + F.col("seq")).alias("line")),
        "media": t.files.select("sha", "media_id", "message_id", "bytes", "file_name", F.lit(0).alias("rank"), F.col("media_id").alias("line")),
    }
    return existing, imported


@query("L11_dry_run", _IMPORT + " select 'conversations' as entity, action, count(*) as rows from pc group by 2 union all select 'messages', action, count(*) from pm group by 2 union all select 'media', action, count(*) from ph group by 2")
def recovery_dry_run(t: Tables):
    """What an import would add, knows already, repeats or can't use; nothing is written."""
    return Y.recover(*_imports(t))


@query("L11_apply", _IMPORT + """, ac as (select * from pc where action = 'add'), am as (select * from pm where action = 'add'),
      said as (select *, last_value(case when role = 'user' then text end ignore nulls) over (partition by conversation_id order by seq rows between unbounded preceding and 1 preceding) as prompt from pm where action in ('add', 'known')),
      ah as (select h.sha, s.conversation_id, s.prompt from ph h left join said s on s.id = h.message_id where h.action = 'add'),
      ids as (select id from ac union select conversation_id from am)
    select i.id, coalesce(c.title, case when c.id is null then 'Recovered conversation' else 'Untitled conversation' end) as title, coalesce(m.n, 0) as message_count, coalesce(h.n, 0) as media_count,
      m.updated_ms, sha256(coalesce(h.prompts, '')) as prompts
    from ids i left join ac c on c.id = i.id left join (select conversation_id, count(*) as n, max(created_ms) as updated_ms from am group by 1) m on m.conversation_id = i.id
      left join (select conversation_id, count(*) as n, string_agg(coalesce(prompt, ''), '|' order by sha) as prompts from ah group by 1) h on h.conversation_id = i.id""")
def recovery_apply(t: Tables):
    """Roll-up of what an applied import has added, orphans included, with the prompts of its media."""
    base = workspace(t.spark, "recovery")
    Y.recover(*_imports(t), base)
    prompts = t.spark.read.parquet(f"{base}/media").groupBy(F.col("conversation_id").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sha", F.coalesce("prompt", F.lit("")).alias("p")))), lambda x: x["p"]), "|").alias("p"))
    rolled = t.spark.read.parquet(f"{base}/rollup").join(prompts, "id", "left")
    return rolled.select("id", "title", "message_count", "media_count", "updated_ms", F.sha2(F.coalesce("p", F.lit("")), 256).alias("prompts"))


@query("L11_second_run", _IMPORT + """, kc as (select id from ec union select id from pc where action = 'add'), km as (select conversation_id, id from em union select conversation_id, id from pm where action = 'add'),
      kh as (select sha from eh union select sha from ph where action = 'add')
    select 'conversations' as entity, case when id in (select id from kc) then 'known' else 'add' end as action, count(*) as rows from ic group by 2
    union all select 'messages', case when conversation_id is null then 'unusable' when (conversation_id, id) in (select (conversation_id, id) from km) then 'known' else 'add' end, count(*) from im group by 2
    union all select 'media', case when sha in (select sha from kh) then 'known' else 'add' end, count(*) from ih group by 2""")
def recovery_second_run(t: Tables):
    """The same import after it was applied."""
    base = workspace(t.spark, "recovery")
    existing, imported = _imports(t)
    Y.recover(existing, imported, base)
    return Y.recover(Y.with_recovered(existing, base), imported)


@query("L13_materialize_origins", """
    select doc_id, case when rn = 1 and sha not in (select sha from {payloads} where doc_id % 7 = 0) then 'materialized' else 'deduped' end as status from
     (select doc_id, sha, row_number() over (partition by sha order by doc_id % 4, doc_id) as rn from {payloads} where doc_id % 9 <> 8)
    union all select doc_id, 'failed' from {payloads} where doc_id % 9 = 8""")
def materialize_origins(t: Tables):
    """Payloads from four origins share the known hashes; failures stay with a reason."""
    rows = t.payloads.withColumn("origin", F.col("doc_id") % 4)
    done = C.first_seen(rows.where("doc_id % 9 <> 8"), "sha", ["origin", "doc_id"], "doc_id", t.payloads.where("doc_id % 7 = 0"))
    failed = rows.where("doc_id % 9 = 8").select("doc_id", F.lit("failed").alias("status"))
    return done.select("doc_id", "status").unionByName(failed)


@query("A5_hash_payloads", "select doc_id, sha256(text) as sha, cast(strlen(text) as bigint) as bytes from {documents}")
def hash_payloads(t: Tables):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("bigint").alias("bytes"))
