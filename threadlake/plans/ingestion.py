"""Queries that write records the way stores keep them and read them back."""

from pyspark.sql import functions as F

from threadlake.operators import normalize as Z
from threadlake.operators import rollups as U
from threadlake.plans.registry import Tables, query
from threadlake.session import workspace
from threadlake.sources import captures as C
from threadlake.sources import files as W
from threadlake.sources import records as S
from threadlake.sources import sinks as K


def _json(*columns):
    return F.to_json(F.struct(*columns))


def message_lines(t: Tables):
    """Messages as JSON records whose field names and envelopes differ from record to record."""
    seq = F.col("seq")
    shapes = [
        _json("id", F.concat(F.lit("c"), "conversation_id").alias("conversationId"), "role", F.col("text").alias("content"), F.col("model").alias("modelName"),
              F.col("created_ms").alias("createdAt"), F.struct(seq.alias("promptTokens"), (seq + 1).alias("completion_tokens")).alias("usage")),
        _json(F.col("id").alias("_id"), F.concat(F.lit("c"), "conversation_id").alias("mind_conversation_id"), F.col("role").alias("author"),
              F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct("text")).alias("content")),
                      F.struct(F.lit("reasoning").alias("type"), F.array(F.struct(F.lit("hidden").alias("text"))).alias("content"))).alias("output_items"),
              F.col("model").alias("model_id"), F.floor(F.col("created_ms") / 1000).alias("created_at_unix_timestamp"), F.lit(23).alias("totalTokens")),
        F.concat(F.lit('{"id":"outer","documentData":'), _json("id", F.concat(F.lit("c"), "conversation_id").alias("threadId"), "role", "text", "model",
                 F.date_format(F.timestamp_millis("created_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at")), F.lit("}")),
    ]
    line = F.when(seq % 3 == 0, shapes[0]).when(seq % 3 == 1, shapes[1]).otherwise(shapes[2])
    store = F.when(seq % 3 == 0, "messages").when(seq % 3 == 1, "mindMessages").otherwise("rxMessages")
    return t.msgs.select(store.alias("store"), line.alias("line"))


def written_stores(t: Tables, lines, label: str) -> str:
    path = workspace(t.spark, label)
    lines.write.partitionBy("store").text(path)
    return path


def stored_records(t: Tables, path: str):
    store = F.regexp_extract("file", r"/store=([^/]+)/", 1)
    return S.read_store(t.spark, path, numbered=True).withColumn("store", store)


@query("A1_read_store", """
    select source as store, count(*) as records, cast(sum(doc_id) as bigint) as id_sum, cast(sum(length(text)) as bigint) as characters from {documents} group by 1""")
def read_store(t: Tables):
    lines = t.documents.select(F.col("source").alias("store"), F.explode(F.array(_json("doc_id", "text"), F.lit("  "))).alias("line"))
    rows = stored_records(t, written_stores(t, lines, "store"))
    number = F.variant_get("record", "$.doc_id", "bigint")
    return rows.groupBy("store").agg(F.count("*").alias("records"), F.sum(number).alias("id_sum"),
                                     F.sum(F.length(F.variant_get("record", "$.text", "string"))).cast("bigint").alias("characters"))


@query("A1_quarantine", """
    select cast(count_if(doc_id % 10 <> 3) as bigint) as good, cast(count_if(doc_id % 10 = 3) as bigint) as malformed from {documents}""")
def quarantine(t: Tables):
    line = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"))).otherwise(_json("doc_id"))
    good, bad = S.read_store_lenient(t.spark, written_stores(t, t.documents.select(F.col("lang").alias("store"), line.alias("line")), "lenient"))
    return good.agg(F.count("*").alias("good")).select("good", bad.agg(F.count("*")).scalar().alias("malformed"))


@query("A1_line_numbers", """
    select source as store, count(*) as records, cast(count(*) * (count(*) - 1) / 2 as bigint) as line_sum, count(*) - 1 as last_line from {documents} group by 1""")
def line_numbers(t: Tables):
    """Every store is one file here, so its line numbers are 0 to n - 1."""
    path = workspace(t.spark, "lines")
    lines = t.documents.select(F.col("source").alias("store"), _json("doc_id").alias("line"))
    lines.repartition("store").write.partitionBy("store").text(path)
    rows = stored_records(t, path)
    return rows.groupBy("store").agg(F.count("*").alias("records"), F.sum("line_no").cast("bigint").alias("line_sum"), F.max("line_no").alias("last_line"))


@query("A1_normalize_messages", """
    select id, 'c' || cast(conversation_id as varchar) as conversation_id, role, model, case when seq % 3 = 0 then created_ms else created_ms // 1000 * 1000 end as created_ms,
       case when seq % 3 = 0 then seq end as input_tokens, case when seq % 3 = 0 then seq + 1 end as output_tokens,
       case when seq % 3 = 0 then 2 * seq + 1 when seq % 3 = 1 then 23 end as total_tokens, sha256(trim(text)) as digest from {msgs}""")
def normalize_messages(t: Tables):
    rows = Z.messages(stored_records(t, written_stores(t, message_lines(t), "messages")))
    return rows.select("id", "conversation_id", "role", "model", "created_ms", "input_tokens", "output_tokens", "total_tokens",
                       F.sha2(F.trim("text"), 256).alias("digest"))


@query("A1_normalize_conversations", """
    select case when id % 3 = 2 then null else 'c' || cast(id as varchar) end as id, case when title is not null then title when id % 3 = 1 then 'Image Studio' else 'Untitled conversation' end as title,
       case when id % 3 = 0 then 'agentic' when id % 3 = 1 then 'studio' else 'chat' end as kind, case when id % 3 = 1 then 'image' end as studio_type,
       case when id % 3 = 0 then kind || chr(10) || 'more' else '' end as preview, count(*) as copies from {convs} group by 1, 2, 3, 4, 5""")
def normalize_conversations(t: Tables):
    key = F.concat(F.lit("c"), F.col("id").cast("string"))
    kind = F.col("id") % 3
    line = F.when(kind == 0, _json(key.alias("id"), F.col("title").alias("name"), F.array(F.col("kind"), F.lit("more")).alias("summary"))) \
        .when(kind == 1, F.concat(F.lit('{"value":'), _json(key.alias("_id"), "title"), F.lit("}"))).otherwise(_json("title", F.lit(0).alias("createdAt")))
    store = F.when(kind == 0, "mindConversations").when(kind == 1, "studioImageSessions").otherwise("conversations")
    rows = Z.conversations(stored_records(t, written_stores(t, t.convs.select(store.alias("store"), line.alias("line")), "conversations")))
    own = F.when(F.col("store") != "conversations", F.col("id"))  # the others are named by store and line
    return rows.groupBy(own.alias("id"), "title", "kind", "studio_type", "preview").agg(F.count("*").alias("copies"))


@query("A1_normalize_media", """
    select 'f' || cast(media_id as varchar) as media_id, 'c' || cast(conversation_id as varchar) as conversation_id, message_id, file_name, mime_type,
       case when mime_type like '%/%' and kind <> 'file' then kind when media_id % 2 = 0 then 'image' else 'file' end as kind, prompt, case when disposition is not null then disposition when media_id % 2 = 1 then 'input' end as disposition
    from {files}""")
def normalize_media(t: Tables):
    key = F.concat(F.lit("f"), F.col("media_id").cast("string"))
    even = F.col("media_id") % 2 == 0
    line = F.when(even, _json(key.alias("id"), F.concat(F.lit("c"), "conversation_id").alias("sessionId"), F.col("message_id").alias("turn_id"), F.col("file_name").alias("filename"),
                              F.col("mime_type").alias("contentType"), "prompt", F.col("disposition").alias("mediaRole"))) \
        .otherwise(F.concat(F.lit('{"doc":'), _json(key.alias("id"), F.concat(F.lit("c"), "conversation_id").alias("mindConversationId"), F.col("message_id").alias("mindMessageId"),
                   F.col("file_name").alias("name"), "mime_type", F.col("prompt").alias("text"), F.col("disposition").alias("media_disposition")), F.lit("}")))
    store = F.when(even, "messageImages").otherwise("mindAttachments")
    rows = Z.media(stored_records(t, written_stores(t, t.files.select(store.alias("store"), line.alias("line")), "media")))
    return rows.select("media_id", "conversation_id", "message_id", "file_name", "mime_type", "kind", F.nullif(F.col("prompt"), F.lit("")).alias("prompt"), "disposition")


_MANIFEST = "run_id string, stores array<struct<name:string,records:bigint>>, files array<struct<path:string,bytes:bigint>>"


def manifests(t: Tables):
    """One manifest document per source; its lists have one entry per language."""
    per = t.documents.groupBy("source", "lang").agg(F.count("*").alias("records"), F.sum(F.length("text")).cast("bigint").alias("bytes"))
    documents = per.groupBy("source").agg(
        F.collect_list(F.struct(F.col("lang").alias("name"), "records")).alias("stores"),
        F.collect_list(F.struct(F.concat(F.lit("files/"), "lang").alias("path"), "bytes")).alias("files"))
    path = workspace(t.spark, "manifests")
    documents.select(F.col("source").alias("run_id"), F.to_json(F.struct(F.col("source").alias("run_id"), "stores", "files")).alias("value")) \
        .write.partitionBy("run_id").text(path)
    return path


@query("A2_read_json_doc", "select source as run_id, count(distinct lang) as stores, cast(sum(length(text)) as bigint) as bytes from {documents} group by 1")
def read_json_doc(t: Tables):
    docs = S.read_json_doc(t.spark, manifests(t), _MANIFEST)
    absent = S.read_json_doc(t.spark, workspace(t.spark, "absent"), _MANIFEST)  # a missing document is no row
    return docs.unionByName(absent).select("run_id", F.size("stores").cast("bigint").alias("stores"),
                                           F.aggregate("files", F.lit(0).cast("bigint"), lambda a, f: a + f["bytes"]).alias("bytes"))


@query("A6_explode_manifest", """
    select source as run_id, 'store' as item, lang as name, count(*) as amount from {documents} group by 1, 3
    union all select source, 'file', 'files/' || lang, cast(sum(length(text)) as bigint) from {documents} group by 1, 3""")
def explode_manifest(t: Tables):
    stores, files = C.explode_manifest(S.read_json_doc(t.spark, manifests(t), _MANIFEST))
    return stores.select("run_id", F.lit("store").alias("item"), "name", F.col("records").alias("amount")).unionByName(
        files.select("run_id", F.lit("file").alias("item"), F.col("path").alias("name"), F.col("bytes").alias("amount")))


@query("A3_read_json_array", "select doc_id // 50 as part, count(*) as records, cast(sum(doc_id) as bigint) as id_sum from {documents} group by 1")
def read_json_array(t: Tables):
    """Stores of at most fifty records, each saved as one top-level array."""
    arrays = t.documents.groupBy(F.floor(F.col("doc_id") / 50).alias("part")).agg(F.to_json(F.collect_list(F.struct("doc_id", "text"))).alias("value"))
    path = workspace(t.spark, "arrays")
    arrays.repartition("part").write.partitionBy("part").text(path)
    rows = S.read_json_array(t.spark, path, "doc_id bigint, text string")
    return rows.groupBy(F.floor(F.col("doc_id") / 50).alias("part")).agg(F.count("*").alias("records"), F.sum("doc_id").alias("id_sum"))


def payload_files(t: Tables) -> str:
    """One file per five hundred documents, lines in document order."""
    path = workspace(t.spark, "payloads")
    rows = t.documents.select(F.floor(F.col("doc_id") / 500).alias("part"), "doc_id", "text")
    rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(path)
    return path


@query("A4_scan_files", "select 'part=' || cast(doc_id // 500 as varchar) as folder, cast(sum(strlen(text) + 1) as bigint) as bytes, count(distinct doc_id // 500) as files from {documents} group by 1")
def scan_files(t: Tables):
    files = W.scan_files(t.spark, payload_files(t)).where(F.col("path").endswith(".txt"))
    return files.groupBy(F.split("path", "/").getItem(0).alias("folder")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


@query("A5_hash_files", "select 'part=' || cast(doc_id // 500 as varchar) as folder, sha256(string_agg(text, chr(10) order by doc_id) || chr(10)) as sha from {documents} group by 1")
def hash_files(t: Tables):
    files = W.hash_files(t.spark, payload_files(t)).where(F.col("path").endswith(".txt"))
    return files.select(F.split("path", "/").getItem(0).alias("folder"), "sha")


_CAPTURES = "c as (select distinct 'capture-' || strftime(ts, '%Y%m%d') as name, day(ts) % 3 <> 0 as ok from {events})"


def captures(t: Tables):
    at = F.col("ts").cast("timestamp")
    return t.events.select(F.concat(F.lit("capture-"), F.date_format(at, "yyyyMMdd")).alias("name"), (F.dayofmonth(at) % 3 != 0).alias("ok")).distinct()


@query("A7_capture_sources", "with " + _CAPTURES + """
    select name, layer, cast(row_number() over (order by g, name desc) as bigint) as source_rank from
      (select name, 'capture' as layer, 0 as g from c where ok union all select 'imported archive', 'imported', 1 from {region} where r_regionkey = 0
       union all select 'recovered media', 'recovery', 3 from {region} where r_regionkey = 0)""")
def capture_sources(t: Tables):
    layers = t.region.where("r_regionkey < 3").select(
        F.when(F.col("r_regionkey") == 0, "imported archive").when(F.col("r_regionkey") == 1, "recovered media").otherwise("something else").alias("name"))
    return C.capture_sources(captures(t), layers)


@query("A8_latest_verified", "with " + _CAPTURES + " select name, ok from c where ok order by name desc limit 1")
def latest_verified(t: Tables):
    return C.latest_verified(captures(t))


_VERSIONED = "select event_id, concat(event_type, '-', cast((user_id + length(event_type)) % 12 as string), '-documents') as store, value, event_id % 6 = 0 as deleted from {events}"


@query("A9_latest_versions", "with s as (" + _VERSIONED + """), l as (select split_part(store, '-', 1) as base, max(cast(split_part(store, '-', 2) as int)) as v from s group by 1)
    select l.base, cast(l.v as bigint) as version, count(*) as documents, cast(sum(event_id) as bigint) as id_sum, cast(sum(2) as bigint) // 2 * 1 as fields
    from s join l on s.store = l.base || '-' || cast(l.v as varchar) || '-documents' where not deleted group by 1, 2""")
def latest_versions(t: Tables):
    rows = t.sql(_VERSIONED)
    records = rows.select("store", _json("event_id", F.col("deleted").alias("_deleted"), F.lit("1-x").alias("_rev"), F.lit(0).alias("_meta")).alias("record"))
    latest = C.latest_versions(records.select("store").distinct())
    live = C.live_documents(records, latest)
    return live.join(latest.select("base", "version"), "base").groupBy("base", "version").agg(
        F.count("*").alias("documents"), F.sum(F.col("fields")["event_id"].cast("bigint")).alias("id_sum"), F.sum(F.size("fields")).cast("bigint").alias("fields"))


@query("A10_discover_stores", """
    select distinct event_type as name, event_type not in ('view', 'click', 'purchase') as discovered from {events}
    union all select 'retired', false from {region} where r_regionkey = 0""")
def discover_stores(t: Tables):
    return C.discover_stores(["view", "click", "purchase", "retired"], t.events.select(F.col("event_type").alias("name")))


@query("B1_write_indexes", """
    select 'conversations' as name, count(*) as records, cast(sum(id) as bigint) as id_sum from {convs}
    union all select 'messages', count(*), cast(sum(seq) as bigint) from {msgs} union all select 'media', count(*), cast(sum(media_id) as bigint) from {media}""")
def write_indexes(t: Tables):
    base = workspace(t.spark, "indexes")
    K.write_indexes(base, t.convs, t.msgs, t.media)
    total = lambda name, column: t.spark.read.parquet(f"{base}/{name}").agg(
        F.lit(name).alias("name"), F.count("*").alias("records"), F.sum(column).alias("id_sum"))
    return total("conversations", "id").unionByName(total("messages", "seq")).unionByName(total("media", "media_id"))


@query("B3_write_documents", "select conversation_id, count(*) + 1 as sections, cast(min(seq) as bigint) - 1 as first from {msgs} group by 1")
def write_documents(t: Tables):
    path = workspace(t.spark, "documents")
    K.write_documents(U.markdown_sections(U.roll_up(t.convs, t.msgs), t.msgs), path)
    return t.spark.read.parquet(path).groupBy("conversation_id").agg(F.count("*").alias("sections"), F.min("seq").alias("first"))
