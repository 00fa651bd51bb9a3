"""Queries for verification and audit."""

from pyspark.sql import functions as F

from threadlake.operators import verify as V
from threadlake.plans.content import _digest as digest_sql
from threadlake.plans.registry import Tables, query

_DECLARED = """d as (select event_type as name, count(*) + case when event_type = 'click' then 1 else 0 end as records,
      case when event_type = 'view' then count(*) + 2 when event_type = 'error' then null else count(*) end as expected_records from {events} group by 1),
    a as (select event_type as name, count(*) as lines from {events} where event_type <> 'signup' group by 1),
    checked as (select d.name, a.lines, concat_ws(' ', case when a.lines is null then d.name || ': file is missing.' end,
        case when a.lines <> d.records then d.name || ': manifest reports ' || d.records || ' records but file contains ' || a.lines || '.' end,
        case when a.lines <> d.expected_records then d.name || ': inventory reported ' || d.expected_records || ' records but ' || a.lines || ' were captured.' end) as errors
      from d left join a on a.name = d.name)"""


def store_checks(t: Tables):
    n = F.count("*")
    declared = t.events.groupBy(F.col("event_type").alias("name")).agg(n.alias("n")).select(
        "name", (F.col("n") + F.when(F.col("name") == "click", 1).otherwise(0)).alias("records"),
        F.when(F.col("name") == "view", F.col("n") + 2).when(F.col("name") != "error", F.col("n")).alias("expected_records"))
    actual = t.events.where("event_type <> 'signup'").groupBy(F.col("event_type").alias("name")).agg(n.alias("lines"))
    return V.verify_stores(declared, actual)


@query("L6_verify_capture", "with " + _DECLARED + " select name, lines, errors from checked")
def verify_capture(t: Tables):
    return store_checks(t).withColumn("errors", F.array_join("errors", " "))


_FILES = """f as (select cast(doc_id as varchar) as path, bytes + case when doc_id % 40 = 3 then 1 else 0 end as bytes, case when doc_id % 50 = 4 then 'x' when doc_id % 3 = 0 then null else sha end as sha,
      case when doc_id % 60 <> 5 then bytes end as actual_bytes, sha as actual_sha from {payloads}),
    fc as (select path, bytes, actual_bytes, case when actual_bytes is null then 'missing' when actual_bytes <> bytes then 'size mismatch'
      when sha is not null and sha <> actual_sha then 'hash mismatch' end as problem from f)"""


def file_checks(t: Tables):
    doc = F.col("doc_id")
    declared = t.payloads.select(doc.cast("string").alias("path"), (F.col("bytes") + F.when(doc % 40 == 3, 1).otherwise(0)).alias("bytes"),
                                 F.when(doc % 50 == 4, "x").when(doc % 3 != 0, F.col("sha")).alias("sha"))
    actual = t.payloads.where("doc_id % 60 <> 5").select(doc.cast("string").alias("path"), "bytes", "sha")
    return V.verify_files(declared, actual)


@query("L7_verify_files", "with " + _FILES + " select * from fc")
def verify_files(t: Tables):
    return file_checks(t)


@query("L6_capture_report", "with " + _DECLARED + ", " + _FILES + """
    select (select count(lines) from checked) as stores, (select cast(sum(lines) as bigint) from checked) as store_records, count(actual_bytes) as files,
      cast(sum(actual_bytes) as bigint) as file_bytes, count(problem) + (select count(*) from checked where lines is null) + (select cast(sum(case when lines <> records then 1 else 0 end + case when lines <> expected_records then 1 else 0 end) as bigint)
         from d join a on a.name = d.name) as errors, false as ok from fc""")
def capture_report(t: Tables):
    return V.capture_report(store_checks(t), file_checks(t))


_VIOLATIONS = """v as (
    select 'record count' as "check", cast(coalesce(a.parent_id, b.parent_id) as varchar) as entity, cast(a.n as varchar) as expected, cast(b.n as varchar) as actual
      from (select parent_id, count(*) as n from {snap_a} group by 1) a full join (select parent_id, count(*) as n from {snap_b} group by 1) b on a.parent_id = b.parent_id
      where a.n is distinct from b.n
    union all select 'duplicate id', sha, '1', cast(count(*) as varchar) from {payloads} group by sha having count(*) > 1
    union all select 'content path', 'media/sha256/' || substring(sha, 1, 2) || '/x' || sha || '.png', 'media/sha256/' || substring(sha, 1, 2) || '/' || sha || '.',
        'media/sha256/' || substring(sha, 1, 2) || '/x' || sha || '.png' from {payloads} where doc_id % 30 = 2
    union all select 'index and source differ', concat_ws(':', cast(coalesce(a.id, b.id) as varchar), coalesce(a.body, b.body)), case when b.id is null then '0' else '1' end, case when a.id is null then '0' else '1' end
      from {snap_a} a full join {snap_b} b on a.id = b.id and a.body = b.body where a.id is null or b.id is null
    union all select 'total', 'total', '1', cast(count(*) as varchar) from {payloads} having count(*) <> 1)"""


def violations(t: Tables):
    per = lambda df: df.groupBy("parent_id").agg(F.count("*").alias("n"))
    path = F.concat(F.lit("media/sha256/"), F.substring("sha", 1, 2), F.when(F.col("doc_id") % 30 == 2, "/x").otherwise("/"), "sha", F.lit(".png"))
    return (
        V.count_mismatches(per(t.snap_a), per(t.snap_b), "parent_id", "n", "record count")
        .unionByName(V.duplicate_ids(t.payloads, ["sha"])).unionByName(V.path_violations(t.payloads.select(path.alias("path"), "sha")))
        .unionByName(V.set_violations(t.snap_a, t.snap_b, ["id", "body"])).unionByName(V.total_violation(t.payloads, "total", 1))
    )


@query("L8_verify_archive", "with " + _VIOLATIONS + " select * from v")
def verify_archive(t: Tables):
    return violations(t)


@query("L8_content_hashes", "with " + digest_sql("conversation_id", "seq", "concat_ws('|', id, role, text)", "msgs") + """
    select 'record hash' as "check", cast(store as varchar) as entity, 'x' || digest as expected, digest as actual from l4 where store % 7 = 2
    union all select 'file hash', 'media/' || cast(doc_id as varchar), case when doc_id % 20 = 4 then 'wrong' when doc_id % 20 = 5 then null else sha256(text) end,
       case when doc_id % 20 <> 6 then sha256(text) end from {documents} where doc_id % 20 in (4, 5, 6)""")
def content_hashes(t: Tables):
    """Hashes are computed again from records and bytes; some declared ones are wrong, missing or without a file."""
    from threadlake.operators.digests import ordered_digest
    record = F.concat_ws("|", "id", "role", "text")
    declared = ordered_digest(t.msgs.withColumn("sha", F.sha2(record, 256)), ["conversation_id"], "seq", "sha", "record_hash")
    declared = declared.withColumn("record_hash", F.when(F.col("conversation_id") % 7 == 2, F.concat(F.lit("x"), "record_hash")).otherwise(F.col("record_hash")))
    doc, path = F.col("doc_id") % 20, F.concat(F.lit("media/"), "doc_id").alias("path")
    listed = t.documents.where(doc != 5).select(path, F.when(doc == 4, "wrong").otherwise(F.sha2("text", 256)).alias("sha256"))
    files = t.documents.where(doc != 6).select(path, F.col("text").cast("binary").alias("content"))
    return V.record_hash_violations(declared, t.msgs, "conversation_id", "seq", record).unionByName(V.file_hash_violations(listed, files))


@query("F14_quality_summary", "with " + _VIOLATIONS + """
    select "check", count(*) as findings, case when "check" = 'duplicate id' then 'warning' else 'error' end as severity from v group by 1""")
def quality_summary(t: Tables):
    return V.quality_summary(violations(t), ["duplicate id"])


@query("F14_run_status", "with " + _VIOLATIONS + """
    select cast(count_if("check" <> 'duplicate id') as bigint) as errors, cast(count_if("check" = 'duplicate id') as bigint) as warnings, 'failed' as status from v""")
def run_status(t: Tables):
    return V.run_status(V.quality_summary(violations(t), ["duplicate id"]))


@query("L10_inventory_guard", """
    select cast(count_if(a.id is null) as bigint) as created, cast(count_if(b.id is null) as bigint) as removed, cast(count_if(a.body <> b.body) as bigint) as modified,
       cast(count_if(a.body = b.body) as bigint) as same, 'incomplete' as status from {snap_a} a full join {snap_b} b on a.id = b.id""")
def inventory_guard(t: Tables):
    return V.inventory_guard(t.snap_a, t.snap_b, "id", "body")


@query("L14_coverage_gate", """
    with i as (select l_shipmode_like as name, count(*) as expected from (select concat('store-', cast(l_suppkey % 40 as varchar)) as l_shipmode_like from {lineitem}) group by 1),
      f as (select concat('store-', cast(l_suppkey % 40 as varchar)) as name, count(*) as actual from {lineitem} where l_suppkey % 40 <> 7 and not (l_suppkey % 40 = 9 and l_linenumber = 1) group by 1),
      c as (select distinct concat('store-', cast(s_suppkey % 50 as varchar)) as name from {supplier} where s_suppkey % 50 >= 20)
    select coalesce(c.name, i.name) as name, c.name is null as discovered, i.expected, f.actual,
      case when i.name is null then 'absent' when f.actual is null then 'missing' when f.actual <> i.expected then 'mismatch' else 'ok' end as status,
      i.name is not null and (f.actual is null or f.actual <> i.expected) as violation
    from c full join i on i.name = c.name left join f on f.name = coalesce(c.name, i.name)""")
def coverage_gate(t: Tables):
    name = F.concat(F.lit("store-"), (F.col("l_suppkey") % 40).cast("string")).alias("name")
    inventory = t.lineitem.groupBy(name).agg(F.count("*").alias("records"))
    arrived = t.lineitem.where((F.col("l_suppkey") % 40 != 7) & ~((F.col("l_suppkey") % 40 == 9) & (F.col("l_linenumber") == 1)))
    fetched = arrived.groupBy(name).agg(F.count("*").alias("records"))
    configured = t.supplier.where("s_suppkey % 50 >= 20").select(F.concat(F.lit("store-"), (F.col("s_suppkey") % 50).cast("string")).alias("name")).distinct()
    return V.coverage(configured, inventory, fetched)
