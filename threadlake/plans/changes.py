"""Queries for change data and incremental processing."""

from pyspark.sql import functions as F

from threadlake.functions import scalars as S
from threadlake.operators import changes as D
from threadlake.plans.registry import Tables, query

_CHANGE = """select coalesce(a.id, b.id) as id, case when a.id is null then 'created' when b.id is null then 'removed'
    when a.body <> b.body then 'modified' else 'same' end as change from {snap_a} a full join {snap_b} b on a.id = b.id"""


@query("M1_inventory_diff", "select * from (" + _CHANGE + ") where change <> 'same'")
def inventory_diff(t: Tables):
    return D.inventory_diff(t.snap_a, t.snap_b, "id", "body")


@query("M1_forced_delta", "select id, case when change = 'same' then 'modified' else change end as change from (" + _CHANGE + ") where change <> 'same' or id % 101 = 0")
def forced_delta(t: Tables):
    return D.consistency_delta(t.snap_b, t.snap_a, t.orders.where("o_orderkey % 101 = 0").select(F.col("o_orderkey").alias("id")), "id", "body")


# stores are (customer segment, status) groups of two snapshots of the orders
_STORE_A = "sa as (select concat(o_orderstatus, '-', o_orderpriority) as name, count(*) as records, cast(sum(o_orderkey) as bigint) as fingerprint from {orders} where o_orderkey % 7 <> 0 and o_orderpriority <> '2-HIGH' group by 1)"
_STORE_B = "sb as (select concat(o_orderstatus, '-', o_orderpriority) as name, count(*) as records, cast(sum(case when o_orderstatus = 'F' then o_orderkey + 1 else o_orderkey end) as bigint) as fingerprint from {orders} where o_orderkey % 7 <> 0 and o_orderpriority <> '1-URGENT' group by 1)"
_CORE = ("O-5-LOW", "F-3-MEDIUM")
_STORE_PLAN = f"""st as (select coalesce(b.name, a.name) as name, case when b.name is null then 'removed' when a.fingerprint = b.fingerprint and a.records = b.records then 'skip' else 'read' end as action
      from sa a full join sb b on a.name = b.name),
    plan as (select name, case when action = 'skip' and name in {_CORE} and (select bool_or(action <> 'skip') from st where name in {_CORE}) then 'read' else action end as action from st)"""


def stores(t: Tables, edited: bool, without: str):
    key = F.col("o_orderkey")
    value = F.when(F.col("o_orderstatus") == "F", key + 1).otherwise(key) if edited else key
    rows = t.orders.where((key % 7 != 0) & (F.col("o_orderpriority") != without))
    return rows.groupBy(F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("name")).agg(F.count("*").alias("records"), F.sum(value).alias("fingerprint"))


def store_plan(t: Tables):
    return D.incremental_stores(stores(t, False, "2-HIGH"), stores(t, True, "1-URGENT"), _CORE)


@query("M2_incremental_stores", "with " + _STORE_A + ", " + _STORE_B + ", " + _STORE_PLAN + " select * from plan")
def incremental_stores(t: Tables):
    return store_plan(t)


_FILE_PLAN = """fp as (select coalesce(a.id, b.id) as id, case when b.id is null then 'removed' when a.id is not null and a.id % 31 <> 0 and a.body = b.body then 'skip' else 'read' end as action
    from {snap_a} a full join {snap_b} b on a.id = b.id)"""


def file_plan(t: Tables):
    shape = lambda df: df.select(F.col("id").cast("string").alias("path"), F.length("body").alias("bytes"), (F.col("id") % 31).alias("modified"))
    return D.incremental_files(shape(t.snap_a), shape(t.snap_b))


@query("M2_incremental_files", "with " + _FILE_PLAN + " select cast(id as varchar) as path, action from fp")
def incremental_files(t: Tables):
    return file_plan(t)


@query("M2_plan_summary", "with " + _STORE_A + ", " + _STORE_B + ", " + _STORE_PLAN + ", " + _FILE_PLAN + """
    select cast(count_if(action = 'read') as bigint) as stores_read, cast(count_if(action = 'skip') as bigint) as stores_skip, cast(count_if(action = 'removed') as bigint) as stores_removed,
      (select count(*) from fp where action = 'read') as files_read, (select count(*) from fp where action = 'skip') as files_skip, (select count(*) from fp where action = 'removed') as files_removed,
      false as unchanged from plan""")
def plan_summary(t: Tables):
    return D.plan_summary(store_plan(t), file_plan(t))


@query("M3_read_scope", """
    select not bool_or(event_type = 'view') as reuse_stores, true as reuse_files, bool_or(event_type in ('click', 'purchase')) as local_storage_changed,
       bool_or(event_type in ('signup', 'error')) as session_storage_changed from {events}""")
def read_scope(t: Tables):
    path = F.when(F.col("event_type") == "view", "IndexedDB/x").when(F.col("event_type").isin("click", "purchase"), "Local Storage/x").otherwise("Session Storage/x")
    return D.read_scope(t.events.select(path.alias("path")))


@query("M4_hash_reuse", """
    select b.id, case when a.id is not null then a.body end as sha, a.id is not null as reused from {snap_b} b left join
      (select * from {snap_a} where id % 4 <> 0) a on a.id = b.id and a.body = b.body""")
def hash_reuse(t: Tables):
    shape = lambda df: df.select(F.col("id").alias("path"), F.lit(1).alias("bytes"), F.col("body").alias("signature"))
    known, fresh = D.reuse_hashes(shape(t.snap_b), shape(t.snap_a).withColumn("sha", F.when(F.col("path") % 4 != 0, F.col("signature"))))
    return known.select(F.col("path").alias("id"), "sha", F.lit(True).alias("reused")).unionByName(
        fresh.select(F.col("path").alias("id"), F.lit(None).cast("string").alias("sha"), F.lit(False).alias("reused")))


@query("M5_registry_rounds", """
    select id, coalesce(c.body, b.body, a.body) as body, case when c.id is not null then 'active' else 'tombstoned' end as status,
      cast(case when c.id is not null then 3 when b.id is not null then 2 else 1 end as bigint) as last_seen,
      cast(case when c.id is not null then null when b.id is not null then 3 when a.id is not null then 2 end as bigint) as tombstoned_at
    from (select o_orderkey as id from {orders}) o left join {snap_a} a using (id) left join {snap_b} b using (id) left join {snap_c} c using (id)
    where coalesce(a.id, b.id, c.id) is not null""")
def registry_rounds(t: Tables):
    registry = D.empty_registry(t.snap_a, ["body"])
    for now, snapshot in ((1, t.snap_a), (2, t.snap_b), (3, t.snap_c)):
        registry = D.upsert_registry(registry, snapshot, F.lit(now).cast("bigint"), ["body"])
    return registry


_ACTION = """wp as (select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'tombstoned'
    when a.id % 23 <> 0 and a.body = b.body then 'skipped' else 'changed' end as action from {snap_a} a full join {snap_b} b on a.id = b.id)"""


def hashed(df):
    return df.withColumn("record_hash", F.when(F.col("id") % 23 != 0, F.col("body")))


@query("M6_write_plan", "with " + _ACTION + " select * from wp")
def write_plan(t: Tables):
    return D.write_plan(hashed(t.snap_a), hashed(t.snap_b))


@query("B6_diff_package", "select b.id, b.body from {snap_b} b left join {snap_a} a on a.id = b.id where a.id is null or a.body <> b.body")
def diff_package(t: Tables):
    return D.diff_package(t.snap_b, t.snap_a, "id", "body").select("id", "body")


@query("B5_run_manifest", "with " + _ACTION + """,
    m as (select count_if(media_id % 6 = 0)::bigint as unresolved, count_if(media_id % 6 = 5)::bigint as failed, count_if(media_id % 6 in (1, 2))::bigint as materialized,
          count_if(media_id % 6 in (3, 4))::bigint as deduped from {media})
    select cast(count_if(action = 'added') as bigint) as added, cast(count_if(action = 'changed') as bigint) as changed, cast(count_if(action = 'skipped') as bigint) as skipped,
      cast(count_if(action = 'tombstoned') as bigint) as tombstoned, any_value(m.materialized) as materialized, any_value(m.deduped) as deduped, any_value(m.unresolved) as unresolved, any_value(m.failed) as failed,
      concat(any_value(m.unresolved), ' media records are unresolved. ', any_value(m.failed), ' media attempts failed.') as warnings, 'incomplete' as status from wp, m""")
def run_manifest(t: Tables):
    """The row of a run, appended to the table of runs and read back."""
    from threadlake.session import workspace
    from threadlake.sources.sinks import append_run
    totals = D.write_totals(D.write_plan(hashed(t.snap_a), hashed(t.snap_b)))
    kind = F.col("media_id") % 6
    media = t.media.select(F.when(kind == 0, "unresolved").when(kind == 5, "failed").when(kind < 3, "materialized").otherwise("deduped").alias("status"))
    path = workspace(t.spark, "runs")
    append_run(D.run_manifest(totals, media), path)
    return t.spark.read.parquet(path)


_SIDES = """bc as (select distinct o_custkey as id from {orders} where o_custkey % 10 <> 1), sc as (select distinct o_custkey as id from {orders} where o_custkey % 10 <> 2),
    bm as (select o_custkey as conversation_id, o_orderkey as id from {orders} where not (o_custkey % 10 = 3 and o_orderkey % 5 = 0)),
    sm as (select o_custkey as conversation_id, case when o_custkey % 10 = 4 and o_orderkey % 7 = 0 then -o_orderkey else o_orderkey end as id from {orders}),
    p as (select coalesce(b.conversation_id, s.conversation_id) as id, count(b.id) as backup_count, count(s.id) as site_count, count_if(b.id is null or s.id is null) as unmatched
          from bm b full join sm s on b.conversation_id = s.conversation_id and b.id = s.id group by 1),
    cmp as (select coalesce(bc.id, sc.id) as id, case when sc.id is null then 'restore' when bc.id is null then 'backup-new'
         when backup_count = site_count and unmatched = 0 then 'synced' else 'conflict' end as status, backup_count, site_count
      from bc full join sc on bc.id = sc.id left join p on p.id = coalesce(bc.id, sc.id))"""


def compared(t: Tables):
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    ids = t.orders.select(customer.alias("id")).distinct()
    backup = t.orders.where(~((customer % 10 == 3) & (order % 5 == 0))).select(customer.alias("conversation_id"), order.alias("id"))
    site = t.orders.select(customer.alias("conversation_id"), F.when((customer % 10 == 4) & (order % 7 == 0), -order).otherwise(order).alias("id"))
    return D.compare_sides(ids.where("id % 10 <> 1"), ids.where("id % 10 <> 2"), backup, site)


@query("M7_compare_sides", "with " + _SIDES + " select id, status, backup_count, site_count from cmp")
def compare_sides(t: Tables):
    return compared(t)


@query("M8_sync_state", "with " + _SIDES + """
    select cast(count_if(status = 'restore') as bigint) as restore, cast(count_if(status = 'conflict') as bigint) as conflict, cast(count_if(status = 'backup-new') as bigint) as backup_new,
      cast(count_if(status = 'synced') as bigint) as synced, 'needs_check' as state, 'DIVERGED' as relation from cmp""")
def sync_state(t: Tables):
    return D.sync_state(compared(t))


@query("M9_record_fingerprints", """
    select p_type as store, case when p_partkey % 4 = 0 then p_type || '-' || cast(p_partkey + 1 as varchar) else p_name || cast(p_partkey as varchar) end as record_id,
       sha256(p_name || '|' || p_brand) as record_hash from {part}""")
def record_fingerprints(t: Tables):
    records = t.part.select("p_type", "p_partkey", F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("id"), "p_name", "p_brand")
    return D.record_fingerprints(records, "p_type", "p_partkey", ["id"], F.concat_ws("|", "p_name", "p_brand"))


@query("M10_schema_compatibility", """
    select p_partkey, version, case when p_partkey % 5 = 0 then 'invalid' when p_size % 3 = 0 then 'migration-required'
       when p_size % 3 = 1 and p_partkey % 4 = 0 then 'current' else 'unsupported-newer' end as status from
      (select p_partkey, p_size, case when p_partkey % 5 = 0 then 'v' || cast(p_size as varchar) else cast(p_size % 3 as varchar) || '.' || cast(p_partkey % 4 as varchar) || '.' || cast(p_partkey % 4 * 3 as varchar) end as version from {part})""")
def schema_compatibility(t: Tables):
    key, size = F.col("p_partkey"), F.col("p_size")
    text = lambda c: c.cast("string")
    version = F.when(key % 5 == 0, F.concat(F.lit("v"), text(size))).otherwise(F.concat_ws(".", text(size % 3), text(key % 4), text(key % 4 * 3)))
    return t.part.select("p_partkey", version.alias("version")).withColumn("status", S.schema_compatibility(F.col("version")))
