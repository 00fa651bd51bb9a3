"""Queries that run Structured Streaming over what is available and read the result."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators import normalize as N
from threadlake.plans.registry import Tables, query
from threadlake.session import workspace
from threadlake.streaming import ingest as G

ARRIVALS = 3


def arrivals(t: Tables, rows: DataFrame, order: str, write, run, label: str) -> str:
    """Rows arrive in three deliveries; after each the stream takes what is there."""
    base = workspace(t.spark, label)
    size = rows.agg(F.max(order) + 1).scalar()
    part = F.floor(F.col(order) * ARRIVALS / size)
    for i in range(ARRIVALS):
        write(rows.where(part == i), f"{base}/source")
        run(base).awaitTermination()
    return base


def parquet_stream(t: Tables, schema, base: str) -> DataFrame:
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{base}/source")


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def ingested(t: Tables) -> str:
    """Record lines arrive as files; every delivery is normalized and added once, malformed lines are kept apart."""
    record = F.to_json(F.struct(F.concat(F.lit("c"), "conversation_id").alias("conversationId"), "id",
                                F.when(F.col("role") == "assistant", "AI").otherwise("human").alias("role"), F.col("text").alias("content"),
                                F.floor(F.col("created_ms") / 1000).alias("createdAt")))
    line = F.when(F.col("seq") % 5 == 4, F.substring(record, 1, 20)).otherwise(record)
    rows = t.msgs.select("conversation_id", line.alias("value"))
    normalize = lambda good: N.messages(good.select(F.lit("messages").alias("store"), F.lit(None).cast("bigint").alias("line_no"), "record"))
    return arrivals(
        t, rows, "conversation_id", lambda df, path: df.select("value").write.mode("append").text(path),
        lambda base: G.ingest(G.record_stream(t.spark, f"{base}/source", 1000), normalize, f"{base}/messages", f"{base}/checkpoint", f"{base}/quarantine"), "ingest")


@query("T1_stream_ingest", """
    select 'c' || cast(conversation_id as varchar) as conversation_id, id, case when role = 'assistant' then 'AI' else 'human' end as role, sha256(text) as digest, created_ms // 1000 * 1000 as created_ms
    from {msgs} where seq % 5 <> 4""")
def stream_ingest(t: Tables):
    return t.spark.read.parquet(f"{ingested(t)}/messages").select("conversation_id", "id", "role", F.sha2("text", 256).alias("digest"), "created_ms")


@query("T1_stream_quarantine", """
    select '{{"conversationId":"c' as value, count(*) as lines from {msgs} where seq % 5 = 4 having count(*) > 0""")
def stream_quarantine(t: Tables):
    return t.spark.read.parquet(f"{ingested(t)}/quarantine").groupBy("value").agg(F.count("*").alias("lines"))


_CHANGES = """select user_id as key, event_id as seq, state, previous, case when previous is null then 'INITIAL_STATE' else 'STATE_CHANGED' end as event
    from (select user_id, event_id, event_type as state, lag(event_type) over (partition by user_id order by event_id) as previous from {events})
    where previous is null or state <> previous"""


def states(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))


@query("T2_state_changes", _CHANGES)
def state_changes(t: Tables):
    return G.state_changes(states(t))


@query("T2_stream_state_changes", _CHANGES)
def stream_state_changes(t: Tables):
    rows = states(t)
    base = arrivals(t, rows, "seq", append_parquet, lambda base: G.detect_changes(
        parquet_stream(t, rows.schema, base), f"{base}/events", f"{base}/edges", f"{base}/checkpoint"), "changes")
    return t.spark.read.parquet(f"{base}/events").drop("part", "batch_id")


@query("T3_stream_dedup", "select sha, min(doc_id) as doc_id, min(bytes) as bytes from {payloads} group by 1")
def stream_dedup(t: Tables):
    rows = t.payloads.select("sha", "doc_id", "bytes")
    base = arrivals(t, rows, "doc_id", append_parquet, lambda base: G.additive_dedup(
        parquet_stream(t, rows.schema, base), "sha", ["doc_id"], f"{base}/pool", f"{base}/checkpoint"), "dedup")
    return t.spark.read.parquet(f"{base}/pool").drop("shard", "batch_id")


@query("T4_stability_gate", "select id, parent_id, body from {snap_a}")
def stability_gate(t: Tables):
    """Deliveries are accepted while the delivered files stand still.

    The second delivery is read while a file keeps growing: the gate stops the query, and the next run takes the batch.
    """
    rows, base, growing = t.snap_a, workspace(t.spark, "gate"), []
    size = rows.agg(F.max("id") + 1).scalar()

    def inventory() -> DataFrame:
        files = t.spark.read.format("binaryFile").load(f"{base}/source").select(
            "path", F.concat_ws(":", "length", F.unix_millis("modificationTime")).alias("signature"))
        if not growing:
            return files
        growing.append(len(growing))
        return files.unionByName(t.spark.createDataFrame([("growing", str(growing[-1]))], "path string, signature string"))

    def gate() -> None:
        G.stability_gate(parquet_stream(t, rows.schema, base), inventory, f"{base}/accepted", f"{base}/receipts", f"{base}/checkpoint", passes=2).awaitTermination()

    for i in range(ARRIVALS):
        append_parquet(rows.where(F.floor(F.col("id") * ARRIVALS / size) == i), f"{base}/source")
        if i == 1:
            growing.append(0)
            try:
                gate()
                raise AssertionError("an unstable batch was accepted")
            except StreamingQueryException:
                growing.clear()
        gate()
    return t.spark.read.parquet(f"{base}/accepted").drop("batch_id")
