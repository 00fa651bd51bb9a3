"""Continuous ingestion with Structured Streaming.

Tables that a stream maintains are folders of one sub-folder per batch: a batch that
is repeated after a failure overwrites its own folder, so effects happen once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from threadlake.functions import records as R
from threadlake.operators import bloom
from threadlake.operators.ordered import first_of_group, last_before
from threadlake.session import materialize

#: Keyed state lives in RocksDB; a batch uploads what it has changed, not the whole store.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_batches(spark: SparkSession, table: str, schema: StructType, before: int | None = None) -> DataFrame:
    """Rows of a batch table; with ``before`` only those of earlier batches."""
    full = StructType([*schema.fields, StructField("batch_id", LongType())])
    rows = spark.read.schema(full).parquet(table)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def _write_batch(df: DataFrame, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")


def record_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of store lines; each new file is one step of the source checkpoint."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    return lines.where(F.trim("value") != "").select("value", R.parse("value").alias("record"))


def run(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Processes what is available now, one ``apply`` per batch."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, normalize: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, quarantine: str | None = None) -> StreamingQuery:
    """New records become normalized rows; nothing already written is touched.

    Malformed lines (no ``record``) go to the table ``quarantine``; without one they stop the query.
    """
    def apply(df: DataFrame, batch_id: int) -> None:
        good = df.where("record is not null").drop("value")
        if quarantine is not None:
            _write_batch(df.where("record is null").select("value"), quarantine, batch_id)
        else:
            good = df.select(F.parse_json("value").alias("record"))
        _write_batch(normalize(good), table, batch_id)

    return run(stream, checkpoint, apply)


def additive_dedup(stream: DataFrame, key: str, order: Sequence[str], table: str, checkpoint: str) -> StreamingQuery:
    """Appends the first row of each key the table lacks; the state is the table, not memory.

    The table is cut into shards by a prefix of the key's hash, each with a Bloom filter beside it (``<table>-filters``).
    A batch asks the filters first and reads only those shards in which one of its keys may stand, and of those only the key;
    a key no filter knows is new without a look at the table.  Filters that were lost are built again from their batches.
    """
    filters = f"{table}-filters"
    restore_filters(stream.sparkSession, stream.schema, key, table, filters)

    def apply(df: DataFrame, batch_id: int) -> None:
        fresh = first_of_group(df, [key], order, [c for c in df.columns if c != key])
        fresh = materialize(fresh.withColumn("shard", bloom.shard(F.col(key))), "fresh")
        if batch_id > 0:
            suspects = materialize(bloom.suspects(fresh, key, read_filters(df.sparkSession, filters, batch_id)), "suspects")
            known = suspects.join(pool_of(suspects, df.schema, key, table, batch_id), F.col(key).eqNullSafe(F.col("_known")), "left_semi").select(F.col(key).alias("_known"))
            fresh = fresh.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
        _write_shards(fresh, table, batch_id)
        _write_shards(bloom.words(fresh, key), filters, batch_id)

    return run(stream, checkpoint, apply)


def pool_of(suspects: DataFrame, schema: StructType, key: str, table: str, batch_id: int) -> DataFrame:
    """Keys (``_known``) of earlier batches in the shards of the suspects; other shards are not read."""
    shards = [r.shard for r in suspects.select("shard").distinct().collect()]  # at most ``bloom.SHARDS``
    pool = read_sharded(suspects.sparkSession, schema, table).where(F.col("shard").isin(shards) & (F.col("batch_id") < batch_id))
    return pool.select(F.col(key).alias("_known"))


def read_sharded(spark: SparkSession, schema: StructType, table: str) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("shard", IntegerType()), StructField("batch_id", LongType())])).parquet(table)


def read_filters(spark: SparkSession, filters: str, before: int | None = None) -> DataFrame:
    rows = read_sharded(spark, bloom.SCHEMA, filters)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def _write_shards(df: DataFrame, table: str, batch_id: int) -> None:
    """Rows of a batch below their shard; a repeated batch overwrites what it wrote before."""
    df.withColumn("batch_id", F.lit(batch_id).cast("long")).hint("rebalance", "shard").write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("shard", "batch_id").parquet(table)


def _batches_of(spark: SparkSession, schema: StructType, table: str) -> set[tuple[int, int]]:
    """(shard, batch) of a sharded table, from the names of its files; nothing is read."""
    try:
        files = read_sharded(spark, schema, table).inputFiles()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()  # nothing was written yet
    return {tuple(map(int, re.search(r"/shard=(\d+)/batch_id=(\d+)/", name).groups())) for name in files}


def restore_filters(spark: SparkSession, schema: StructType, key: str, table: str, filters: str) -> None:
    """Builds the filters of those batches of the table that have none, from the rows of these batches."""
    lost = _batches_of(spark, schema, table) - _batches_of(spark, bloom.SCHEMA, filters)
    for batch_id in sorted({batch for _, batch in lost}):
        shards = sorted(shard for shard, batch in lost if batch == batch_id)
        rows = read_sharded(spark, schema, table).where((F.col("batch_id") == batch_id) & F.col("shard").isin(shards))
        _write_shards(bloom.words(rows.drop("batch_id"), key), filters, batch_id)


class Unstable(RuntimeError):
    """The source did not stand still; nothing was accepted."""


def stability_gate(
    stream: DataFrame, inventory: Callable[[], DataFrame], table: str, receipts: str, checkpoint: str,
    key: str = "path", signature: str = "signature", passes: int = 6,
) -> StreamingQuery:
    """Accepts a batch only when the source inventory is the same before and after it was read.

    At most ``passes`` attempts.  A batch that never settles leaves a receipt and stops the query with
    :class:`Unstable` before its offsets are committed, so the next run is offered the same batch again.
    """
    from threadlake.operators.verify import inventory_guard

    def apply(df: DataFrame, batch_id: int) -> None:
        for attempt in range(1, passes + 1):
            before = materialize(inventory(), "inventory")
            staged = materialize(df, "staged")
            guard = inventory_guard(before, inventory(), key, signature).withColumn("attempt", F.lit(attempt))
            accepted = guard.first()["status"] == "complete"
            if accepted:
                _write_batch(staged, table, batch_id)
            if accepted or attempt == passes:
                _write_batch(guard, receipts, batch_id)
            if accepted:
                return
        raise Unstable(f"batch {batch_id}: the source kept changing while it was read {passes} times")

    return run(stream, checkpoint, apply)


class LastState(StatefulProcessor):
    """The last state of a key, kept in the state store: compares the first row of a batch with it.

    Rows (batch_id, seq, state, last) come once per key and batch, however many rows the key has there.  A batch that
    was seen already is passed over, so a repeated delivery changes nothing.
    """

    def init(self, handle) -> None:
        self.kept = handle.getValueState("last", "batch_id long, state string")

    def handleInputRows(self, key, rows, timerValues):
        batch, state = self.kept.get() or (-1, None)
        for row in sorted(rows, key=lambda r: r.batch_id):
            if row.batch_id <= batch:
                continue
            yield Row(key=key[0], seq=row.seq, state=row.state, previous=state)
            batch, state = row.batch_id, row.last
            self.kept.update((batch, state))

    def close(self) -> None:
        pass


def detect_changes(stream: DataFrame, table: str, edges: str, checkpoint: str, width: int = 65_536) -> StreamingQuery:
    """Appends change events of a stream (key, seq, state).

    Two steps, so that a hot key never is one task's work.  Inside a batch rows meet the row before them block by block;
    what is left of a key is one row with its first and last state (table ``edges``).  A second stream over these rows
    compares the first state with the key's last one of earlier batches, which lives in the state store: a batch
    reads and writes the state of its own keys only, whatever the number of keys and batches before it.

    Events lie below ``part=inside`` and ``part=edge`` of the table.  The first step is run to its end; the query that is returned is the second one.
    """
    spark = stream.sparkSession
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)

    def inside(df: DataFrame, batch_id: int) -> None:
        rows = df.select("key", "seq", "state")
        first = rows.groupBy("key").agg(
            F.min("seq").alias("seq"), F.min_by(F.struct("state"), "seq")["state"].alias("state"), F.max_by(F.struct("state"), "seq")["state"].alias("last"))
        _write_batch(first, edges, batch_id)
        compared = last_before(rows, ["key"], "seq", ["state"], "_before", width=width).where("_before is not null")
        _write_batch(change_events(compared.withColumn("_previous", F.col("_before.state"))), f"{table}/part=inside", batch_id)

    run(stream, f"{checkpoint}/inside", inside).awaitTermination()

    key_type = stream.schema["key"].dataType.simpleString()
    seen = spark.readStream.schema(f"key {key_type}, seq bigint, state string, last string, batch_id bigint").parquet(edges)
    compared = seen.groupBy("key").transformWithState(LastState(), f"key {key_type}, seq bigint, state string, previous string", "Append", "None")
    return run(compared, f"{checkpoint}/edges", lambda df, batch_id: _write_batch(
        change_events(df.withColumnRenamed("previous", "_previous")), f"{table}/part=edge", batch_id))


def change_events(compared: DataFrame) -> DataFrame:
    """Rows whose state differs from ``_previous``; without one the event is INITIAL_STATE."""
    previous = F.col("_previous")
    return compared.where(previous.isNull() | (F.col("state") != previous)).select(
        "key", "seq", "state", previous.alias("previous"),
        F.when(previous.isNull(), "INITIAL_STATE").otherwise("STATE_CHANGED").alias("event"))


def state_changes(rows: DataFrame, width: int = 65_536) -> DataFrame:
    """The same over a table: compare each row with the one before it."""
    compared = last_before(rows, ["key"], "seq", ["state"], "_before", width=width)
    return change_events(compared.withColumn("_previous", F.col("_before.state")))
