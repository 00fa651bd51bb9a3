"""State of streams: what a batch reads and writes, restarts, lost files."""

import os
import shutil
import tempfile

import pytest

from threadlake.operators import bloom
from threadlake.session import workspace
from threadlake.streaming import ingest as T
from pyspark.sql import functions as F


def append(spark, rows, schema, source):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)


def test_change_state_is_that_of_the_batch(spark):
    """After many keys a batch of two keys updates two; every delivery restarts the query from its checkpoint."""
    base = workspace(spark, "state")
    schema = "key string, seq bigint, state string"
    deliveries = [[(f"k{i}", i, "a") for i in range(500)], [("k3", 500, "b"), ("k3", 501, "b"), ("new", 502, "a")], [("k3", 503, "b"), ("k4", 504, None), ("k4", 505, "z")]]
    updated = []
    for rows in deliveries:
        append(spark, rows, schema, f"{base}/source")
        query = T.detect_changes(spark.readStream.schema(schema).parquet(f"{base}/source"), f"{base}/events", f"{base}/edges", f"{base}/cp")
        query.awaitTermination()
        operators = [o for p in query.recentProgress for o in p.stateOperators]
        updated.append((sum(o.numRowsUpdated for o in operators), max(o.numRowsTotal for o in operators)))
    assert updated[0][1] == 500 and updated[-1][1] == 501
    assert updated[1][0] <= 4 and updated[2][0] <= 4
    got = sorted((r.seq, r.key, r.state, r.previous, r.event) for r in spark.read.parquet(f"{base}/events").where("seq >= 500").collect())
    assert got == [(500, "k3", "b", "a", "STATE_CHANGED"), (502, "new", "a", None, "INITIAL_STATE"), (505, "k4", "z", None, "INITIAL_STATE")]
    whole = spark.createDataFrame(sum(deliveries, []), schema)
    assert sorted(map(tuple, T.state_changes(whole).collect()), key=repr) == sorted(
        map(tuple, spark.read.parquet(f"{base}/events").drop("part", "batch_id").collect()), key=repr)


def test_a_repeated_batch_changes_nothing():
    kept = {}

    class Handle:
        def getValueState(self, name, schema):
            class Value:
                get = staticmethod(lambda: kept.get("v"))
                update = staticmethod(lambda v: kept.__setitem__("v", v))
            return Value

    from pyspark.sql import Row
    processor = T.LastState()
    processor.init(Handle())
    rows = [Row(batch_id=1, seq=7, state="b", last="c"), Row(batch_id=0, seq=1, state="a", last="a")]
    assert [(r.seq, r.previous) for r in processor.handleInputRows(("k",), rows, None)] == [(1, None), (7, "a")]
    assert list(processor.handleInputRows(("k",), rows, None)) == []
    assert [(r.seq, r.previous) for r in processor.handleInputRows(("k",), [Row(batch_id=2, seq=9, state="c", last="d")], None)] == [(9, "c")]


SCHEMA = "key string, at bigint, body string"


def deliver(spark, base, rows):
    append(spark, rows, SCHEMA, f"{base}/source")
    T.additive_dedup(spark.readStream.schema(SCHEMA).parquet(f"{base}/source"), "key", ["at"], f"{base}/pool", f"{base}/cp").awaitTermination()


def pool(spark, base):
    return sorted(((r.key, r.at, r.body) for r in spark.read.parquet(f"{base}/pool").collect()), key=repr)


def test_dedup_over_deliveries_and_lost_filters(spark):
    base = workspace(spark, "dedup")
    first = [(f"k{i}", i, "x") for i in range(300)]
    deliver(spark, base, [*first, ("k1", 400, "later"), (None, 401, "n")])
    deliver(spark, base, [("k1", 500, "y"), ("k299", 501, "y"), ("new", 502, "y"), ("new", 503, "y"), (None, 504, "y")])
    expected = sorted([*first, (None, 401, "n"), ("new", 502, "y")], key=repr)
    assert pool(spark, base) == expected
    whole = lambda: sorted(map(tuple, T.read_filters(spark, f"{base}/pool-filters").collect()))
    filters = whole()
    # the filters of one shard, then all of them, are lost: built again from the shards before the next batch
    some = sorted(x for x in os.listdir(f"{base}/pool-filters") if x.startswith("shard="))
    assert len(some) == bloom.SHARDS
    aside = tempfile.mkdtemp(prefix="lost-")
    shutil.move(f"{base}/pool-filters/{some[0]}", aside)
    deliver(spark, base, [("k2", 600, "z")])
    assert pool(spark, base) == expected and whole() == filters
    shutil.move(f"{base}/pool-filters", aside)
    deliver(spark, base, [("k3", 700, "z"), ("other", 701, "z")])
    assert pool(spark, base) == sorted([*expected, ("other", 701, "z")], key=repr)
    assert set(filters) <= set(whole())


def test_a_batch_reads_the_shards_of_its_suspects(spark):
    base = workspace(spark, "shards")
    deliver(spark, base, [(f"k{i}", i, "x") for i in range(400)])
    rows = spark.createDataFrame([("k5", 1, "x"), ("k77", 2, "x"), *((f"never{i}", i, "x") for i in range(200))], SCHEMA).withColumn("shard", bloom.shard(F.col("key")))
    suspects = bloom.suspects(rows, "key", T.read_filters(spark, f"{base}/pool-filters", 1))
    found = {r.key for r in suspects.collect()}
    assert {"k5", "k77"} <= found and len(found) < 10
    plan = T.pool_of(suspects, spark.createDataFrame([], SCHEMA).schema, "key", f"{base}/pool", 1)
    text = plan._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    line = next(x for x in text.splitlines() if "PartitionFilters" in x)
    assert "shard" in line and "batch_id" in line and "ReadSchema: struct<key:string>" in text
    assert plan.select(F.input_file_name()).distinct().count() <= len(found)


def test_first_batches_without_rows(spark):
    base = workspace(spark, "empty")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/source")
    deliver(spark, base, [])
    deliver(spark, base, [("a", 1, "x")])
    deliver(spark, base, [("a", 2, "x"), ("b", 3, "x")])
    assert pool(spark, base) == [("a", 1, "x"), ("b", 3, "x")]


@pytest.mark.parametrize("count", [1, 5000])
def test_bloom_has_no_false_negatives(spark, count):
    keys = spark.range(count).select(F.concat(F.lit("x"), "id").alias("key")).withColumn("shard", bloom.shard(F.col("key")))
    other = spark.range(5000).select(F.concat(F.lit("y"), "id").alias("key")).withColumn("shard", bloom.shard(F.col("key")))
    filters = bloom.words(keys, "key")
    twice = filters.unionByName(filters)
    assert bloom.suspects(keys, "key", twice).count() == count
    assert bloom.suspects(other, "key", twice).count() < 50
