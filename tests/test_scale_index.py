"""What a worker holds of a delivery is bounded in words, not only in documents; what is stored of it is small."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from threadlake.operators import index
from threadlake.session import workspace


def test_blocks_are_bounded_in_words(monkeypatch):
    monkeypatch.setattr(index, "WORDS", 100)
    sizes = [30, 40, 30, 1, 500, 0, 0, 60, 60, None]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(sizes)), "words": [None if n is None else [f"w{i}" for i in range(n)] for n in sizes]},
                                       pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.string()))]))
    parts = list(index._parts(batch))
    assert [len(p) for p in parts] == [3, 1, 1, 3, 2] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(len(p) == 1 or len(p.column("words").flatten()) <= 100 for p in parts)
    monkeypatch.setattr(index, "BLOCK", 2)
    assert max(len(p) for p in index._parts(batch)) == 2


def test_ids_and_lengths_are_stored_once_a_block(spark):
    rows = [(f"document-{i}", "each has these words " * (1 + i % 3) + f"own{i}") for i in range(95)] + [("empty", None)]
    path = workspace(spark, "index")
    index.append(spark.createDataFrame(rows, "id string, text string").coalesce(1), "id", F.col("text"), path, 0)
    stored = index.read(spark, path, "string")
    assert sorted(x for r in stored.where("doc_ids is not null").collect() for x in r.doc_ids) == sorted(i for i, _ in rows)
    assert {r.shard for r in stored.where("term is null").collect()} == {index.SHARDS}
    terms = stored.where("term is not null").collect()
    assert len(terms) == 95 + 4 and all(r.doc_ids is None and r.lengths is None for r in terms)
    # a pair of bytes a document, a byte a place
    assert all(len(r.hits) == 2 * r.docs for r in terms) and sum(len(r.places) for r in terms) == sum(len((x or "").split()) for _, x in rows)
    assert [tuple(r) for r in spark.read.parquet(f"{path}/totals").select("documents", "tokens").collect()] == [(96, sum(len((x or "").split()) for _, x in rows))]


def test_an_appended_delivery_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = spark.createDataFrame([(i, "a b") for i in range(20)], "id long, text string").withColumn("text", counted.asNondeterministic()("text")).where("text != ''")
    index.append(rows, "id", F.col("text"), workspace(spark, "index"), 0)
    assert seen.value == 20


def test_a_repeated_delivery_leaves_nothing_of_the_first(spark):
    path = workspace(spark, "index")
    for rows in ([(1, "old words here"), (2, "same old")], [(2, "fresh")]):
        index.append(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"), path, 0)
    found = index.search(spark, path, [[("old",)], [("same", "old")], [("fresh",)]], 5, "bigint").collect()
    assert [(r.query_id, r.doc_id) for r in found] == [(2, 2)]


def test_packed_numbers():
    rows = [[0], [127, 128, 5], [16383, 16384, 2097151, 2097152], [2**28 - 1, 2**28, 2**31 - 1], [1] * 300]
    values, starts = np.array([x for r in rows for x in r]), np.cumsum([0] + [len(r) for r in rows[:-1]])
    packed = index._packed(values, starts)
    assert [len(x) for x in packed.to_pylist()] == [1, 4, 2 + 3 + 3 + 4, 4 + 5 + 5, 300]
    for at in range(len(rows)):
        got, sizes = index._unpacked(packed.slice(at))
        assert got.tolist() == [x for r in rows[at:] for x in r] and sizes.tolist() == [len(r) for r in rows[at:]]
    rising = np.array([3, 7, 7, 0, 2, 9])
    assert index._running(index._gaps(rising, np.array([0, 3])), np.array([3, 3])).tolist() == rising.tolist()
