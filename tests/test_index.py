"""Stored index against a scan of the texts."""

import math
import random

import pytest

from threadlake.functions import text as T
from threadlake.operators import index
from threadlake.operators import search as K
from threadlake.session import workspace
from pyspark.sql import functions as F


def brute(docs, queries, limit):
    """docs: {id: [column texts]}"""
    words = {i: [T.split_folded(x or "") for x in columns] for i, columns in docs.items()}
    length = {i: sum(map(len, w)) for i, w in words.items()}
    average = sum(length.values()) / len(docs)
    count = lambda i, p: sum(w[k:k + len(p)] == list(p) for w in words[i] for k in range(len(w)))
    out = []
    for q, query in enumerate(queries):
        scores = dict.fromkeys(docs, 0.0)
        for p in set(K.query_phrases(query)):
            tf = {i: n for i in docs if (n := count(i, p))}
            idf = max(math.log((len(docs) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6) if tf else 0
            scores = {i: scores[i] + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length[i] / average)) for i, n in tf.items() if i in scores}
        best = sorted(((round(s, 6), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:limit]
        out.extend((q, i, s, n + 1) for n, (s, i) in enumerate(best))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_deliveries_against_a_scan(spark, monkeypatch, block):
    monkeypatch.setattr(index, "BLOCK", block)
    rng = random.Random(7)
    vocabulary = ["été", "Ete", "la", "de", "fox", "den", "rare", "x1", "straße", "ﬁn", "deux-trois"] + [f"w{i}" for i in range(40)]
    weights = [5, 5, 60, 60, 8, 8, 1, 3, 3, 3, 3] + [4] * 40
    docs = {i: [" ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 3, 8]))) or None, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 5, 60])))] for i in range(500)}
    docs[77][1] = "rare fox " * 3000
    path = workspace(spark, "index")
    for delivery in (0, 1, 2, 1):
        rows = [(i, a, b) for i, (a, b) in docs.items() if i % 3 == delivery]
        index.append(spark.createDataFrame(rows, "id long, a string, b string").repartition(2, "id"), "id", [F.col("a"), F.col("b")], path, delivery)
    queries = ["rare", "la de", "de_la", "ETE fox", "fin", "deux-trois w1", "missing", "la missing", "la la", "de-de-la", "w3 w4"]
    got = index.search(spark, path, [K.query_phrases(q) for q in queries], 7, "bigint").collect()
    assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in got) == sorted(brute(docs, queries, 7))


def test_search_opens_only_the_blocks_it_needs(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 10)
    rows = [(i, "common " + ("fox " if i % 100 == 3 else "") + "pad " * (1 + i % 37)) for i in range(1000)]
    path = workspace(spark, "index")
    index.append(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", F.col("text"), path, 0)
    found = index.search(spark, path, [[("common",), ("fox",)]], 3, "bigint")
    text = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [x for x in text.splitlines() if "PartitionFilters" in x]
    assert scans and all("shard" in x for x in scans if "term" in x or "shard" in x)
    assert "In(term, [common,fox])" in text
    # places are not read for phrases of one word
    assert all("places" not in x for x in text.splitlines() if "ReadSchema" in x and "max_tf" not in x and "doc_ids" in x)
    docs = {i: [x] for i, x in rows}
    assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect()) == sorted(brute(docs, ["common fox"], 3))


def test_empty_deliveries(spark):
    path = workspace(spark, "index")
    empty = spark.createDataFrame([], "id string, text string")
    index.append(empty, "id", F.col("text"), path, 0)
    index.append(spark.createDataFrame([("a", None), ("b", "!")], "id string, text string"), "id", F.col("text"), path, 1)
    assert index.search(spark, path, [[("x",)]], 5).count() == 0
    index.append(spark.createDataFrame([("c", "x y")], "id string, text string"), "id", F.col("text"), path, 2)
    assert [r.doc_id for r in index.search(spark, path, [[("x", "y")], [("y", "x")]], 5).collect()] == ["c"]


def test_marked_phrases():
    assert T.marked("Un CAFÉ, le\tDE la", [("cafe",), ("le", "de")], 18) == "Un [CAFÉ], [le\tDE] la"
    assert T.marked("café noir", [("cafe",)], 18) == "[café] noir"
    assert T.marked("a b c d e f g h", [("g",)], 4) == "…f [g] h" and T.marked("", [("a",)], 4) == "" and T.marked("?!", [("a",)], 4) == "?!"
    assert T.marked("a " * 30, [("a", "a")], 3).count("[") == 2
