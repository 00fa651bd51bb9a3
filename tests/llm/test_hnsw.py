"""Graphs of shards against all pairs."""

import numpy as np
import pytest

from threadlake.llm import hnsw
from threadlake.llm.hnsw import nearest_neighbours
from threadlake.llm.queries import QUERIES
from pyspark.sql import functions as F


def brute(rows, asked, k):
    """rows: {id: vector}; {query: [(id, score)]}."""
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    out = {}
    for q in asked:
        far = np.sqrt(((x - rows[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(int(i), [float(v) for v in x], 0) for i, x in rows.items()], "vec_id long, embedding array<double>, query_id int")


def recall(got, want):
    # an answer as near as the last true one is right too
    hit = sum(sum(s <= want[q][-1][1] for _, s in got[q]) for q in want)
    return hit / sum(map(len, want.values()))


@pytest.mark.parametrize("shard_rows", [400, 5000])
def test_recall(spark, monkeypatch, shard_rows):
    """Clusters of any density, one with a third of the rows, one vector that stands many times, several shards."""
    monkeypatch.setattr(hnsw.build_index, "__defaults__", (shard_rows,))
    rng = np.random.default_rng(2)
    rows = {}
    for size in [900, 400] + [1] * 600 + [4] * 200:
        centre = rng.normal(size=32)
        for _ in range(size):
            rows[len(rows)] = centre + rng.normal(size=32) * (rng.choice([0.01, 0.2]) if size != 400 else 0)
    asked = [i for i in rows if i % 10 == 0]
    want = brute(rows, asked, 10)
    got = answers(nearest_neighbours(frame(spark, rows), F.col("id") % 10 == 0))
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert recall(got, want) >= 0.97
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (x[1], x[0])) and len({i for i, _ in found}) == 10 and q not in dict(found)
        assert all(s == pytest.approx(np.linalg.norm(rows[i] - rows[q]), rel=1e-12) for i, s in found)
    # copies: all at distance 0, so the smallest ids
    for q in [i for i in asked if 900 <= i < 1300]:
        assert got[q] == want[q]


def test_graph_layers():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    levels = np.sort(hnsw._levels(np.arange(1500)))[::-1]
    layers = hnsw.build(x, levels)
    assert len(layers) == levels.max() + 1 and len(layers) > 1
    for level, links in enumerate(layers):
        assert links.shape == ((levels >= level).sum(), hnsw.LINKS * (1 if level else 2))
        assert links.max() < len(links)
        for i, row in enumerate(links):
            row = row[row >= 0]
            assert i not in row and len(set(row.tolist())) == len(row)
    # every node of the lowest layer is reached from the entry
    seen, edge = {0}, [0]
    while edge:
        edge = list({int(j) for i in edge for j in layers[0][i] if j >= 0} - seen)
        seen |= set(edge)
    assert len(seen) >= 1498


def test_few_candidates(spark):
    rows = {i: np.array([float(i), 1.0]) for i in range(4)}
    got = answers(nearest_neighbours(frame(spark, rows), F.col("id") >= 0))
    assert got == brute(rows, list(rows), 10) and all(len(x) == 3 for x in got.values())
    assert answers(nearest_neighbours(frame(spark, {7: np.ones(3)}), F.lit(True))) == {}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, -1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1),
        (None, [1.0, 0.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [], 1), (10, [1.0, 0.0], 1), (10, [1.0, 0.0], 1), (11, [9.0, 9.0], 1), (11, [5.0, 0.0], 1), (12, [1e200, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = answers(nearest_neighbours(df, F.col("id").isin(0, 3, 4, 5, 6, 7, 8, 9, 10)))
    want = brute({0: np.array([1.0, 0.0]), 1: np.array([1.0, 1.0]), 2: np.array([1.0, -1.0]), 10: np.array([1.0, 0.0]), 11: np.array([5.0, 0.0]), 12: np.array([1e200, 0.0])}, [0, 10], 10)
    assert got == want  # 8 and 9 have no vector of their length beside them
    assert answers(nearest_neighbours(df.limit(0), F.lit(True))) == {}


def test_query_recall(spark):
    """The registered query on the largest local table."""
    sf = "/root/testdata/sf0.1"
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = brute(rows, [i for i in rows if i % 100 == 0], 10)
    got = answers(QUERIES["op12_nearest_neighbours"](spark, sf).withColumnRenamed("vec_id", "id"))
    assert set(got) == set(want)
    assert recall(got, want) >= 0.99
