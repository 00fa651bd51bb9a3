"""Pivot-permutation index against all pairs: nothing below the threshold, and the share of links found."""

import numpy as np
import pytest

from threadlake.llm import pivot_index
from threadlake.llm.pivot_index import near_duplicates
from threadlake.llm.queries import QUERIES


def brute(rows, threshold=0.93):
    links = {}
    for i, (a, x, l) in enumerate(rows):
        for b, y, m in rows[:i]:
            if l == m and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links.setdefault(a, set()).add(b)
                links.setdefault(b, set()).add(a)
    return links


@pytest.mark.parametrize("block", [1024, 20])
def test_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(40):
        centre = rng.normal(size=24)
        for _ in range(rng.choice([1, 2, 5, 60])):
            rows.append((len(rows), (centre + rng.normal(size=24) * rng.choice([0.02, 0.15, 0.25])) * rng.uniform(0.1, 9), int(c % 3)))
    df = spark.createDataFrame([(i, [float(v) for v in x], l, "p") for i, x, l in rows], "vec_id long, embedding array<double>, label int, near string")
    got = {r["id"]: r for r in near_duplicates(df).collect()}
    want = brute(rows)
    found = sum(r.n_links for r in got.values())
    there = sum(map(len, want.values()))
    assert all(r.n_links <= len(want.get(i, ())) for i, r in got.items())
    assert found >= 0.97 * there
    assert all(r.kept == (r.component_id == i) and r.component_id <= i for i, r in got.items())


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r.vec_id: r.n_links for r in QUERIES["op6_embedding_dedup"](spark, sf).collect()}
    assert sum(got.values()) >= 0.99 * sum(map(len, want.values()))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.01], 0), (2, [2.0, 0.01], 0), (3, [1.0, 0.0], 1), (4, None, 0), (5, [0.0, 0.0], 0), (6, [1.0, None], 0),
        (7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1e-200, 0.0], 0), (12, [], 0), (13, [1e200, 1.0], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["id"] or 0), r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect())
    linked = {1: (3, 1), 2: (3, 1), 11: (3, 1), 13: (3, 1)}
    want = sorted((i or 0, *linked.get(i, (0, i)), i is None or linked.get(i, (0, i))[1] == i) for i, _, _ in rows)
    assert got == want
    assert near_duplicates(df.limit(0)).count() == 0


def test_recall_of_planted_copies(spark):
    """64 dimensions, copies with cosines just above the threshold, one cluster with a third of the rows."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x)
    rows = []
    for size in [700] + [2] * 400 + [5] * 120:
        centre = unit(rng.normal(size=64))
        for i in range(size):
            away = rng.normal(size=64)
            cosine = rng.uniform(0.965, 0.99) if size > 2 else rng.uniform(0.931, 0.95) if i else 1.0
            rows.append((len(rows), cosine * centre + np.sqrt(1 - cosine ** 2) * unit(away - (away @ centre) * centre), 0))
    x = np.stack([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    alike = x @ x.T >= 0.93
    want = alike.sum(axis=1) - 1
    pairs = sum(alike[700 + 2 * k, 701 + 2 * k] for k in range(400))
    df = spark.createDataFrame([(i, [float(a) for a in v], l) for i, v, l in rows], "vec_id long, embedding array<double>, label int")
    got = {r["id"]: r.n_links for r in near_duplicates(df).collect()}
    found, there = sum(got.values()), int(want.sum())
    lone = sum(got[700 + 2 * k] > 0 for k in range(400))
    print(f"links {found} of {there}, pairs {lone} of {pairs}")
    assert pairs == 400 and there > 10_000
    assert found >= 0.97 * there and lone >= 0.97 * pairs
