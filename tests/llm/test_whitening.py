"""Whitening against sums in whole numbers and fractions."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from threadlake.llm import whitening
from threadlake.llm.queries import QUERIES
from threadlake.llm.whitening import covariances, means, usable, whiten
from pyspark.sql import functions as F


def exact(rows):
    """(n, sums, covariance in fractions) of whole vectors."""
    n, size = len(rows), len(rows[0])
    sums = [sum(x[d] for x in rows) for d in range(size)]
    away = [[n * x[d] - sums[d] for d in range(size)] for x in rows]
    return n, sums, [[Fraction(sum(a[i] * a[j] for a in away), n ** 3) for j in range(size)] for i in range(size)]


def as_whole(vector):
    return [floor(1024 * Fraction(float(c))) + 100_000 for c in vector]


def check(vectors, got, wanted=8):
    """vectors: [(id, vector)] of one length; got: rows of ``whiten``."""
    rows = [as_whole(v) for _, v in vectors]
    n, sums, matrix = exact(rows)
    covariance = np.array([[float(x) for x in r] for r in matrix])
    value, vector = np.linalg.eigh(covariance)
    order = np.argsort(-value)[:wanted]
    value, vector = value[order], vector[:, order]
    trace = float(sum(matrix[i][i] for i in range(len(sums))))
    assert len(got) == n * len(value)
    for k in range(len(value)):
        mine = sorted([r for r in got if r.component == k + 1], key=lambda r: r.id)
        assert [r.id for r in mine] == sorted(i for i, _ in vectors)
        expected = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for _, x in sorted(zip([i for i, _ in vectors], rows))]) @ vector[:, k] / np.sqrt(value[k])
        have = np.array([r.whitened for r in mine])
        assert min(np.abs(have - expected).max(), np.abs(have + expected).max()) < 1e-6
        assert all(r.explained == pytest.approx(value[k] / trace, rel=1e-9) for r in mine)
    by_id = dict(zip([i for i, _ in vectors], rows))
    for r in got:
        assert r.n == n and int(r.deviation) == sum((n * c - s) ** 2 for c, s in zip(by_id[r.id], sums))
        assert 0 <= r.identity_error < 1e-8


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")


def test_against_fractions(spark):
    rng = np.random.default_rng(1)
    mixing = rng.normal(size=(12, 12))
    rows = [(i, (rng.normal(size=12) @ mixing).tolist(), 0) for i in range(300)]
    check([(i, v) for i, v, _ in rows], whiten(frame(spark, rows)).collect())


def test_covariance_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=5) * [1, 1e-3, 50, 1e9, 1]).tolist(), 0) for i in range(200)]
    df = frame(spark, rows).select(F.col("embedding").alias("vector")).where(usable(F.col("vector"))).withColumn("size", F.size("vector"))
    sums = means(df)
    n, total, matrix = exact([as_whole(v) for _, v, _ in rows])
    assert sums == {5: (n, total)}
    got = covariances(df, sums)[5]
    assert all(got[i, j] == float(matrix[i][j]) for i in range(5) for j in range(5))


def test_lengths_ranks_and_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    three = [(i, rng.normal(size=3).tolist(), 1) for i in range(20)] + [(20, [0.0, 0.0, 0.0], 1)]
    two = [(100 + i, [float(i), 2.0 * i], 1) for i in range(9)]  # one direction only
    rest = [
        (200, None, 1), (201, [1.0, None, 2.0], 1), (202, [nan, 1.0, 1.0], 1), (203, [1.0, inf, 1.0], 1), (204, [], 1), (205, [1.0] * 4, 1), (206, [3.0], 1), (207, [3.0], 1)]
    got = whiten(frame(spark, three + two + rest)).collect()
    check([(i, v) for i, v, _ in three], [r for r in got if r.id < 100], 3)
    check([(i, v) for i, v, _ in two], [r for r in got if 100 <= r.id < 200], 1)
    assert not [r for r in got if r.id >= 200]  # one vector, or equal ones, have no component
    assert whiten(frame(spark, three).limit(0)).count() == 0


def test_repeats_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [0.0, 4.0], 0), (2, [2.0, 1.0], 0)]
    got = whiten(frame(spark, rows)).collect()
    assert len(got) == 8 and {r.n for r in got} == {4}
    assert sorted((r.id or 0) for r in got) == [0, 0, 1, 1, 1, 1, 2, 2]


def test_huge_entries(spark):
    rows = [(i, [x, float(i)], 0) for i, x in enumerate([1e300, -1e300, 1e12, 0.0, 5.0])]
    got = whiten(frame(spark, rows)).collect()
    assert {r.n for r in got} == {5} and all(np.isfinite(r.whitened) for r in got) and all(r.identity_error < 1e-4 for r in got)
    held = [[min(max(floor(1024 * Fraction(c)), -2 ** 47), 2 ** 47) + 100_000 for c in v] for _, v, _ in rows]
    n, sums, _ = exact(held)
    want = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in held]
    assert [int(r.deviation) for r in sorted(got, key=lambda r: r.id) if r.component == 1] == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    df = QUERIES["op13_whitening"](spark, sf)
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    check(vectors, df.withColumnRenamed("vec_id", "id").collect())
