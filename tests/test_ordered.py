"""Block-wise ordered operators against brute force, with blocks far smaller than a group."""

import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators import ordered as O
from threadlake.operators import paging as B
from threadlake.operators.digests import global_rank, ordered_digest


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(7)
    # one group holds a third of all rows; ordinals have gaps
    rows = [("hot", n * 3, rng.choice("ua")) for n in range(200)] + [
        (f"k{n % 40}", n, rng.choice("ua")) for n in range(400)]
    return rows, spark.createDataFrame(rows, "k string, n bigint, role string")


@pytest.mark.parametrize("width", [1, 4, 50, 65_536])
def test_last_before(table, width):
    rows, df = table
    got = {(r.k, r.n): r.p and r.p.n for r in O.last_before(df, ["k"], "n", ["n"], "p", F.col("role") == "u", width).collect()}
    for k, n, _ in rows:
        earlier = [m for j, m, role in rows if j == k and m < n and role == "u"]
        assert got[k, n] == (max(earlier) if earlier else None)


@pytest.mark.parametrize("width", [1, 7, 65_536])
def test_next_after_and_position(table, width):
    rows, df = table
    after = {(r.k, r.n): r.p and r.p.n for r in O.next_after(df, ["k"], "n", ["n"], "p", None, width).collect()}
    place = {(r.k, r.n): r.at for r in O.position(df, ["k"], "n", "at", width).collect()}
    for k, n, _ in rows:
        later = [m for j, m, _ in rows if j == k and m > n]
        assert after[k, n] == (min(later) if later else None)
        assert place[k, n] == sum(1 for j, m, _ in rows if j == k and m < n)


def test_first_and_last_of_group(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, n int, v string")
    assert rows(O.first_of_group(df, ["k"], ["n"], ["n", "v"])) == [("a", 1, "y"), ("b", 5, None)]
    assert rows(O.last_of_group(df, ["k"], ["n"], ["v"])) == [("a", "x"), ("b", None)]


def greedy_pages(sizes, max_rows, max_bytes):
    pages, page, held, total = [], 0, 0, 0
    for size in sizes:
        if held and (held >= max_rows or total + size > max_bytes):
            page, held, total = page + 1, 0, 0
        pages.append(page)
        held, total = held + 1, total + size
    return pages


@pytest.mark.parametrize("block_rows,max_rows,max_bytes", [(5, 5, 100), (8, 3, 60), (16, 10, 45), (1 << 20, 10, 45)])
def test_pages(spark, monkeypatch, block_rows, max_rows, max_bytes):
    monkeypatch.setattr(B, "SECTION", 3)
    rng = random.Random(block_rows)
    # sizes include rows larger than a page and empty rows
    data = [("s%d" % (n % 3 if n % 2 else 0), n, rng.choice([0, None, 1, 10, 20, 30, 44, 200])) for n in range(240)]
    df = spark.createDataFrame(data, "store string, n bigint, size bigint")
    got = {(r.store, r.n): r.page for r in B.pages(df, "store", "n", "size", max_rows, max_bytes, block_rows).collect()}
    for store in {s for s, _, _ in data}:
        own = [(n, size) for s, n, size in data if s == store]
        want = greedy_pages([size or 0 for _, size in own], max_rows, max_bytes)
        assert [got[store, n] for n, _ in own] == want


def test_oversize_record_is_a_page_of_its_own(spark):
    df = spark.createDataFrame([("s", 0, 500), ("s", 1, 0), ("s", 2, 5)], "store string, n bigint, size bigint")
    pages = {r.n: r.page for r in B.pages(df, "store", "n", "size", 10, 100, 10).collect()}
    assert pages == {0: 0, 1: 1, 2: 1}


def greedy(items, max_items, max_bytes):
    chosen, left = set(), max_bytes
    for key, size in sorted(items):
        if len(chosen) < max_items and size is not None and size <= left:
            chosen.add(key)
            left -= size
    return chosen


@pytest.mark.parametrize("seed", range(3))
def test_bounded_batch_against_one_by_one(spark, seed):
    rng = random.Random(seed)
    size = lambda: rng.choice([None, 0, 1, rng.randint(0, 9), rng.randint(0, 100), rng.randint(0, 4000), 2 ** rng.randint(0, 11), 1 << 40])
    items = [(f"k{i:05d}", size()) for i in rng.sample(range(9999), 700)]
    frame = spark.createDataFrame(items, "key string, size long").repartition(3)
    for max_items, max_bytes in ((1_000_000, rng.randint(0, 30_000)), (rng.randint(1, 200), 1 << 62), (rng.randint(0, 60), 4096), (50, 0)):
        got = {r.key for r in B.bounded_batch(frame, "key", "size", max_items, max_bytes, block_rows=rng.choice([40, 1 << 18])).where("selected").collect()}
        assert got == greedy(items, max_items, max_bytes), (max_items, max_bytes)


def test_bounded_batch_takes_no_list_of_keys(spark):
    items = spark.range(20_000).selectExpr("id", "case when id % 2 = 0 then 1L << 50 else id % 17 end as size")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("batch", "batch")
    chosen = B.bounded_batch(items, "id", "size", 1_000_000, 60_000, block_rows=1_000)
    spark.sparkContext.setJobGroup("later", "later")
    assert len(jobs.getJobIdsForGroup("batch")) < 200
    assert chosen._jdf.queryExecution().optimizedPlan().toString().count(" IN ") + chosen._jdf.queryExecution().optimizedPlan().toString().count("INSET") == 0
    taken = chosen.where("selected").agg(F.sum("size"), F.count("*")).first()
    assert taken[0] <= 60_000 and taken[1] == len(greedy([(r.id, r.size) for r in items.collect()], 1_000_000, 60_000))


def test_bounded_batch_passes_over_large_items(spark):
    df = spark.createDataFrame([("a", 60), ("b", 50), ("c", 30), ("d", 20), ("e", 10)], "path string, size bigint")
    batch = lambda items, files, limit: {r.path for r in B.bounded_batch(items, "path", "size", files, limit).where("selected").collect()}
    assert batch(df, 10, 100) == {"a", "c", "e"}  # b does not fit, c does, d does not, e does
    assert batch(df, 1, 1000) == {"a"}
    assert batch(df, 5, 5) == set()


def test_repeated_batches_finish(spark):
    items = spark.createDataFrame([("a", 1), ("b", 1)], "path string, size bigint")
    first = B.bounded_batch(items, "path", "size", 1, 10)
    rest = first.where("not selected").drop("selected")
    second = B.bounded_batch(rest, "path", "size", 1, 10)
    assert [r.path for r in second.where("selected").collect()] == ["b"]
    assert second.where("not selected").count() == 0


def test_ordered_digest_sees_order_and_edits(spark):
    def digest(values):
        df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, n bigint, v string")
        return ordered_digest(df, ["s"], "n", "v", fanout=2).first()["digest"]

    base = digest(list("abcdefghij"))
    assert base == digest(list("abcdefghij"))
    assert base != digest(list("bacdefghij")) and base != digest(list("abcdefghiX"))


def test_global_rank(spark):
    values = random.Random(3).sample(range(1000), 300)
    df = spark.createDataFrame([(v,) for v in values], "v int")
    ranks = {r.v: r.at for r in global_rank(df, [F.col("v").desc()], "at").collect()}
    assert ranks == {v: i + 1 for i, v in enumerate(sorted(values, reverse=True))}
