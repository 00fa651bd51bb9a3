"""Records of one store are not brought together to look up what was seen."""

from threadlake.operators import materialize as L


def test_unseen_records_are_not_shuffled(spark):
    records = spark.createDataFrame([("s", 1, 1), ("s", 2, 2), (None, 1, 3)], "store string, capture bigint, line bigint")
    left = L.unseen(records, spark.createDataFrame([(1, "s")], "capture bigint, store string"))
    assert "Exchange hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["line"] for r in left.collect()) == [2, 3]
