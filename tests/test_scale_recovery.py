"""An import meets the known keys in one aggregation, and tasks are bounded in bytes."""

from threadlake.operators import merge as X
from threadlake.session import TASK_BYTES, configure


def test_keys_of_an_import_are_not_joined(spark):
    known = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    incoming = spark.createDataFrame([(1, "a"), (2, "c"), (2, "b"), (None, "n"), (3, None)], "id int, body string")
    added = X.recover_messages(known.selectExpr("cast(id as bigint) as id"), incoming, ["id"], ["body"])
    plan = added._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert added.schema["id"].dataType == incoming.schema["id"].dataType
    assert sorted(map(tuple, added.collect()), key=repr) == [(2, "b"), (3, None), (None, "n")]


def test_tasks_are_bounded_and_smaller_bounds_kept(spark):
    names, before = list(TASK_BYTES), {k: spark.conf.get(k) for k in TASK_BYTES}
    try:
        spark.conf.set(names[0], "64MB")
        spark.conf.set(names[1], "8m")
        configure(spark)
        assert spark.conf.get(names[0]) == str(16 << 20) and spark.conf.get(names[1]) == "8m"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
