"""Payloads of a walk are looked for once a value."""

from threadlake.functions import records as R
from threadlake.operators import nested as N


def test_payloads_are_found_once(spark):
    rows = spark.createDataFrame([(1, '{"payload":"QUJDREVGR0hJSktM TU5P","data":"short","x":"data:text/plain;base64,QUJD"}')], "id int, j string")
    found = N.deep_payloads(rows.select("id", R.parse("j").alias("record")), ["id"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?s)^[^,]*,(.*)$") == 1
    assert {(r["path"], r["base64"], r["mime_type"]) for r in found.collect()} == {("payload", "QUJDREVGR0hJSktMTU5P", None), ("x", "QUJD", "text/plain")}
