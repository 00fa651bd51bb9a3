"""Nothing is cut: deep records, long digit runs, other alphabets, numbers of any size."""

import json

from pyspark.sql import functions as F

from threadlake.functions import records as R
from threadlake.functions import scalars as S
from threadlake.operators import content as C
from threadlake.operators import nested as N
from threadlake.operators import rollups as U


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def nest(value, levels, key="text"):
    for i in range(levels):
        value = {key: value} if i % 2 else [value]
    return value


def test_text_at_any_depth(spark):
    cases = {
        json.dumps(nest("in", 6)): "in", json.dumps(nest("in", 300)): "in", json.dumps({"text": {"text": {"text": {"text": {"text": {"text": "six"}}}}}}): "six",
        json.dumps([["a", [["b", []]], {"content": [["c"], {"value": "d"}]}], None, 3, {"x": 1}, "e"]): "a\nb\nc\nd\ne",
        json.dumps([{"text": None, "content": [[[[["f"]]]]]}]): "f",
    }
    df = spark.createDataFrame([(j,) for j in cases], "j string").withColumn("v", R.parse("j"))
    assert {r.j: r.x for r in df.select("j", R.readable_text("v").alias("x")).collect()} == cases
    items = json.dumps([{"type": "message", "content": nest("deep", 9)}, {"type": "reasoning", "content": nest("no", 9)}, {"type": "message", "content": ["x"]}])
    got = spark.createDataFrame([(items,)], "j string").withColumn("v", R.parse("j")).select(R.response_text("v")).first()[0]
    assert got == "deep\n\nx"


def test_no_credential_leaves_at_any_depth(spark):
    inner = {"private-key": {"a": ["s3cret", {"b": "s3cret"}]}, "ok": 1.50, "none": [], "many": {str(i): i for i in range(80)}}
    record = json.dumps({"password": ["s3cret"], "deep": nest(inner, 14, "k"), "secret": "s3cret", "Refresh_Token": {}})
    df = spark.createDataFrame([(1, record)], "id int, j string").withColumn("record", R.parse("j"))
    rows = N.redacted_fields(df, ["id"]).collect()
    assert "s3cret" not in repr(rows)
    assert sorted(r.path.split(".")[-1] for r in rows if r.redacted) == ["Refresh_Token", "password", "private-key", "secret"]
    by_end = {".".join(r.path.split(".")[-2:]): r.value for r in rows if not r.redacted}
    assert by_end["many.79"] == "79" and sum(k.startswith("many.") for k in by_end) == 80
    assert any(k.endswith(".ok") and float(v) == 1.5 for k, v in by_end.items()) and any(k.endswith(".none") and v == "[]" for k, v in by_end.items())


def test_native_and_deep_rows_agree(spark):
    record = json.dumps({"a": [{"b": [1, "x", None, True, {"c": {"d": ["https://h/a.png", 2.5]}}]}], "e": nest({"u": "https://h/b.png"}, 9, "q")})
    df = spark.createDataFrame([(1, record)], "id int, j string").withColumn("record", R.parse("j"))
    shown = lambda rows: sorted((r.path, r.hint, tuple(r.trail), r.depth, r.v) for r in rows.withColumn("v", F.to_json("value")).drop("value").collect())
    assert shown(N.walk(df, ["id"], "record")) == shown(N.walk(df, ["id"], "record", 24))
    assert {r.url for r in N.deep_references(df, ["id"]).collect()} == {"https://h/a.png", "https://h/b.png"}


def test_natural_order_of_long_numbers(spark):
    names = ["img-2", "img-10", "IMG-002a", "img-1700000000123", "img-9700000000122", "img-97000000001220", "img", "img-0", "a10b2", "a10b10"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(S.natural_key(F.col("n")), "n").collect()]
    assert got == ["a10b2", "a10b10", "img", "img-0", "img-2", "IMG-002a", "img-10", "img-1700000000123", "img-9700000000122", "img-97000000001220"]


def test_folded_letters(spark):
    assert one(spark, S.slug(F.col("t")), t="Őrült ... āble ﬁne Ⅳ") == "orult-able-fine-iv"
    assert one(spark, S.slug(F.col("t")), t="plain Title") == "plain-title"


def test_payload_numbers(spark):
    for text, want in (('[1.5,"a",300,-1,null,true,[2],"7"]', bytes([1, 0, 44, 255, 0, 1, 0, 7])), ('{"1":"x","0":5,"99999999999":2.9}', bytes([5, 0, 2]))):
        got = spark.createDataFrame([(text,)], "j string").select(C.decode_payload(R.parse("j")).alias("b")).first()["b"]
        assert bytes(got) == want, text


def test_versions_of_any_size(spark):
    for version, want in (("99999999999.0.0", "unsupported-newer"), ("0.99999999999.5", "migration-required"), ("01.00.0", "current"), ("1.0", "invalid")):
        assert one(spark, S.schema_compatibility(F.col("t")), t=version) == want


def test_limits_are_the_callers(spark):
    rows = spark.range(500).select("id", F.lit(1).alias("updated_ms"), F.lit(1).alias("created_ms"), F.lit("t").alias("title"))
    rows = rows.withColumns({"message_count": F.lit(0), "media_count": F.lit(0)})
    assert U.list_conversations(rows, limit=450).count() == 450


def test_jpeg_segments():
    frame = lambda code: bytes([0xFF, code, 0, 8, 8, 0, 2, 0, 3, 1])
    table = bytes([0xFF, 0xC4, 0, 4, 0xFF, 0xC0])  # a table whose data look like a frame header
    assert C.jpeg_size(b"\xff\xd8" + table + frame(0xC2)) == (3, 2)
    assert C.jpeg_size(b"\xff\xd8\xff\xff\xff" + frame(0xC0)[1:]) == (3, 2)
    assert C.jpeg_size(b"\xff\xd8\xff\x01" + frame(0xCF) + b"\xff\xd9") == (3, 2)
    assert C.jpeg_size(b"\xff\xd8\xff\xda\x00\x02" + frame(0xC0)) == (None, None)
    for broken in (b"", b"\xff", b"\xff\xd8", b"\xff\xd8\xff\xc0", b"\xff\xd8\xff\xc0\x00", frame(0xC0)[:7], b"\xff" * 500, b"\xff\xd8\xff\xe0\x00\x00" * 3):
        assert C.jpeg_size(broken) == (None, None)
