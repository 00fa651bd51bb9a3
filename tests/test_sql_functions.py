"""SQL functions against the Column functions of the same names, and their plans."""

import pytest
from pyspark.sql import functions as F

from threadlake.functions import media as M, scalars as S, sql, text as X

TEXTS = [
    None, "", "   ", "a", " User\t", "HUMAN", "ai", "tool  call", "x" * 121, "y z " * 60, "1700000000", "1700000000000", "1e13", "nan", "-5.5",
    "2024-01-02T03:04:05.678Z", "2024-13-99", "img10.PNG", "dir/.hidden", "a/b//c007.tar.GZ", "00", "7x0012y", "<a href=\"x\">'&'</a>", "é́ Ünï\n\x0b日本 ٣",
]
ONE = {
    "clean": S.clean, "to_millis": S.to_millis, "agent_role": S.agent_role, "short_preview": S.short_preview, "word_count": S.word_count,
    "natural_key": S.natural_key, "base_name": M.base_name, "extension_of": M.extension_of, "escape_html": X.escape_html, "title_of": S.title_of,
}


@pytest.fixture(scope="module")
def texts(spark):
    sql.register(sql.register(spark))
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "n int, value string")
    frame.createOrReplaceTempView("sql_function_texts")
    return frame


@pytest.mark.parametrize("name", sorted(ONE))
def test_one_argument(spark, texts, rows, name):
    got = rows(spark.sql(f"select n, {name}(value) as out from sql_function_texts"))
    assert got == rows(texts.select("n", ONE[name](F.col("value")).alias("out")))


def test_several_arguments(spark, texts, rows):
    pairs = texts.crossJoin(texts.select(F.col("value").alias("other")))
    pairs.createOrReplaceTempView("sql_function_pairs")
    number = lambda c: F.length(c).cast("bigint")
    want = pairs.select(
        S.first_nonempty(F.col("value"), F.col("other")).alias("a"), S.model_label(F.col("value"), F.col("other"), F.lit("t")).alias("b"),
        S.title_of(F.col("value"), F.col("other")).alias("c"), S.total_tokens(F.lit(None).cast("bigint"), number("value"), number("other")).alias("d"),
        S.iso_time(number("value") * 86_400_001).alias("e"), S.short_preview(F.col("value"), "none").alias("f"))
    got = spark.sql("""
        select first_nonempty(value, other) as a, model_label(value, other, 't') as b, title_of(value, other) as c,
               total_tokens(null, length(value), length(other)) as d, iso_time(length(value) * 86400001L) as e, short_preview(value, 'none') as f
        from sql_function_pairs""")
    assert rows(got) == rows(want)


def test_table_functions(spark, texts, rows):
    got = rows(spark.sql("select n, position, token from sql_function_texts, lateral token_rows(value)"))
    want = rows(texts.select("n", F.posexplode(X.tokens(F.col("value")))).select("n", (F.col("pos") + 1).alias("position"), F.col("col").alias("token")))
    assert got == want and got
    assert rows(spark.sql("select * from path_rows('/a//b/c')")) == [(1, "a"), (2, "b"), (3, "c")]


def test_bodies_are_inlined(spark):
    """A filter on a column beside the functions reaches the scan, and no Python runs."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = spark.sql("select doc_id, word_count(text) as n, title_of(lang) as t from {docs} where doc_id < 9", docs=frame)._jdf.queryExecution().toString()
    assert "LessThan(doc_id,9)" in plan and "Python" not in plan and "Arrow" not in plan
