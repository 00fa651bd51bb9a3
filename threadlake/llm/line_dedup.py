"""Line deduplication: lines that many documents share are dropped everywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from threadlake.llm.common import arrow_map, packed, prepared
from threadlake.session import materialize

STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def _kept(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, n_dropped = [], np.zeros(batch.num_rows, np.int64)
    hashes, drops = batch.column("hashes"), batch.column("drop")
    for i, text in enumerate(batch.column("text").to_pylist()):
        drop = drops[i].values if drops[i].is_valid else None
        if drop is None or not len(drop):
            texts.append(text)
            continue
        gone = np.isin(np.asarray(hashes[i].values), np.asarray(drop))
        n_dropped[i] = int(gone.sum())
        texts.append("\n".join(line for line, g in zip(text.split("\n"), gone) if not g))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc"), pa.array(texts, pa.string()), batch.column("n_lines"), pa.array(n_dropped)],
        ["doc", "text", "n_lines", "n_dropped"])


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    r"""Every row with its text without the lines whose key occurs in ``min_docs`` documents or more.

    Lines are split at \n; the key is the line without white space at both ends and with A-Z lowered.  Keys shorter
    than ``min_chars`` stay.  Returns ``doc`` (the input columns without the text), ``text``, ``n_lines`` (before), ``n_dropped``.

    * null or empty text: one empty line, which stays; a text whose lines all go becomes empty;
    * rows with the same id count as one document; a null id names none, so each such row is a document of its own;
    * a key that occurs several times in one document counts once;
    * an empty table gives an empty table; further columns are carried in ``doc`` and may have any name.

    Plan: distinct keys of a row are exploded as two 64-bit hashes, made distinct per id
    where an id stands several times, and counted with map-side sums; the frequent
    keys meet the (document, key) rows in an equi-join that adaptive execution can split; each document gets the
    frequent keys it holds, and its lines are kept or dropped by position.  The text is shuffled once.
    """
    prepared(docs.sparkSession)
    rows = packed(docs, (text_column,), id=id_column, text=text_column).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.split("text", "\n", -1)
    rows = rows.withColumn("hashes", F.transform(lines, lambda x: F.xxhash64(line_key(x))))
    keys = F.array_distinct(F.transform(
        F.filter(F.transform(lines, line_key), lambda k: F.char_length(k) >= min_chars),
        lambda k: F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit("line"), k).alias("g"))))
    pairs = rows.select("id", F.explode(keys).alias("k")).select("id", "k.h", "k.g")
    # rows of one id are one document; only the keys of ids that stand several times need a distinct
    again = materialize(rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    if again.isEmpty():
        counted = pairs
    else:
        counted = pairs.join(again, "id", "left_anti").unionByName(pairs.join(again, "id", "left_semi").distinct())
    frequent = counted.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h", "g")
    # written, so that the rows of a very frequent line meet it in a join whose shuffle can be split
    frequent = materialize(frequent, "frequent")
    drop = pairs.join(frequent, ["h", "g"]).groupBy("id").agg(F.collect_set("h").alias("drop"))
    drop = drop.withColumnRenamed("id", "drop_id")
    joined = rows.join(drop, F.col("id").eqNullSafe(F.col("drop_id")), "left").select(
        "doc", "text", "hashes", "drop", F.size("hashes").cast("long").alias("n_lines"))
    schema = T.StructType([rows.schema["doc"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return arrow_map(joined, _kept, schema)
