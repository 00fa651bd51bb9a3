"""A training-data pipeline: toxicity, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from threadlake.llm import bpe, common, fm_index, line_dedup, set_join, toxicity
from threadlake.llm.queries import vocabulary
from threadlake.session import materialize


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` of a text that may have changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it learns from the labelled documents outside the held-out fold."""
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_documents(docs, model)
    return common.with_text(scored.where("predicted = 0"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; documents stay (a null text becomes empty)."""
    return _with_length(common.with_text(line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=1), docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays, once.

    Texts without words are in no group; documents without an id can't be linked.  Both stay.
    """
    joined = set_join.jaccard_components(docs, words=5, percent=80)
    kept = joined.where("id = component_id").select("id").distinct()
    rows = docs.join(kept, docs["doc_id"] == kept["id"], "left_semi")
    copy = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    number = next(name for name in ("copy", "copy_number", "copy_number_") if name not in docs.columns)
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = rows.withColumn(number, F.row_number().over(copy)).where((F.col(number) == 1) | ~has_words).select(*docs.columns)
    return rows.unionByName(docs.where("doc_id is null"))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten words or more that a benchmark item has are cut out; documents stay."""
    found = fm_index.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, cut=True)
    return _with_length(common.with_text(found, docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that is left, and the text they decode to."""
    return bpe.encode_texts(docs.select("doc_id", "text"), vocabulary()).select(
        "doc.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("bpe", tokenize),
]

#: The learned score of the first stage and the ids of the last can't be stated in SQL; the tests compare each stage
#: with a brute-force version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order to ``documents``."""
    docs = common.prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
