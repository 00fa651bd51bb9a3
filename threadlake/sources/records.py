"""Scans of record stores: JSON lines, whole JSON documents, JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from threadlake.functions import records as R


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that are not blank, with file, split offset and an order inside the split."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
    return lines.where(F.trim("line") != "").withColumn("_seq", F.monotonically_increasing_id())


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Adds the 0-based number of each line in its file, counting lines that are not blank.

    A split of a file is read in order, so only the number of lines in earlier
    splits has to be added: one summary row per split, no sort of the lines.
    """
    splits = lines.groupBy("file", "split").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return lines.join(offsets, ["file", "split"]).withColumn(
        "line_no", F.col("_seq") - F.col("_first") + F.col("_offset")).drop("_seq", "_first", "_offset", "split")


def read_store(spark: SparkSession, path: str | list[str], numbered: bool = False) -> DataFrame:
    """Records of JSON-lines stores as VARIANT; a malformed line is an error."""
    lines = read_lines(spark, path)
    if numbered:
        lines = with_line_numbers(lines)
    return lines.withColumn("record", F.parse_json("line")).drop("line", "_seq", "split")


def read_store_lenient(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Good records, and malformed lines for quarantine."""
    parsed = read_lines(spark, path).withColumn("record", R.parse("line"))
    return parsed.where("record is not null").drop("line", "_seq", "split"), parsed.where("record is null").select("file", "line")


def read_json_doc(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Whole JSON documents with a given schema; a missing or malformed document gives no row."""
    try:
        # any corrupt document shows up as a row without values
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows


def read_json_array(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Elements of stores saved as one top-level JSON array each; anything malformed is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
