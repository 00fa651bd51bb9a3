"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every job of this library relies on.  They are SQL settings,
# so they can be applied to a session that a cluster has already started.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot conversation or payload is split even when that costs one extra shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows that go to Python functions may hold whole files: a batch is bounded in bytes, not only in rows
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # stores written by several tools may repeat a key: the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Sizes on disk that a task gets at most.  Narrow rows take twenty times as much in a sort or a hash table, so the usual
# 64 and 128 MB would let the memory of a task grow to gigabytes; smaller values of a cluster are kept.
TASK_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20, "spark.sql.files.maxPartitionBytes": 32 << 20}


def _bytes(spark: SparkSession, text: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, value in TASK_BYTES.items():
        if _bytes(spark, spark.conf.get(key)) > value:
            spark.conf.set(key, str(value))
    return spark


def local_session(cores: int | str = 8, app: str = "threadlake", **settings: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workspace(spark: SparkSession, label: str = "run") -> str:
    """A fresh folder below the shared folder the cluster names.

    ``spark.checkpoint.dir`` names storage that every executor sees.  Only a
    purely local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="threadlake-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df, label: str = "table"):
    """Write a table to the shared folder and read it back, which cuts lineage."""
    path = workspace(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
