"""File inventories and full-content hashes.

Spark lists the files; their content is read in chunks where it is hashed, so a file of any size needs one chunk of memory.
Spark's file listing leaves out empty files and names that begin with an underscore or a dot.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def relative_path(root: str) -> Column:
    """Path below the root folder."""
    plain = root.rstrip("/").removeprefix("file:")
    return F.substring_index(F.col("path"), plain + "/", -1)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive inventory: path, bytes, modified; the content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(relative_path(root).alias("path"), F.col("length").alias("bytes"),
                        F.unix_millis("modificationTime").alias("modified"))


#: Bytes of a file that are in memory at once.
CHUNK = 4 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name of a listed path; names are taken as they are, without percent codes."""
    place = re.fullmatch(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/]+)(/.*)", path, re.DOTALL)
    if place is None:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, host, name = place.groups()
    system, base = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")
    return system, base.rstrip("/") + name


def _sha256(path: str, chunk: int) -> str:
    system, name = _opened(path)
    digest = hashlib.sha256()
    with system.open_input_stream(name) as stream:
        while block := stream.read(chunk):
            digest.update(block)
    return digest.hexdigest()


def hash_files(spark: SparkSession, root: str, chunk: int = CHUNK, per_task: int = 1 << 30) -> DataFrame:
    """SHA-256 of every file; equal size and equal edges prove nothing.

    ``binaryFile`` only lists the files.  A digest is taken in one stream, ``chunk`` bytes at a time, from the file system that
    the path names.  Files are dealt over tasks of about ``per_task`` bytes by a hash of the path, so that a folder of large files
    isn't one task; a file that can't be read ends the job.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    total = listed.agg(F.sum("length")).first()[0] or 0

    def hashed(batches):
        for batch in batches:
            digests = [_sha256(path, chunk) for path in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(digests, pa.string())], ["path", "length", "sha"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-total // per_task))
    found = listed.repartition(tasks, "path").mapInArrow(hashed, "path string, length long, sha string")
    return found.select(relative_path(root).alias("path"), F.col("length").alias("bytes"), "sha")


def signature(size: Column, modified: Column) -> Column:
    """``size:mtime`` of a file."""
    return F.concat_ws(":", size.cast("string"), modified.cast("string"))
