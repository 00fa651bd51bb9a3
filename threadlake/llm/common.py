"""Shared pieces: packed rows, vectorized words, fingerprints, batches of bounded size, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from threadlake.session import configure, materialize

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 1 << 20


def prepared(spark):
    """The session with the library's settings, Arrow batches bounded in bytes and shuffle files removed after each query.

    Steps are cut by written tables, so the shuffles of an earlier step are never read again.
    """
    configure(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def packed(df: DataFrame, without: tuple[str, ...] = (), **wanted: str) -> DataFrame:
    """Input columns in one struct ``doc`` plus the wanted ones under internal names, so no name can clash.

    Columns named in ``without`` are left out of the struct.
    """
    held = [df[c] for c in df.columns if c not in without]
    return df.select(F.struct(*held).alias("doc"), *(df[c].alias(k) for k, c in wanted.items()))


def whole_ids(df: DataFrame, column: str) -> None:
    """Refuses an id column that is not of a whole-number type; a table without a type for it (all null) is let through."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"ids must be whole numbers, and {column} is {kind.simpleString()}")


def with_text(df: DataFrame, like: DataFrame, text_column: str = "text") -> DataFrame:
    """The columns of ``like`` from a packed result whose text stands beside ``doc``."""
    return df.select(*(
        (F.col("text") if c == text_column else F.col("doc").getField(c)).cast(like.schema[c].dataType).alias(c) for c in like.columns))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64; spreads every input bit over the word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def power_table(base: int, size: int) -> np.ndarray:
    """base**i modulo 2**64."""
    out = np.empty(size, np.uint64)
    out[0] = 1
    filled = 1
    while filled < size:
        step = min(filled, size - filled)
        out[filled:filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


def prefix_sums(value: np.ndarray, data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """0 and the running sums of value[data[i]] * powers[i], in one array."""
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    body = total[1:]
    np.take(value, data, out=body)
    body *= powers[:len(data)]
    np.cumsum(body, out=body)
    return total


class Words:
    """Words of many byte strings at once: 64-bit fingerprints, places, owning text.

    ``separators`` are the byte values between words; A-Z is lowered first unless ``fold`` is false.
    """

    BASE = 0xD6E8FEB86659FD93 | 1

    def __init__(self, separators, fold: bool = True):
        self.lower = np.arange(256, dtype=np.uint8)
        if fold:
            self.lower[65:91] += 32
        self.sep = np.zeros(256, bool)
        self.sep[list(separators)] = True
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)[self.lower]
        self.value[self.sep[self.lower]] = 0
        self.is_sep = self.sep[self.lower]
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _tables(self, size: int):
        if len(self.powers) < size:
            size = max(size, 1 << 20)
            self.powers = power_table(self.BASE, size)
            self.inverse = power_table(pow(self.BASE, -1, 1 << 64), size)
        return self.powers, self.inverse

    def split(self, texts: list[bytes]):
        """(hash, text index, start byte in text, end byte in text) of all words in order."""
        joined = b"\x20".join(texts) + b"\x20"
        data = np.frombuffer(joined, np.uint8)
        sep = self.is_sep[data]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        if not self.is_sep[0x20]:
            raise ValueError("the space must separate words")
        edge = np.flatnonzero(np.diff(np.concatenate(([True], sep)).view(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        powers, inverse = self._tables(len(data) + 1)
        total = prefix_sums(self.value, data, powers)
        hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * GOLDEN)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        return hashes, owner, starts - offsets[owner], ends - offsets[owner]


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def bounded(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column holds about ``limit`` bytes at most, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def list_array(values: np.ndarray, lengths: np.ndarray, kind=None) -> pa.Array:
    """A list column from flat values and the length of each row."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = fn(batch)
            yield from ([out] if isinstance(out, pa.RecordBatch) else out)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected edge list (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps.  Both are a grouped minimum and a join back on the node, so a
    node with very many links is an ordinary skewed join.  Each round is a written table.
    """
    star = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    star = materialize(star, "edges")
    mark = None
    for _ in range(rounds):
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        star = materialize(
            small.select(F.greatest("b", "m").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        seen = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return star.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
