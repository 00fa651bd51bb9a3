"""Embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from threadlake.llm.common import components, packed, prepared, whole_ids
from threadlake.session import materialize

#: Vectors looked at to choose the reference points, at most, and reference points kept, at most.
SAMPLE, PIVOTS = 4096, 256
#: Reference points whose order describes a vector, and how many of them two vectors must share to be verified.
NEAREST, SHARED = 10, 3
#: Reference points lie at least this far apart, so that a group of copies does not hold many of them.
APART = 0.7
#: Rows of one list that meet in a task; longer lists are cut into pairs of blocks.
BLOCK = 1024


def usable(vector: Column, label: Column) -> Column:
    """A vector that can link: a label, all components finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of equal length as a matrix of unit vectors in double precision."""
    flat = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)
    largest = np.abs(flat).max(axis=1, keepdims=True)
    flat = flat / largest  # squares of very small or large components stay in range
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def choose_pivots(vectors: np.ndarray) -> np.ndarray:
    """Sampled vectors, each at some distance from those before it."""
    kept: list[int] = []
    for i in range(len(vectors)):
        if len(kept) == PIVOTS:
            break
        if not kept or (vectors[kept] @ vectors[i]).max() < APART:
            kept.append(i)
    return vectors[kept]


def _linked(ids: np.ndarray, unit: np.ndarray, tops: np.ndarray, side: np.ndarray, split: bool, pivot: int, threshold: float):
    """Pairs of a list with enough shared reference points and cosine, that no list of a smaller pivot has."""
    width = int(tops.max()) + 1
    marks = np.zeros((len(ids), width), np.float32)
    np.put_along_axis(marks, tops, 1.0, axis=1)
    left = np.flatnonzero(side == 0) if split else np.arange(len(ids))
    right = np.flatnonzero(side == 1) if split else left
    found = []
    for at in range(0, len(left), 256):
        rows = left[at:at + 256]
        shared = marks[rows] @ marks[right].T >= min(SHARED, tops.shape[1], width)
        a, b = np.nonzero(shared)
        a, b = rows[a], right[b]
        if not split:
            a, b = a[a < b], b[a < b]
        # the smallest common pivot owns the pair
        own = ~((marks[a][:, :pivot] > 0) & (marks[b][:, :pivot] > 0)).any(axis=1) if pivot else np.ones(len(a), bool)
        a, b = a[own], b[own]
        cosine = np.einsum("ij,ij->i", unit[a], unit[b])
        good = (cosine >= threshold) & (ids[a] != ids[b])
        found.append((a[good], b[good]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the first row of its group of linked rows."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if np.array_equal(before, least):
            return least


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row; vectors of one label link from cosine ``threshold`` on.

    * null and zero vectors, vectors with null or non-finite components, null labels and null ids link with nothing;
      so do vectors of different length;
    * a repeated row is one vector: its copies do not link with each other and count once for others;
    * ``component_id`` is the smallest id reachable by links, ``kept`` says that it is the row's own (a null id is kept);
    * an empty table gives an empty table; only the three named columns are read.

    Reference points come from at most ``SAMPLE`` vectors, chosen apart from each other, and are broadcast (their number has
    a fixed bound).  Every vector is indexed by the order of its nearest ones and stands in one inverted list for each.
    Lists of more than ``BLOCK`` rows are cut into blocks that meet in pairs.  Inside a list, pairs that share enough
    reference points are verified in double precision; the smallest common one owns a pair, so it counts once.  What
    leaves a task is a count and one edge per vector, not the pairs.
    """
    spark = prepared(vectors.sparkSession)
    whole_ids(vectors, id_column)
    every = packed(vectors, id=id_column, vector=vector_column, label=label_column).select(F.col("id").cast("long").alias("id"), "vector", "label")
    rows = every.where(F.col("id").isNotNull() & usable(F.col("vector"), F.col("label"))).withColumn("size", F.size("vector"))
    rows = materialize(rows.dropDuplicates(["id", "label", "vector"]), "vectors")

    sampled = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector", "size").collect()
    by_size: dict[int, list] = {}
    for r in sampled:
        by_size.setdefault(r["size"], []).append(r["vector"])
    sent = spark.sparkContext.broadcast({n: choose_pivots(matrix(pa.array(x, pa.list_(pa.float64())), n)) for n, x in by_size.items()})

    def index(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                pivots = sent.value.get(size)
                if pivots is None:  # no vector of this length was sampled: one list holds them
                    near = np.zeros((part.num_rows, 1), np.int64)
                else:
                    near = np.argsort(-(matrix(part.column("vector"), size) @ pivots.T), axis=1, kind="stable")[:, :NEAREST]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), part.column("size"), part.column("vector"), pa.array(near.tolist(), pa.list_(pa.int32()))], ["id", "label", "size", "vector", "near"])

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    indexed = rows.select("id", "label", "size", "vector").mapInArrow(
        index, f"id long, label {fields['label']}, size int, vector {fields['vector']}, near array<int>")
    lists = indexed.withColumn("pivot", F.explode("near"))
    sizes = indexed.select("label", "size", F.explode("near").alias("pivot")).groupBy("label", "size", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    lists = lists.join(sizes, ["label", "size", "pivot"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    meets = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "size", "pivot", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "vector", "near")

    def verify(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        group, ids = group.take(pa.array(order)), ids[order]
        first, second = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        near = group.column("near").combine_chunks()
        tops = np.asarray(near.flatten(), np.int64).reshape(len(ids), -1)
        a, b = _linked(
            ids, matrix(group.column("vector").combine_chunks(), group.column("size")[0].as_py()), tops,
            (group.column("block").to_numpy() == second).astype(int), first != second, group.column("pivot")[0].as_py(), threshold)
        count = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        root = ids[_least_linked(len(ids), a, b)]
        some = count > 0
        return pa.table({"id": ids[some], "n": count[some], "root": root[some]})

    linked = materialize(meets.groupBy("label", "size", "pivot", "x", "y").applyInArrow(verify, "id long, n long, root long"), "links")
    counts = linked.groupBy("id").agg(F.sum("n").alias("n_links"))
    joined = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    own = F.coalesce("component", "id")
    return every.select("id").join(counts, "id", "left").join(joined, "id", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))
