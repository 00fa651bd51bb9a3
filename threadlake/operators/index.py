"""Stored positional inverted index: written once per delivery, read by the posting blocks a search needs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.functions import text as T
from threadlake.session import materialize

K1, B = 1.2, 0.75
#: Folders into which terms are dealt, and documents that share a posting block, at most.
SHARDS, BLOCK = 16, 1024
#: Words of a posting block, unless one document has more: what a worker holds at once follows from it.
WORDS = 1 << 20
#: Blocks that are scored first for a query; what they reach decides which others are read at all.
FIRST = 4


def shard_of(term: str) -> int:
    return zlib.crc32(term.encode()) % SHARDS


def append(documents: DataFrame, doc_id: str, texts: Column | Sequence[Column], path: str, delivery: int) -> None:
    """Adds the documents of one delivery; ids must not be in the index yet.  A repeated delivery overwrites its own files.

    Words are those of ``folded_tokens``.  Positions of one text column follow those of the column before it after a gap,
    so a phrase never spans two.  A posting block holds the documents of a term among ``BLOCK`` neighbours of the input, so it
    is made without a shuffle, and a word that every document has is spread over as many rows as there are blocks.  Beside the
    postings stand the numbers that bound a block's scores, whatever the average length of a text will be.  Ids and lengths of
    documents are stored once a block, in a folder after those of the terms; postings name a document by its place in the block.
    """
    texts = [texts] if isinstance(texts, Column) else list(texts)
    gap = F.array(F.lit(None).cast("string"))
    lists = [x for text in texts for x in (gap, T.folded_tokens(text))][1:]
    words = documents.select(F.col(doc_id).alias("doc_id"), F.concat(*lists).alias("words"))
    id_type = documents.schema[doc_id].dataType.simpleString()
    blocks = words.mapInArrow(_blocks, f"{_HEAD}, {_POSTINGS.format(id_type)}")
    blocks = blocks.withColumn("shard", F.coalesce((F.crc32(F.encode("term", "utf-8")) % SHARDS).cast("int"), F.lit(SHARDS))) \
        .hint("rebalance", "shard").sortWithinPartitions("term", "block")
    with _open_folders(documents.sparkSession):
        blocks.write.mode("overwrite").options(**_FILES).partitionBy("shard").parquet(f"{path}/postings/delivery={delivery}")
    written = read(documents.sparkSession, path, id_type).where((F.col("delivery") == delivery) & (F.col("shard") == SHARDS))
    tokens = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda total, x: total + x)
    counted = written.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in (("tokens", tokens), ("documents", F.col("docs")))])
    counted.write.mode("overwrite").parquet(f"{path}/totals/delivery={delivery}")


#: Most values occur once, so dictionaries would be built in vain; pages are small, as a search opens those of its words.
_FILES = {"partitionOverwriteMode": "static", "parquet.page.row.count.limit": "2048"} | {
    f"parquet.enable.dictionary#{name}": "false" for name in ("term", "block", "hits", "places")}


@contextmanager
def _open_folders(spark: SparkSession) -> Iterator[None]:
    """A task keeps the files of all its shards open, so rows need no order by shard before that by term."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), SHARDS + 1)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_HEAD = "term string, block bigint, docs int, max_tf int, min_length int"
# a row of a term has packed numbers, places apart from hits, as they are read for phrases of several words only; the row of a
# block itself (no term) has two lists, one entry a document
_POSTINGS = "hits binary, places binary, doc_ids array<{0}>, lengths array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting blocks of some documents (doc_id, words) at a time; a null word is a gap."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in _parts(batch):
            number += 1
            yield from _block(part, number)
        # what Arrow keeps of a batch is given back, so a worker that has seen many is no larger than after the first
        del batch
        pa.default_memory_pool().release_unused()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``BLOCK`` documents and, unless one document has more, of ``WORDS`` words."""
    ends = np.cumsum(np.asarray(pc.list_value_length(batch.column("words")).fill_null(0), np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + BLOCK, max(at + 1, int(np.searchsorted(ends, before + WORDS, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def _block(batch: pa.RecordBatch, number: int) -> Iterator[pa.RecordBatch]:
    """The row of a block and those of its terms.

    ``hits`` are the gap to the document before and the frequency, a pair each document; ``places`` the gaps between the
    places in a document.
    """
    words, ids = batch.column("words"), batch.column("doc_id")
    sizes = np.asarray(pc.list_value_length(words), np.int64)
    coded = pc.dictionary_encode(words.flatten())
    terms, codes = coded.dictionary, np.asarray(coded.indices.fill_null(-1), np.int32)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place = np.arange(len(codes), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    real = codes >= 0
    length = np.bincount(doc[real], minlength=len(sizes))
    whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), values)
    yield _rows([None], number, [len(sizes)], [None], [None], pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), whole(ids), whole(pa.array(length.astype(np.int32))))
    order = np.flatnonzero(real)
    if not len(order):
        return
    order = order[np.argsort(codes[order], kind="stable")]  # documents and places stay in order inside a term
    codes, doc, place = codes[order], doc[order], place[order]
    new_term = np.diff(codes, prepend=-1) != 0
    first = np.flatnonzero(new_term | (np.diff(doc, prepend=-1) != 0))  # a posting each
    tf = np.diff(first, append=len(codes))
    rows = np.flatnonzero(new_term[first])  # a row each
    docs = np.diff(rows, append=len(first))
    hits = np.column_stack([_gaps(doc[first], rows), tf]).ravel()
    yield _rows(terms.take(pa.array(codes[first[rows]])), number, docs, np.maximum.reduceat(tf, rows), np.minimum.reduceat(length[doc[first]], rows),
                _packed(hits, 2 * rows), _packed(_gaps(place, first), first[rows]), pa.nulls(len(rows), pa.list_(ids.type)), pa.nulls(len(rows), pa.list_(pa.int32())))


def _rows(terms, number: int, docs, max_tf, min_length, *lists: pa.Array) -> pa.RecordBatch:
    numbers = [pa.array(x, pa.int32()) for x in (docs, max_tf, min_length)]
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(np.full(len(docs), number)), *numbers, *lists],
                                      ["term", "block", "docs", "max_tf", "min_length", "hits", "places", "doc_ids", "lengths"])


def _gaps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences of rising values; a run that starts anew begins with its value."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _running(gaps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values again, from the lengths of the runs."""
    total = np.append(0, np.cumsum(gaps))
    return total[1:] - np.repeat(total[np.cumsum(sizes) - sizes], sizes)


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary value for each run of whole numbers from 0: seven bits a byte, low ones first, and 128 where more follow."""
    size = np.ones(len(values), np.int8)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    out = np.empty(ends[-1], np.uint8)
    while len(at):
        more = size > 1
        out[at] = values & 127 | more.astype(np.uint8) << 7
        at, values, size = at[more] + 1, values[more] >> 7, size[more] - 1
    offsets = np.append(0, ends)[np.append(starts, len(ends))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed values, none of them null, and how many each row has."""
    offsets = np.append(0, np.cumsum(np.asarray(pc.binary_length(column), np.int64)))
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)
    shift = 7 * (np.arange(len(data)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, starts), np.diff(np.searchsorted(ends, offsets))


#: Posting blocks whose documents are unpacked at once.
OPENED = 16


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document of posting rows (hits, doc_ids, lengths and perhaps places; other columns are carried along)."""
    for batch in batches:
        for start in range(0, batch.num_rows, OPENED):
            part = batch.slice(start, OPENED)
            pairs, counts = _unpacked(part.column("hits"))
            counts, tf = counts // 2, pairs[1::2]
            at = _running(pairs[::2], counts)
            row = np.repeat(np.arange(part.num_rows), counts)
            listed = lambda name: part.column(name).values.take(pa.array(np.asarray(part.column(name).offsets)[row] + at))
            kept = {name: part.column(name).take(pa.array(row)) for name in part.schema.names if name not in ("hits", "places", "doc_ids", "lengths")}
            kept |= {"doc_id": listed("doc_ids"), "length": listed("lengths"), "tf": pa.array(tf, pa.int32())}
            if "places" in part.schema.names:
                places = _running(_unpacked(part.column("places"))[0], tf)
                kept["places"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)), pa.int32()), pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_pydict(kept)


def read(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    return spark.read.schema(f"{_HEAD}, {_POSTINGS.format(id_type)}, shard int, delivery int").parquet(f"{path}/postings")


def _part(tf: Column, length: Column, average: float) -> Column:
    """What a phrase adds to a score, before its weight: grows with the frequency and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def search(spark: SparkSession, path: str, queries: Sequence[Sequence[tuple[str, ...]]], limit: int, id_type: str = "string") -> DataFrame:
    """BM25 ranking (query_id, doc_id, score, rank) of queries, each a list of phrases that must all occur.

    Reads the blocks of the asked words only (their folders and, inside, their row groups).  What bounds a block is looked
    at first, without its postings: a block needs all phrases of a query, and the best ``FIRST`` blocks of a query are
    scored before the others; a block whose bound is below the ``limit``-th score so far is never opened.  Results are
    those of a full scan.
    """
    limit = max(1, limit)
    phrases = sorted({p for one in queries for p in one})
    terms = sorted({word for p in phrases for word in p})
    stored = read(spark, path, id_type)
    blocks = stored.where(F.col("shard").isin(sorted({shard_of(x) for x in terms})) & F.col("term").isin(terms))
    totals = spark.read.parquet(f"{path}/totals").agg(F.sum("documents").alias("n"), F.sum("tokens").alias("tokens")).first()
    total, average = totals.n, max(totals.tokens / totals.n if totals.n else 0, 1e-9)
    slots = _table(spark, "phrase int, slot int, term string, size int", [(n, at, word, len(p)) for n, p in enumerate(phrases) for at, word in enumerate(p)])

    place = ["delivery", "block"]
    documents = stored.where(F.col("shard") == SHARDS).select(*place, "doc_ids", "lengths")
    bounds = materialize(blocks.select("term", *place, "docs", "max_tf", "min_length").join(F.broadcast(slots), "term").groupBy("phrase", "size", *place).agg(
        F.count("*").alias("found"), F.min("docs").alias("docs"), F.min("max_tf").alias("max_tf"), F.max("min_length").alias("min_length")).where("found = size"), "bounds")

    def opened(wanted: DataFrame, *lists: str) -> DataFrame:
        """Postings of the phrases' words in the blocks (phrase, delivery, block), one row a document, with the named lists."""
        chosen = wanted.join(F.broadcast(slots), "phrase")
        rows = blocks.select("term", *place, "hits", *lists).join(chosen, ["term", *place]).join(documents, place)
        kinds = "phrase int, slot int, size int, delivery int, block bigint, doc_id {0}, length int, tf int".format(id_type) + "".join(f", {x} array<int>" for x in lists)
        return rows.select("phrase", "slot", "size", *place, "hits", "doc_ids", "lengths", *lists).mapInArrow(_documents, kinds)

    # phrases of several words: a place counts where all words stand in a row; their document counts need all their blocks
    shifted = F.transform("places", lambda x: x - F.col("slot"))
    rows = opened(bounds.where("size > 1").select("phrase", *place), "places").select("phrase", "size", *place, "doc_id", "length", shifted.alias("places"))
    together = rows.groupBy("phrase", "size", *place, "doc_id", "length").agg(F.collect_list("places").alias("each")).where(F.size("each") == F.col("size"))
    tf = F.size(F.reduce(F.slice("each", 2, F.size("each")), F.get("each", F.lit(0)), F.array_intersect))
    rowed = materialize(together.select("phrase", *place, "doc_id", "length", tf.alias("tf")).where("tf > 0"), "rows")

    df = bounds.where("size = 1").groupBy("phrase").agg(F.sum("docs").alias("df")).unionByName(rowed.groupBy("phrase").agg(F.count("*").alias("df")))
    counted = {r.phrase: r.df for r in df.collect()}  # one row a phrase
    # a phrase in more than half of the rows still scores a little
    idf = {n: max(log((total - x + 0.5) / (x + 0.5)), 1e-6) for n, x in counted.items()}
    weights = _table(spark, "query_id int, phrase int, needed int, idf double", [
        (q, n, len(set(one)), idf.get(n, 0.0)) for q, one in enumerate(queries) for n in sorted({phrases.index(p) for p in one})])

    reach = bounds.join(F.broadcast(weights), "phrase").groupBy("query_id", "needed", *place).agg(
        F.count("*").alias("found"), F.sum(F.col("idf") * _part(F.col("max_tf"), F.col("min_length"), average)).alias("bound")).where("found = needed")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), *place))
    reach = reach.select("query_id", *place, "bound", order.alias("number"))

    def scored(chosen: DataFrame) -> DataFrame:
        """Documents of the blocks (query_id, delivery, block) that have all phrases, with their scores."""
        wanted = chosen.join(F.broadcast(weights), "query_id").select("phrase", *place).distinct()
        single = opened(wanted.join(F.broadcast(slots.where("size = 1").select("phrase")), "phrase", "left_semi"))
        hits = single.select("phrase", *place, "doc_id", "length", "tf").unionByName(rowed.join(wanted, ["phrase", *place], "left_semi"))
        parts = hits.join(F.broadcast(weights), "phrase").join(chosen.select("query_id", *place), ["query_id", *place], "left_semi")
        return parts.groupBy("query_id", "doc_id").agg(
            F.sum(F.col("idf") * _part(F.col("tf"), F.col("length"), average)).alias("score"), F.count("*").alias("found"), F.max("needed").alias("needed")
        ).where("found = needed").select("query_id", "doc_id", F.round("score", 6).alias("score"))

    first = materialize(top(scored(reach.where(F.col("number") <= FIRST)), limit), "first")
    least = first.where(F.col("rank") == limit).select("query_id", F.col("score").alias("least"))
    # scores are rounded, so a bound just below may still tie
    rest = reach.where(F.col("number") > FIRST).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 2e-6))
    return top(first.drop("rank").unionByName(scored(rest.select("query_id", *place))), limit)


def _table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table of the driver's, as a local relation."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table({name: pa.array(list(column), kind) for name, column, kind in zip(names, columns, types)}))


def top(matched: DataFrame, limit: int) -> DataFrame:
    """Best rows per query; the rank filter is applied on every partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc()))
    return matched.withColumn("rank", rank).where(F.col("rank") <= limit)
