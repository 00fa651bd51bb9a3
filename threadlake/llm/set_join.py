"""Exact n-gram Jaccard join with skipping of list blocks and of answers a similar set already has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from threadlake.llm.common import GOLDEN, Words, bounded, components, list_array, mix, packed, prepared, text_bytes, whole_ids
from threadlake.session import materialize

SEPARATORS = (0x20, *range(9, 14))
STEP = np.uint64(0x9FB21C651E98DF25)
#: Number of the most repeated shingles that are put last in every set.  They only set the order of the shingles, which
#: may be any; the bound keeps what is broadcast at eight megabytes.
LATE_SHINGLES = 1 << 20
GROUP = 1 << 22
#: Pivots of a size block of a list besides the earliest, and pivots a set is verified against before the rest.
HASHED_PIVOTS, PIVOTS = 3, 4


class Shingler:
    """Sets of distinct shingle fingerprints of many texts."""

    def __init__(self, words: int):
        self.words, self.n = Words(SEPARATORS), words

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text its sorted distinct fingerprints; texts of fewer words are one shingle, without words none."""
        hashes, owner, _, _ = self.words.split(texts)
        total = len(hashes)
        counts = np.bincount(owner, minlength=len(texts))
        starts = np.cumsum(counts) - counts
        full = np.zeros(max(0, total - self.n + 1), np.uint64)
        for j in range(self.n):
            full = full * STEP + hashes[j:total - self.n + 1 + j] if len(full) else full
        full = mix(full)
        out = []
        for start, count in zip(starts, counts):
            if count >= self.n:
                found = np.sort(full[start:start + count - self.n + 1])
                keep = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                out.append(found[keep])
            elif count:
                value = np.uint64(count)
                for h in hashes[start:start + count]:
                    value = np.uint64((int(value) * int(STEP) + int(h)) & 0xFFFFFFFFFFFFFFFF)
                out.append(mix(np.array([value ^ GOLDEN], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def set_id(found: np.ndarray) -> int:
    """Fingerprint of a whole set."""
    total = np.array([len(found)], np.uint64) * GOLDEN + np.sum(mix(found ^ STEP), dtype=np.uint64)
    return int(mix(total).view(np.int64)[0])


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def overlap_needed(a, b, percent: int):
    """Least intersection of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


def _in_batches(batches, schema_builder) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bounded(batch, "text"):
            out = schema_builder(part)
            if out is not None:
                yield out


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by shingle, size, set: the lists of two sets or more, each set once.

    Only the last row is kept from batch to batch, so a list may have any length.
    """
    last = None  # the row before, and whether it has been handed on
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if not batch.num_rows:
            continue
        if last is not None:
            columns = [np.concatenate(([x], y)) for x, y in zip(last[0], columns)]
        token, _, node, _ = columns
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, size, node, pos = (x[fresh] for x in columns)
        listed = np.zeros(len(token), bool)
        listed[1:] = token[1:] == token[:-1]
        listed[:-1] |= listed[1:]
        handed = bool(listed[-1]) or (last is not None and len(token) == 1 and last[1])
        if last is not None and last[1]:
            listed[0] = False
        last = [x[-1] for x in (token, size, node, pos)], handed
        if listed.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[listed]) for x in (token, size, node, pos)], ["token", "size", "node", "pos"])


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Over list rows sorted by shingle and size: pairs of one list whose sets are in different components.

    Both sets must have the shingle early enough for it to be the first they share.  A pair whose sets have the same
    listed shingle right before this one has met in that list already.  What is kept from batch to batch is the
    entries that can still have a partner of the sizes to come.
    """
    held: tuple = ()
    last = None
    for batch in batches:
        token, size, node, pos, comp, prior = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        left, right = [], []
        cuts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))).tolist() + [len(token)]
        for a, b in zip(cuts, cuts[1:]):
            s, v, p, c, f = size[a:b], node[a:b], pos[a:b], comp[a:b], prior[a:b]
            known = 0
            if held and last == token[a]:
                known = len(held[0])
                s, v, p, c, f = (np.concatenate((x, y)) for x, y in zip(held, (s, v, p, c, f)))
            if len(s) > 1 and (c != c[0]).any():
                begin = np.searchsorted(s * 100, percent * s, side="left")
                for i in range(max(known, 1), len(s)):
                    j = np.arange(begin[i], i)
                    # without a shingle before it, ``prior`` is the shingle itself
                    j = j[(c[j] != c[i]) & ((f[j] != f[i]) | (f[i] == token[a]))]
                    need = overlap_needed(s[j], s[i], percent)
                    j = j[(p[j] <= s[j] - need) & (p[i] <= s[i] - need)]
                    if len(j):
                        left.append(v[j])
                        right.append(np.full(len(j), v[i]))
            last = token[a]
            still = s * 100 >= percent * s[-1]
            held = (s[still], v[still], p[still], c[still], f[still])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    r"""(id, n_shingles, set_id, component_id) of every row; sets link at 100 * intersection >= percent * union.

    Words are ``[^\x20\x09-\x0D]+`` with A-Z lowered; a set holds the distinct shingles of ``words`` words, or the whole
    sequence where there are fewer.  ``component_id`` is the smallest id reachable by links, itself included.

    * null, empty and blank texts have no shingle, link with nothing and are their own component;
    * a null id links with nothing and has a null component; repeated ids share what their rows link with;
    * an empty table gives an empty table; only the two named columns are read.

    Equal sets are one node from the start.  Prefix lists hold only as many shingles of a set as a link needs (the
    most repeated shingles of the corpus come last in the order).  Lists are cut by size into blocks and entries are
    skipped by position.  First every set is verified against a few pivots of its blocks only.  A set that links has the
    answers of its pivot's component, so all pairs inside a component are skipped; what remains are pairs of one
    list in different components whose first shared shingle can be that of the list.  What their prefixes share bounds
    what they share in all, so only pairs with enough of it are verified exactly.  No link between components can
    be missed, and a group of copies costs one verification per member.  Shingles are compared by 64-bit fingerprints.
    """
    spark = prepared(docs.sparkSession)
    whole_ids(docs, id_column)
    rows = packed(docs, id=id_column, text=text_column).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def signatures(batches):
        shingler = Shingler(words)

        def build(part):
            found = shingler.sets(text_bytes(part.column("text")))
            return pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(x) for x in found], pa.int64()), pa.array([set_id(x) for x in found], pa.int64())], ["id", "size", "node"])

        return _in_batches(batches, build)

    def repeated(batches):
        """Shingles that several sets of a group have; a group is as many sets of a task as hold ``GROUP`` shingles."""
        shingler, held, n = Shingler(words), {}, 0

        def counted():
            token, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *held.values()]), return_counts=True)
            many = count > 1
            return pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(count[many], pa.int64())], ["token", "n"])

        for batch in batches:
            for part in bounded(batch, "text"):
                for found in shingler.sets(text_bytes(part.column("text"))):
                    held[set_id(found)] = found
                    n += len(found)
                if n >= GROUP:
                    yield counted()
                    held, n = {}, 0
        yield counted()

    late = rows.select("text").mapInArrow(repeated, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    late = materialize(late, "late")
    # the count that leaves no more than the bound above it
    common = late.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).limit(LATE_SHINGLES).collect()
    least = next((r.n + 1 for r, total in zip(common, np.cumsum([r.m for r in common])) if total > LATE_SHINGLES), 0)
    late = late.where(F.col("n") >= least).select("token", "n").toArrow().sort_by([("n", "descending"), ("token", "ascending")])
    sent = spark.sparkContext.broadcast(late.column("token").to_numpy().view(np.uint64))

    def postings(batches):
        shingler = Shingler(words)
        order = np.argsort(sent.value)
        known = sent.value[order]

        def build(part):
            tokens, sizes, nodes, places, seen = [], [], [], [], set()
            for found in shingler.sets(text_bytes(part.column("text"))):
                node = set_id(found)
                if not len(found) or node in seen:
                    continue
                seen.add(node)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    is_late = known[at] == found
                    if is_late.any():
                        # the most repeated come last of all
                        rank = order[at[is_late]]
                        found = np.concatenate((found[~is_late], found[is_late][np.argsort(-rank)]))
                length = prefix_length(len(found), percent)
                tokens.append(found[:length])
                sizes.append(np.full(length, len(found)))
                nodes.append(np.full(length, node))
                places.append(np.arange(length))
            if not tokens:
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (sizes, nodes, places))],
                ["token", "size", "node", "pos"])

        return _in_batches(batches, build)

    signed = materialize(rows.mapInArrow(signatures, "id long, size long, node long"), "signatures")
    classes = signed.where("size > 0 and id is not null").groupBy("node").agg(F.min("id").alias("id"))
    entries = rows.where("id is not null").select("text").mapInArrow(postings, "token long, size long, node long, pos long")
    lists = materialize(
        entries.repartition("token").sortWithinPartitions("token", "size", "node").mapInArrow(
            _lists, "token long, size long, node long, pos long"), "lists")

    def full_sets(batches):
        shingler = Shingler(words)

        def build(part):
            found = shingler.sets(text_bytes(part.column("text")))
            ids = [set_id(x) for x in found]
            kept = [i for i, node in enumerate(part.column("node").to_pylist()) if node == ids[i]]
            flat = np.concatenate([np.zeros(0, np.uint64), *(found[i] for i in kept)])
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in kept], pa.int64()), list_array(flat.view(np.int64), np.array([len(found[i]) for i in kept], np.int64))], ["node", "shingles"])

        return _in_batches(batches, build)

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """Pairs with the exact answer; only the sets that stand in a pair are read."""
        pairs = materialize(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes, "node").select("id", "node")
        sets = materialize(rows.join(wanted, "id").select("node", "text").mapInArrow(full_sets, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")
        common = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - common
        return materialize(pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", (common * 100 >= union * percent).alias("links")), label)

    # first the pivots of each size block of a list: the set that has the shingle earliest, which differs least from the
    # others, and some by the order of a hash, which is the same in all lists
    listed = lists.withColumn("block", F.floor(F.log("size") / float(np.log(100 / percent))))
    entry = [F.col(x) for x in ("node", "size", "pos")]
    chosen = [F.min(F.struct(F.col("pos").alias("order"), *entry)), *(F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("order"), *entry)) for i in range(HASHED_PIVOTS))]
    pivots = listed.groupBy("token", "block").agg(F.array(*chosen).alias("p"))
    first = listed.join(pivots, ["token", "block"]).select("token", "node", "size", "pos", F.explode("p").alias("p")).where("node <> p.node")
    first = first.select("token", "node", "size", "pos", F.col("p.node").alias("pivot"), F.col("p.size").alias("pivot_size"), F.col("p.pos").alias("pivot_pos")).distinct()
    need = F.ceil((F.col("size") + F.col("pivot_size")) * percent / (100 + percent))
    beyond = F.ceil(F.greatest("size", "pivot_size") * percent / 100) - 1
    early = (F.col("pos") <= F.col("size") - need) & (F.col("pivot_pos") <= F.col("pivot_size") - need)
    first = first.groupBy("node", "pivot").agg(F.count("*").alias("shared"), F.max(need - beyond).alias("least"), F.max(early).alias("early"))
    # each set meets the pivots it shares most lists with; a pair that shares few is not worth a look yet
    best = Window.partitionBy("node").orderBy(F.desc("shared"), "pivot")
    first = first.where("early and 2 * shared >= least").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PIVOTS)
    first = first.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    first = verified(first, "pivot_links")
    linked = components(first.where("links"))

    # then all pairs of lists that still hold more than one component
    entries = lists.join(linked, "node", "left").select("token", "size", "node", "pos", F.coalesce("component", "node").alias("component"))
    entries = materialize(entries, "entries")
    open_lists = entries.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    before = F.lag("token").over(Window.partitionBy("node").orderBy("pos"))
    entries = entries.join(open_lists, "token").withColumn("prior", F.coalesce(before, "token"))
    across = entries.repartition("token").sortWithinPartitions("token", "size", "node").mapInArrow(
        lambda batches: _across(batches, percent), "a long, b long").distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    # what two prefixes share bounds what the sets share: beyond its prefix a set has a known number of shingles
    prefixes = lists.groupBy("node").agg(F.first("size").alias("size"), F.collect_list("token").alias("tokens"))
    side = lambda name: prefixes.select(F.col("node").alias(name), F.struct("size", "tokens").alias(f"{name}_"))
    across = across.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_.tokens", "b_.tokens"))
    need = F.ceil((F.col("a_.size") + F.col("b_.size")) * percent / (100 + percent))
    beyond = F.ceil(F.greatest("a_.size", "b_.size") * percent / 100) - 1
    across = across.where(shared >= need - beyond).select("a", "b")
    second = verified(across, "links")

    joined = components(first.where("links").select("a", "b").unionByName(second.where("links").select("a", "b")))
    named = classes.join(joined, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    live = F.col("size") > 0
    return signed.withColumn("key", F.when(live & F.col("id").isNotNull(), F.col("node"))).join(
        named.withColumnRenamed("node", "key"), "key", "left").select(
        "id", F.col("size").alias("n_shingles"), F.when(live, F.col("node")).alias("set_id"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
