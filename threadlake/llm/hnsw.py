"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, kept as flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadlake.llm.common import GOLDEN, mix, prepared, whole_ids
from threadlake.session import materialize

#: Rows of a shard and queries of a block, on average.
SHARD_ROWS, QUERY_ROWS = 8192, 4096
#: Links of a new node on a layer; a node keeps twice as many on the lowest layer.
LINKS = 16
#: Candidates that a search holds while the graph is built and when it is queried.
BUILD_BEAM, SEARCH_BEAM = 96, 192
#: Nodes that are inserted, and queries that are searched, at once.
TOGETHER = 256
#: Candidates of the beam whose links are followed in one step.
STEP = 4


def usable(vector: Column) -> Column:
    """A vector that takes part: not null, all components finite, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows a (q, d) to their own rows b (q, k, d)."""
    away = b - a[:, None, :]
    return np.einsum("qkd,qkd->qk", away, away)


def _search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries on one layer: (nodes, squared distances), nearest first, -1 and inf where none.

    ``links`` holds the neighbours of a node as a row, -1 where none; ``entry`` (queries, entries) holds different nodes.
    """
    count = len(queries)
    rows = np.arange(count)[:, None]
    seen = np.zeros((count, len(links) + 1), bool)  # the last column stands for no node
    seen[rows, entry] = True
    seen[:, -1] = True
    nodes = np.full((count, max(beam, entry.shape[1])), -1)
    far = np.full(nodes.shape, np.inf, vectors.dtype)
    nodes[:, :entry.shape[1]] = entry
    far[:, :entry.shape[1]] = np.where(entry >= 0, _distances(queries, vectors[entry]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")[:, :beam]
    nodes, far = np.take_along_axis(nodes, order, 1), np.take_along_axis(far, order, 1)
    done = ~np.isfinite(far)
    active = np.arange(count)
    while True:
        active = active[~done[active].all(axis=1)]
        if not len(active):
            return nodes, far
        # the nearest candidates whose links were not followed yet
        pick = np.argsort(done[active], axis=1, kind="stable")[:, :STEP]
        fresh = ~np.take_along_axis(done[active], pick, 1)
        from_nodes = np.where(fresh, np.take_along_axis(nodes[active], pick, 1), -1)
        done[active[:, None], pick] = True
        found = np.where(from_nodes[..., None] >= 0, links[from_nodes], -1).reshape(len(active), -1)
        found[seen[active[:, None], found]] = -1
        seen[active[:, None], found] = True
        # two candidates may have the same neighbour: it counts once
        found = -np.sort(-found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        width = int((found >= 0).sum(axis=1).max(initial=0))
        if not width:
            continue
        found = -np.sort(-found, axis=1)[:, :width]
        reach = np.where(found >= 0, _distances(queries[active], vectors[found]), np.inf)
        nodes_all = np.concatenate([nodes[active], found], axis=1)
        far_all = np.concatenate([far[active], reach], axis=1)
        done_all = np.concatenate([done[active], ~np.isfinite(reach)], axis=1)
        order = np.argsort(far_all, axis=1, kind="stable")[:, :beam]
        nodes[active] = np.take_along_axis(nodes_all, order, 1)
        far[active] = np.take_along_axis(far_all, order, 1)
        done[active] = np.take_along_axis(done_all, order, 1)


def _select(vectors: np.ndarray, nodes: np.ndarray, far: np.ndarray, keep: int) -> np.ndarray:
    """Of candidates, nearest first (-1 and inf where none), ``keep`` that lie in different directions, then the nearest others."""
    count, width = nodes.shape
    there = vectors[nodes]
    square = np.einsum("ckd,ckd->ck", there, there)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(there, there.transpose(0, 2, 1))
    chosen = np.zeros((count, width), bool)
    taken = np.zeros(count, int)
    for k in range(width):
        # a candidate nearer to one that was chosen than to the node itself is reached through that one
        hidden = (chosen[:, :k] & (between[:, k, :k] < far[:, k:k + 1])).any(axis=1)
        chosen[:, k] = np.isfinite(far[:, k]) & ~hidden & (taken < keep)
        taken += chosen[:, k]
    rank = np.where(chosen, 0, np.where(np.isfinite(far), 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    out = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(nodes, order, 1), -1)
    return out if out.shape[1] == keep else np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


def _link_back(vectors: np.ndarray, links: np.ndarray, targets: np.ndarray, sources: np.ndarray) -> None:
    """Adds source to the links of target; a full list is selected anew."""
    width = links.shape[1]
    away = vectors[targets] - vectors[sources]
    order = np.lexsort((sources, np.einsum("kd,kd->k", away, away), targets))
    targets, sources = targets[order], sources[order]
    unique, first, number = np.unique(targets, return_index=True, return_counts=True)
    place = np.arange(len(targets)) - np.repeat(first, number)
    coming = np.full((len(unique), min(int(number.max()), 2 * width)), -1)
    near = place < coming.shape[1]
    coming[np.repeat(np.arange(len(unique)), number)[near], place[near]] = sources[near]
    both = np.concatenate([links[unique], coming], axis=1)
    fits = (both >= 0).sum(axis=1) <= width
    packed_rows = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :width]
    links[unique[fits]] = packed_rows[fits]
    if not fits.all():
        full, both = unique[~fits], both[~fits]
        far = np.where(both >= 0, _distances(vectors[full], vectors[both]), np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        both, far = np.take_along_axis(both, order, 1), np.take_along_axis(far, order, 1)
        for at in range(0, len(full), 512):
            links[full[at:at + 512]] = _select(vectors, both[at:at + 512], far[at:at + 512], width)


def build(vectors: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Links of each layer, the lowest first, of nodes whose ``levels`` fall: layer l holds the first nodes, those of level l and up.

    A layer is built by inserting its nodes in order, some at once: each is searched from its nearest node of the layer above,
    sees the others of its round as well, and is linked both ways.
    """
    layers: list[np.ndarray] = []
    for level in range(int(levels.max(initial=0)), -1, -1):
        size = int((levels >= level).sum())
        links = np.full((size, LINKS * (1 if level else 2)), -1, np.int64)
        above = layers[::-1]
        start = 0
        while start < size:
            stop = min(size, start + min(TOGETHER, max(64, start)))
            new, queries = np.arange(start, stop), vectors[start:stop]
            own = _distances(queries, np.broadcast_to(queries, (len(new), *queries.shape)))
            np.fill_diagonal(own, np.inf)
            nodes, far = np.broadcast_to(new, own.shape), own
            if start:
                entry = descend(vectors, above, queries)
                entry = np.where(entry < start, entry, 0)
                found, reach = _search(vectors, links[:start], queries, entry, BUILD_BEAM)
                nodes, far = np.concatenate([found, nodes], axis=1), np.concatenate([reach, far], axis=1)
            order = np.argsort(far, axis=1, kind="stable")[:, :BUILD_BEAM // 2]
            nodes, far = np.take_along_axis(nodes, order, 1), np.take_along_axis(far, order, 1)
            links[start:stop, :LINKS] = _select(vectors, nodes, far, LINKS)
            sources, column = np.nonzero(links[start:stop, :LINKS] >= 0)
            if len(sources):
                targets = links[start:stop][sources, column]
                # what two new nodes of a round chose both ways is there already
                known = (links[targets] == (sources + start)[:, None]).any(axis=1)
                if not known.all():
                    _link_back(vectors, links, targets[~known], (sources + start)[~known])
            start = stop
        layers.insert(0, links)
    return layers


def descend(vectors: np.ndarray, above: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """(queries, 1): the nearest node that a walk from the top through the layers ``above``, highest first, finds."""
    entry = np.zeros((len(queries), 1), int)
    for links in above:
        entry = _search(vectors, links, queries, entry, 8)[0][:, :1]
    return entry


def query(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, beam: int) -> np.ndarray:
    """Nodes that a search of the graph holds at its end, -1 where none; a shard that fits the beam is held whole."""
    if len(vectors) <= beam:
        return np.broadcast_to(np.arange(len(vectors)), (len(queries), len(vectors)))
    return _search(vectors, layers[0], queries, descend(vectors, layers[:0:-1], queries), beam)[0]


def _levels(ids: np.ndarray) -> np.ndarray:
    """Level of a node, falling exponentially, from a hash of its id."""
    spread = mix(ids.astype(np.int64).view(np.uint64) * GOLDEN + GOLDEN)
    uniform = ((spread >> np.uint64(11)).astype(np.float64) + 1) / 2.0 ** 53
    return np.floor(-np.log(uniform) / np.log(LINKS)).astype(int)


INDEX = "size int, shard int, scale double, ids binary, starts binary, vectors binary, widths array<int>, links array<binary>"


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard of vectors (id, vector, size) with different ids: its vectors, ids and graph as flat arrays, written.

    Shards are dealt by a hash of the id, so copies of a vector are spread; inside a shard equal vectors are one node that
    carries their ids (``starts`` says where each node's ids begin).  Vectors of different length never share a shard.
    """
    shards = rows.groupBy("size").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = rows.join(shards, "size").select("size", F.pmod(F.xxhash64("id"), "shards").cast("int").alias("shard"), "id", "vector")
    # a shard is small in bytes and long to build: stated partitions keep Spark from putting many into one task
    tasks = 2 * int(shards.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0])

    def graph(group: pa.Table) -> pa.Table:
        size, shard = group.column("size")[0].as_py(), group.column("shard")[0].as_py()
        ids = group.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        exact = np.asarray(group.column("vector").combine_chunks().flatten(), np.float64).reshape(-1, size)[order]
        ids = ids[order]
        vectors, first, node = np.unique(exact, axis=0, return_index=True, return_inverse=True)
        levels = _levels(ids[first])
        # nodes of high level come first; equal levels keep an order that has nothing to do with place
        ranked = np.lexsort((mix(ids[first].astype(np.int64).view(np.uint64)), -levels))
        number = np.empty(len(ranked), int)
        number[ranked] = np.arange(len(ranked))
        node = number[node.ravel()]
        by_node = np.lexsort((ids, node))
        starts = np.concatenate(([0], np.cumsum(np.bincount(node, minlength=len(ranked)))))
        vectors = vectors[ranked]
        scale = float(np.abs(vectors).max())  # squares of very small or large components stay in range
        layers = build((vectors / scale).astype(np.float32), levels[ranked])
        return pa.Table.from_pylist([{
            "size": size, "shard": shard, "scale": scale, "ids": ids[by_node].astype(np.int64).tobytes(), "starts": starts.astype(np.int64).tobytes(),
            "vectors": vectors.tobytes(), "widths": [x.shape[1] for x in layers], "links": [x.astype(np.int32).tobytes() for x in layers],
        }], schema=INDEX_ARROW)

    return materialize(dealt.repartition(tasks, "size", "shard").groupBy("size", "shard").applyInArrow(graph, INDEX), "graphs")


INDEX_ARROW = pa.schema([
    ("size", pa.int32()), ("shard", pa.int32()), ("scale", pa.float64()), ("ids", pa.binary()), ("starts", pa.binary()), ("vectors", pa.binary()),
    ("widths", pa.list_(pa.int32())), ("links", pa.list_(pa.binary()))])


def _nearest(group: pa.Table, asked: pa.Table, k: int, beam: int) -> pa.Table:
    """The ``k`` nearest vectors that one shard has for each query of a block, its own id left out."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if group.num_rows and asked.num_rows:
        held = group.slice(0, 1).to_pylist()[0]
        size = held["size"]
        ids, starts = np.frombuffer(held["ids"], np.int64), np.frombuffer(held["starts"], np.int64)
        exact = np.frombuffer(held["vectors"], np.float64).reshape(-1, size)
        layers = [np.frombuffer(x, np.int32).reshape(-1, w).astype(np.int64) for x, w in zip(held["links"], held["widths"])]
        small = (exact / held["scale"]).astype(np.float32)
        asked_ids = asked.column("id").to_numpy()
        asked_vectors = np.asarray(asked.column("vector").combine_chunks().flatten(), np.float64).reshape(-1, size)
        largest = float(np.finfo(np.float32).max) ** 0.5 / size
        for at in range(0, len(asked_ids), TOGETHER):
            own, mine = asked_ids[at:at + TOGETHER], asked_vectors[at:at + TOGETHER]
            nodes = query(small, layers, np.clip(mine / held["scale"], -largest, largest).astype(np.float32), beam)
            # a node gives its smallest ids, one more than asked for as the query's own may be among them
            row, column = np.nonzero(nodes >= 0)
            node = nodes[row, column]
            far = np.zeros(len(node))
            with np.errstate(over="ignore"):
                for d in range(size):  # one component after the other, in double precision
                    far += (mine[row, d] - exact[node, d]) ** 2
            far = np.sqrt(far)
            many = np.minimum(starts[node + 1] - starts[node], k + 1)
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found = ids[np.repeat(starts[node], many) + inside]
            row, far = np.repeat(row, many), np.repeat(far, many)
            other = found != own[row]
            row, found, far = row[other], found[other], far[other]
            order = np.lexsort((found, far, row))
            row, found, far = row[order], found[order], far[order]
            number = np.arange(len(row)) - np.searchsorted(row, row)
            best = number < k
            out.append((own[row[best]], found[best], far[best]))
    return pa.table({name: np.concatenate([x[i] for x in out]) for i, name in enumerate(("query_id", "id", "score"))})


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest vectors of an index for queries (id, vector, size) with different ids.

    Every shard is searched for every block of queries: a task holds one shard and one block, whatever the table's size.  A
    shard hands on ``k`` rows a query; the nearest of those are kept.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    blocks = queries.groupBy("size").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
    shards = index.groupBy("size").agg((F.max("shard") + 1).alias("shards"))
    numbers = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    asked = queries.join(blocks, "size").join(shards, "size").select(
        "size", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), numbers("shards").alias("shard"), "id", "vector")
    held = index.join(blocks, "size").withColumn("block", numbers("blocks"))
    found = held.groupBy("size", "shard", "block").cogroup(asked.groupBy("size", "shard", "block")).applyInArrow(
        lambda group, block: _nearest(group, block, k, beam), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest_neighbours(vectors: DataFrame, asked: Column, k: int = 10, beam: int = SEARCH_BEAM, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` vectors nearest to each vector for whose id ``asked`` (a condition on ``id``) holds.

    * nearness is Euclidean distance, in double precision on the original vectors, ties go to the smaller id; a vector's own
      id is no answer; fewer candidates than ``k`` are all returned;
    * null and zero vectors, vectors with null or non-finite components and null ids take no part; vectors are compared with
      those of their own length only;
    * rows that share an id are one vector: the smallest in the order of arrays;
    * an empty table gives an empty table; only the two named columns are read.

    Candidates come from a graph per shard (``build_index``); the distances of what a search holds at its end are exact.
    """
    prepared(vectors.sparkSession)
    whole_ids(vectors, id_column)
    rows = vectors.select(vectors[id_column].cast("long").alias("id"), vectors[vector_column].cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = materialize(rows.withColumn("size", F.size("vector")), "vectors")
    return search(build_index(rows), rows.where(asked), k, beam)
