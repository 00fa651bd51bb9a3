"""Row- and byte-bounded pages over ordered stores, and bounded batches.

Greedy paging is sequential: a page ends where the next row would exceed a bound.
It still runs in parallel.  A store is cut into blocks of consecutive rows.  A page
has at most ``max_rows`` rows, so a block can only be entered at one of its first
``max_rows`` rows.  Step one computes, for each of these entries, where the page
chain enters the next block and how many pages start on the way.  Step two finds the
entry of every block: the steps of ``SECTION`` blocks are composed, one entry per
section is followed along each store, then one per block inside its section.  Step
three numbers the pages of each block from its true entry.  No task holds more than
one block, or ``max_rows`` rows for each block of a section.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.operators.ordered import position
from threadlake.session import materialize


SECTION = 256


def _next_starts(sizes: np.ndarray, max_rows: int, max_bytes: int) -> np.ndarray:
    """For each row the first row after a page that starts there, by two pointers."""
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.searchsorted(prefix, prefix[:-1] + max_bytes, side="right") - 1
    starts = np.arange(len(sizes))
    return np.minimum(np.maximum(ends, starts + 1), np.minimum(starts + max_rows, len(sizes)))


def _jumps(nxt: np.ndarray) -> list[np.ndarray]:
    """Tables of the 1st, 2nd, 4th, 8th ... page start after each row; rows of the next block are ends that stay where they are."""
    table = np.concatenate([nxt, np.arange(len(nxt), nxt.max(initial=0) + 1)])
    tables = [table]
    while (table[:len(nxt)] < len(nxt)).any():
        table = table[table]
        tables.append(table)
    return tables


def _chain(tables: list[np.ndarray], own: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry row the first page start behind the block and the number of pages that start inside it, by pointer doubling."""
    at, count = entries.copy(), np.zeros(len(entries), dtype=np.int64)
    for k in range(len(tables) - 1, -1, -1):
        inside = (at < own) & (tables[k][at] < own)
        count += inside.astype(np.int64) << k
        at = np.where(inside, tables[k][at], at)
    last = at < own
    return np.where(last, tables[0][at], at), count + last


def _starts_of(tables: list[np.ndarray], entry: int, count: int) -> np.ndarray:
    """The page starts of a chain: the i-th is found by the bits of i."""
    number, at = np.arange(count), np.full(count, entry)
    for k, table in enumerate(tables):
        at = np.where(number >> k & 1, table[at], at)
    return at


def pages(
    records: DataFrame, store: str, ordinal: str, size: str, max_rows: int = 100,
    max_bytes: int = 512 * 1024, block_rows: int = 1 << 20,
) -> DataFrame:
    """Adds ``page`` (0-based inside the store) to the records.

    ``ordinal`` is an integer that is unique inside a store; a null size counts as no bytes.  Inside a block page starts are
    followed by pointer doubling over tables, not row by row.
    """
    block_rows = max(block_rows, max_rows)
    placed = position(records, [store], ordinal, "_pos")
    placed = placed.withColumn("_block", F.floor(F.col("_pos") / block_rows).cast("bigint"))
    sizes = placed.select(F.col(store).alias("store"), F.col("_pos").alias("pos"),
                          F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"), F.col("_block").alias("block"))
    # the first rows of a block also go to the block before it, where a page may cross over
    lead = sizes.where((F.col("pos") % block_rows < max_rows) & (F.col("block") > 0))
    with_lead = sizes.unionByName(lead.withColumn("block", F.col("block") - 1))

    def entries(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, first = pdf["pos"].to_numpy(), int(key[1]) * block_rows
        own = int((pos < first + block_rows).sum())
        nxt = _next_starts(pdf["size"].to_numpy(dtype=np.int64), max_rows, max_bytes)
        n = min(max_rows, own)
        exit_at, count = _chain(_jumps(nxt[:own]), own, np.arange(n))
        return pd.DataFrame({"store": key[0], "block": key[1], "entry": np.arange(n), "exit": exit_at - own, "pages": count})

    store_type = sizes.schema["store"].dataType.simpleString()
    table = with_lead.groupBy("store", "block").applyInPandas(
        entries, f"store {store_type}, block bigint, entry bigint, exit bigint, pages bigint")

    def followed(pdf: pd.DataFrame, step: str, entry: int, page: int) -> list[tuple]:
        """(step, entry, first page) along consecutive steps of one store."""
        ways = {(b, e): (x, p) for b, e, x, p in pdf[[step, "entry", "exit", "pages"]].itertuples(index=False)}
        out = []
        for at in range(int(pdf[step].min()), int(pdf[step].max()) + 1):
            out.append((at, entry, page))
            entry, count = ways.get((at, entry), (0, 0))
            page += count
        return out

    # blocks are chained in groups: what a group does to each entry, then one entry per group, then one per block
    grouped = table.withColumn("section", F.floor(F.col("block") / SECTION).cast("bigint"))

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ways = {b: g.set_index("entry") for b, g in pdf.groupby("block")}
        entry, total = np.arange(max_rows), np.zeros(max_rows, dtype=np.int64)
        for block in sorted(ways):
            way = ways[block][["exit", "pages"]].reindex(entry).fillna(0).astype(np.int64)
            total, entry = total + way["pages"].to_numpy(), way["exit"].to_numpy()
        return pd.DataFrame({"store": key[0], "section": key[1], "entry": np.arange(max_rows), "exit": entry, "pages": total})

    sections = grouped.groupBy("store", "section").applyInPandas(
        compose, f"store {store_type}, section bigint, entry bigint, exit bigint, pages bigint")

    def enter(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(key[0], *row) for row in followed(pdf, "section", 0, 0)]
        return pd.DataFrame(rows, columns=["store", "section", "entry", "first_page"])

    entered = sections.groupBy("store").applyInPandas(enter, f"store {store_type}, section bigint, entry bigint, first_page bigint")

    def inside(key: tuple, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows = [(key[0], *row) for row in followed(pdf, "block", int(start["entry"].iloc[0]), int(start["first_page"].iloc[0]))]
        return pd.DataFrame(rows, columns=["store", "block", "entry", "first_page"])

    starts = grouped.groupBy("store", "section").cogroup(entered.groupBy("store", "section")).applyInPandas(
        inside, f"store {store_type}, block bigint, entry bigint, first_page bigint")

    def number(key: tuple, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        own = int((pdf["pos"] < (int(key[1]) + 1) * block_rows).sum())
        nxt = _next_starts(pdf["size"].to_numpy(dtype=np.int64), max_rows, max_bytes)
        entry, page = int(start["entry"].iloc[0]), int(start["first_page"].iloc[0])
        tables = _jumps(nxt[:own])
        _, count = _chain(tables, own, np.array([entry]))
        starts_here = _starts_of(tables, entry, int(count[0]))
        page_of = page - 1 + np.searchsorted(starts_here, np.arange(own), side="right")
        return pd.DataFrame({"store": key[0], "pos": pdf["pos"].to_numpy()[:own], "page": page_of})

    numbered = with_lead.groupBy("store", "block").cogroup(starts.groupBy("store", "block")).applyInPandas(
        number, f"store {store_type}, pos bigint, page bigint")
    numbered = numbered.select(F.col("store").alias(store), F.col("pos").alias("_pos"), "page")
    return placed.drop("_block").join(numbered, [store, "_pos"]).drop("_pos")


def page_summary(paged: DataFrame, store: str, ordinal: str, size: str) -> DataFrame:
    return paged.groupBy(store, "page").agg(
        F.count("*").alias("rows"), F.sum(size).cast("bigint").alias("bytes"), F.min(ordinal).alias("first"), F.max(ordinal).alias("last"))


def _level(left: int) -> tuple[int, int]:
    """The largest power of two that is not over what is left (1 for nothing), and the bytes that may go before less than that is left."""
    step = 1 << max(left.bit_length() - 1, 0)
    return step, max(left - step, 0)


POWERS = np.array([1 << i for i in range(63)], dtype=np.int64)


def _classes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each size class of a block (sizes of one bit length): rows, bytes, and the least space that lets one of its items in
    when all smaller classes before it are taken."""
    sizes = pdf.sort_values("key")["size"].to_numpy(dtype=np.int64)
    kind = np.searchsorted(POWERS, sizes, side="right")
    rows = []
    for one in np.unique(kind).tolist():
        own = kind == one
        before = np.cumsum(np.where(kind < one, sizes, 0))
        rows.append((key[0], one, int(own.sum()), int(sizes[own].sum()), int((sizes + before)[own].min())))
    return pd.DataFrame(rows, columns=["block", "kind", "n", "bytes", "least"])


def _walk(sizes: np.ndarray, left: int, room: int) -> list[tuple[int, int, bool, int, int]]:
    """Phases inside a block: (last row, power of two, whether that row is taken for sure, bytes and items left)."""
    out, at = [], 0
    while at < len(sizes) and room > 0:
        step, spare = _level(left)
        rest = sizes[at:]
        small = rest < step
        total, number = np.cumsum(np.where(small, rest, 0)), np.cumsum(small)
        before = np.where(small, total - rest, total)
        ends = (rest <= left - before) & (~small | (total > spare) | (number >= room))
        if not ends.any():
            out.append((len(sizes) - 1, step, False, left - int(total[-1]), room - int(number[-1])))
            break
        end = int(np.argmax(ends))
        left -= int(before[end] + rest[end])
        room -= int(number[end]) + (not small[end])
        at += end + 1
        out.append((at - 1, step, True, left, room))
    return out


def bounded_batch(items: DataFrame, order: str, size: str, max_items: int, max_bytes: int, block_rows: int = 1 << 18) -> DataFrame:
    """Next maintenance batch in ``order``: an item that does not fit is passed over, later smaller ones may fit.

    Adds ``selected``.  While between 2**k and 2**(k+1) bytes are left, every item under 2**k fits, and one of 2**k or more that is
    taken leaves less than 2**k.  So the batch is a chain of at most 64 phases; in each all items under its power of two are taken,
    up to the row that ends it.  The block of that row is found by running sums over the size classes of blocks of consecutive rows,
    the row inside that one block.  The number of jobs depends on neither the items passed over nor ``max_items``.

    ``order`` is unique and not null; an item without a size is never taken; sizes are not negative.
    """
    known = items.where(F.col(size) <= max_bytes).select(F.col(order).alias("key"), F.col(size).cast("bigint").alias("size"))
    blocks = max(1, -(-known.count() // block_rows))
    placed = materialize(known.repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id()), "items")
    classes = materialize(placed.groupBy("block").applyInPandas(_classes, "block int, kind int, n bigint, bytes bigint, least bigint"), "classes")
    key_type = placed.schema["key"].dataType.simpleString()
    phases: list[tuple] = []  # last key (null for all that follow), power of two, whether the last key itself is taken
    left, room, at = max_bytes, max_items, -1
    while room > 0 and left >= 0:
        step, spare = _level(left)
        bits = step.bit_length()
        small = F.col("kind") < bits
        found = (
            classes.where((F.col("block") > at) & (F.col("kind") <= bits)).groupBy("block")
            .agg(F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(small, F.col("bytes"))), F.lit(0)).alias("bytes"),
                 F.min(F.when(~small, F.col("least"))).alias("least"))
            .withColumns({"total": F.sum("bytes").over(Window.orderBy("block")), "number": F.sum("n").over(Window.orderBy("block"))})
            .where((F.col("total") > spare) | (F.col("total") - F.col("bytes") + F.col("least") <= left) | (F.col("number") >= room))
            .orderBy("block").first())
        if found is None:
            phases.append((None, step, False))
            break
        at, left, room = found["block"], left - (found["total"] - found["bytes"]), room - (found["number"] - found["n"])

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("key")
            ends = _walk(pdf["size"].to_numpy(dtype=np.int64), left, room)
            rows = [(i, *end[1:]) for i, end in enumerate(ends)]
            out = pd.DataFrame(rows, columns=["i", "step", "taken", "left", "room"])
            return out.assign(key=pdf["key"].iloc[[end[0] for end in ends]].to_numpy())

        walked = placed.where(F.col("block") == at).groupBy("block").applyInPandas(
            walk, f"i int, key {key_type}, step bigint, taken boolean, left bigint, room bigint")
        ends = walked.agg(F.sort_array(F.collect_list(F.struct("i", "key", "step", "taken", "left", "room")))).first()[0]
        phases += [(end["key"], end["step"], end["taken"]) for end in ends]
        left, room = ends[-1]["left"], ends[-1]["room"]
    selected = F.lit(False)
    for last, step, taken in reversed(phases):
        inside = F.col(size) < step
        if last is not None:
            inside = F.when(F.col(order) <= F.lit(last), inside | (F.lit(taken) & (F.col(order) == F.lit(last)))).otherwise(selected)
        selected = inside
    return items.withColumn("selected", F.coalesce(selected, F.lit(False)))
