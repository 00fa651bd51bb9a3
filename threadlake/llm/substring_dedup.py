"""Exact substring deduplication by bucket-pointer refinement of sampled suffixes.

Every byte position has a bucket identifier of its q-gram (q is a quarter of the match length).  Identifiers of longer
strings come from those of later offsets: b(2q, p) from b(q, p) and b(q, p + q), and once more for 4q.  Each round sorts
only what the round before has not settled:

1. Runs of windows that share their least q-gram identifier are one sampled suffix each (about one in 38 positions for
   100 bytes).  They are sorted by that identifier and by the identifier of all their bytes.  Runs equal to an earlier run
   are repeated as a whole; buckets with one run in them are settled.
2. Runs that share a bucket with a different run are open.  The same is done again inside them with 2q-grams.
3. What is open then is refined to single windows, sorted by their full identifier; all but the first are repeated.
4. Repeated windows go back to their document and are cut out of it.

A document is an id with a fingerprint of its text, so places found in one text never cut another one under the same id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from threadlake.llm.common import GOLDEN, mix, packed, power_table, prefix_sums, prepared, text_bytes, whole_ids
from threadlake.session import materialize

PIECE_BYTES = 1 << 20
LONE, SELF, DONE = 0, 1, 2
LEAST_ID = -(1 << 63)


class Buckets:
    """Bucket identifiers of the strings of some lengths that start at each byte of joined pieces."""

    BASE = 0xA24BAED4963EE407 | 1

    def __init__(self, length: int):
        if length % 4:
            raise ValueError("the match length must be a multiple of 4")
        self.length = length
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def load(self, joined: bytes) -> None:
        data = np.frombuffer(joined, np.uint8)
        if len(self.powers) < len(data) + 1:
            size = max(len(data) + 1, PIECE_BYTES + (1 << 16))
            self.powers = power_table(self.BASE, size)
            self.inverse = power_table(pow(self.BASE, -1, 1 << 64), size)
        self.total = prefix_sums(self.value, data, self.powers)
        self.size = len(data)

    def strings(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix((self.total[start + length] - self.total[start]) * self.inverse[start] + length.astype(np.uint64) * GOLDEN)

    def grams(self, length: int) -> np.ndarray:
        """Identifiers of all strings of a quarter, half or whole window; longer ones from two at later offsets."""
        reach = self.length // 4
        n = max(0, self.size - reach + 1)
        found = mix((self.total[reach:] - self.total[:n]) * self.inverse[:n])
        while reach < length:
            found = mix(found[:len(found) - reach] * GOLDEN + found[reach:]) if len(found) > reach else found[:0]
            reach *= 2
        return found


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over ``width`` consecutive values."""
    reach = 1
    while reach * 2 <= width:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return pick(values[:len(values) - rest], values[rest:]) if rest else values


class Names:
    """The documents of a group of pieces, (id, fingerprint) in order; a piece holds the rank of its document."""

    def __init__(self, ids: list[int], prints: list[int]):
        known = np.zeros(len(ids), [("id", np.int64), ("print", np.int64)])
        known["id"], known["print"] = ids, prints
        known, self.rank = np.unique(known, return_inverse=True)
        self.id, self.print = known["id"].copy(), known["print"].copy()


def pieces(ids: list[int], prints: list[int], bases: list[int], texts: list[bytes], length: int) -> Iterator[tuple[Names, np.ndarray, list[bytes]]]:
    """Groups of about a megabyte: (documents, offset in the document, bytes); long texts in pieces that overlap by a window less one."""
    own, marks, base, parts, held = [], [], [], [], 0
    for key, mark, start, text in zip(ids, prints, bases, texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE_BYTES):
            part = text[at:at + PIECE_BYTES + length - 1]
            if len(part) < length:
                continue
            if held and held + len(part) > PIECE_BYTES:
                yield Names(own, marks), np.array(base, np.int64), parts
                own, marks, base, parts, held = [], [], [], [], 0
            own.append(key)
            marks.append(mark)
            base.append(start + at)
            parts.append(part)
            held += len(part)
    if parts:
        yield Names(own, marks), np.array(base, np.int64), parts


def _places(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For joined pieces: which byte starts a window inside its piece, and the start of each piece."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    offsets = np.cumsum(sizes) - sizes
    valid = np.ones(int(sizes.sum()), bool)
    for end in offsets + sizes:
        valid[end - length + 1:end] = False
    return valid, offsets


def runs_of(buckets: Buckets, q: int, names: Names, base: np.ndarray, parts: list[bytes]):
    """Runs of windows with one least q-gram: (least, identifier of all bytes, document, place, windows, repeats inside)."""
    length, width = buckets.length, buckets.length - q + 1
    valid, offsets = _places(parts, length)
    buckets.load(b"".join(parts))
    grams = buckets.grams(q)
    least = sliding(grams, width, np.minimum)
    valid = valid[:len(least)]
    changed = np.flatnonzero(least[1:] != least[:-1]) + 1
    first, last = valid.copy(), valid.copy()
    first[1:] &= ~valid[:-1]
    last[:-1] &= ~valid[1:]
    first[changed] = valid[changed]
    last[changed - 1] = valid[changed - 1]
    starts = np.flatnonzero(first)
    count = np.flatnonzero(last) - starts + 1
    # a q-gram place is the least of some window when the largest minimum of the windows that hold it is its own;
    # a run that has its least q-gram at two places may hold equal windows
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(sliding(np.concatenate((edge, np.where(valid, least, np.uint64(0)), edge)), width, np.maximum) == grams)
    lo, hi = np.searchsorted(chosen, starts), np.searchsorted(chosen, starts + count + width - 1)
    run = np.repeat(np.arange(len(starts)), hi - lo)
    place = np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    places = np.bincount(run[grams[chosen[place]] == least[starts[run]]], minlength=len(starts))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    return least[starts], buckets.strings(starts, count + length - 1), names.rank[owner], starts - offsets[owner] + base[owner], count, places > 1


def windows_of(buckets: Buckets, names: Names, base: np.ndarray, parts: list[bytes]):
    """(full identifier, document, place) of every window of the pieces."""
    valid, offsets = _places(parts, buckets.length)
    buckets.load(b"".join(parts))
    full = buckets.grams(buckets.length)
    at = np.flatnonzero(valid[:len(full)])
    owner = np.searchsorted(offsets, at, side="right") - 1
    return full[at], names.rank[owner], at - offsets[owner] + base[owner]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the row before in any key."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return fresh


def _merged(own: np.ndarray, place: np.ndarray, count: np.ndarray):
    """Adjacent or overlapping stretches of windows as one."""
    order = np.lexsort((place, own))
    own, place, count = own[order], place[order], count[order]
    end = place + count
    # stretches of one text never contain each other, so comparing neighbours is enough
    fresh = np.ones(len(own), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (place[1:] > end[:-1])
    starts = np.flatnonzero(fresh)
    stops = np.append(starts[1:], len(own)) - 1
    return own[starts], place[starts], end[stops] - place[starts]


def _rows(names: Names, bucket, refined, own, place, count, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(bucket, np.uint64).view(np.int64)), pa.array(np.asarray(refined, np.uint64).view(np.int64)),
         pa.array(names.id[own]), pa.array(names.print[own]), pa.array(place, pa.int64()), pa.array(np.asarray(count, np.int64) * 4 + kind, pa.int64())],
        ["bucket", "refined", "id", "print", "place", "size"])


def _with_local(names: Names, bucket, refined, own, place, count, kind) -> Iterator[pa.RecordBatch]:
    """Rows for the shuffle; of equal strings in one group only the first stays, the others are known to be repeated.

    A string at the same place of the same document again, of a repeated row, is the same start and no repeat.
    """
    order = np.lexsort((place, own, refined, bucket))
    order = order[_firsts(bucket[order], refined[order], own[order], place[order])]
    bucket, refined, own, place, count, kind = (x[order] for x in (bucket, refined, own, place, count, kind))
    fresh = _firsts(bucket, refined)
    yield _rows(names, bucket[fresh], refined[fresh], own[fresh], place[fresh], count[fresh], kind[fresh])
    if not fresh.all():
        own, place, count = _merged(own[~fresh], place[~fresh], count[~fresh])
        spread = mix((names.id[own] ^ names.print[own]).view(np.uint64) * GOLDEN + place.view(np.uint64))
        yield _rows(names, spread, spread, own, place, count, np.full(len(own), DONE))


ROWS = "bucket long, refined long, id long, print long, place long, size long"
FOUND = "id long, print long, place long, size long, open boolean"


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket, refined, id, print, place: repeated stretches, and open ones that need a finer look.

    What is kept from batch to batch is one row, however large a bucket is.
    """
    before = None  # bucket, refined, id, print and place of the last row, and the first row of the bucket while it is alone
    for batch in batches:
        bucket, refined, own, mark, place, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        count, kind = size >> 2, size & 3
        known = kind == DONE
        out = [(own[known], mark[known], place[known], count[known], np.zeros(int(known.sum()), bool))]
        start = _firsts(bucket, refined, own, mark, place) & ~known
        # the first row that is not known may be the start the batch before has ended with
        first = np.flatnonzero(~known)[:1]
        start[first] = [before is None or before[:5] != (bucket[i], refined[i], own[i], mark[i], place[i]) for i in first]
        bucket, refined, own, mark, place, count, kind = (x[start] for x in (bucket, refined, own, mark, place, count, kind))
        if len(bucket):
            same_bucket = ~_firsts(bucket)
            same = ~_firsts(bucket, refined)
            held = None
            if before is not None and before[0] == bucket[0]:
                same_bucket[0], same[0] = True, before[1] == refined[0]
                held = before[5]
            out.append((own[same], mark[same], place[same], count[same], np.zeros(int(same.sum()), bool)))
            group = np.cumsum(~same_bucket)
            group -= group[0]
            stays = ~same
            others = np.bincount(group[stays], minlength=group[-1] + 1)
            carried = before is not None and same_bucket[0]
            crowded = others > 1
            if carried:
                crowded[0] = others[0] > 0
                if crowded[0] and held is not None:
                    out.append(tuple(np.array([x]) for x in held) + (np.array([True]),))
                    held = None
            open_ = stays & (crowded[group] | (kind == SELF))
            out.append((own[open_], mark[open_], place[open_], count[open_], np.ones(int(open_.sum()), bool)))
            last = group[-1]
            if not (carried and last == 0):
                first = np.flatnonzero(group == last)[0]
                held = None if crowded[last] or kind[first] == SELF else (own[first], mark[first], place[first], count[first])
            before = (bucket[-1], refined[-1], own[-1], mark[-1], place[-1], held)
        own, mark, place, count, open_ = (np.concatenate([x[i] for x in out]) for i in range(5))
        if len(own):
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in (own, mark, place, count)), pa.array(open_, pa.bool_())], ["id", "print", "place", "size", "open"])


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """For a column of lists of structs: the row of each element, and the elements; a null list is empty."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def _covered(column: pa.Array, beyond: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the stretches of a column with overlapping or adjacent ones merged; ends reach ``beyond`` further."""
    row, found = _lists(column)
    start = found.field("place").to_numpy(zero_copy_only=False)
    end = start + found.field("size").to_numpy(zero_copy_only=False) + beyond
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    shift = row * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + shift) if len(end) else end
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] + shift[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row)) - 1 if len(row) else first
    return row[first], start[first], reach[last] - shift[last]


def drop_repeated_substrings(docs: DataFrame, length: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row without the bytes covered by a ``length``-byte string that also starts earlier.

    Texts are UTF-8 bytes (null is empty).  Ids are whole numbers; others are refused.  Earlier is a smaller id, or a smaller
    start in the same document; strings are judged on the input.  Returns ``doc`` (the input columns without the text), ``n_bytes``, ``kept`` (binary,
    the remaining bytes), ``spans`` (maximal removed runs: start and end in bytes).

    * texts shorter than ``length`` keep everything; so does an empty or null text;
    * rows with the same id and the same text count as one document, each of them is cut like the others: equal offsets
      are the same start.  Different texts under one id, or under no id, are documents of their own, ordered by a fingerprint
      of the text.  A null id comes before all others;
    * an empty table gives an empty table; other columns are carried in ``doc`` under any name.

    Strings are compared by 64-bit identifiers (128 bits for whole runs).
    """
    prepared(docs.sparkSession)
    least_id = F.lit(LEAST_ID).cast("long")
    whole_ids(docs, id_column)
    rows = packed(docs, (text_column,), id=id_column, text=text_column).select(
        "doc", F.coalesce(F.col("id").cast("long"), least_id).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"),
        F.col("text").cast("binary").alias("text"))

    def groups(batches):
        for batch in batches:
            row, parts = _lists(batch.column("parts"))
            names = (np.asarray(batch.column(name))[row].tolist() for name in ("id", "print"))
            yield from pieces(*names, parts.field("base").to_pylist(), text_bytes(parts.field("text")), length)

    def runs(q):
        def run(batches):
            buckets = Buckets(length)
            for group in groups(batches):
                bucket, whole, own, place, count, inside = runs_of(buckets, q, *group)
                if len(bucket):
                    yield from _with_local(group[0], bucket, whole, own, place, count, np.where(inside, SELF, LONE))
        return run

    def windows(batches):
        buckets = Buckets(length)
        for group in groups(batches):
            full, own, place = windows_of(buckets, *group)
            if len(full):
                yield from _with_local(group[0], full, full, own, place, np.ones(len(full), np.int64), np.zeros(len(full), np.int64))

    def resolved(frame: DataFrame) -> DataFrame:
        return frame.repartition("bucket").sortWithinPartitions("bucket", "refined", "id", "print", "place").mapInArrow(_resolve, FOUND)

    def per_document(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("id", "print").agg(F.collect_list(F.struct("place", "size")).alias(name))

    def narrow(batches):
        """The bytes of the open stretches, neighbours merged: one row per document."""
        kind = pa.list_(pa.struct([("base", pa.int64()), ("text", pa.binary())]))
        for batch in batches:
            of, held = _lists(batch.column("parts"))
            base, texts = held.field("base").to_numpy(zero_copy_only=False), text_bytes(held.field("text"))
            parts = [[] for _ in range(batch.num_rows)]
            for row, a, b in zip(*(x.tolist() for x in _covered(batch.column("open"), 0))):
                lo, hi = np.searchsorted(of, (row, row + 1))
                i = lo + int(np.searchsorted(base[lo:hi], a, side="right")) - 1
                parts[row].append({"base": a, "text": texts[i][a - base[i]:b - base[i] + length - 1]})
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("print"), pa.array(parts, kind)], ["id", "print", "parts"])

    part = F.struct(F.lit(0).cast("long").alias("base"), "text")
    texts = rows.select("id", "print", F.array(part).alias("parts"))
    repeated = []
    for q in (length // 4, length // 2):
        found = materialize(resolved(texts.mapInArrow(runs(q), ROWS)), "runs")
        repeated.append(found.where("not open"))
        texts = materialize(texts.join(per_document(found.where("open"), "open"), ["id", "print"]).mapInArrow(
            narrow, "id long, print long, parts array<struct<base: long, text: binary>>"), "open")
    repeated.append(materialize(resolved(texts.mapInArrow(windows, ROWS)).where("not open"), "windows"))
    repeated = repeated[0].unionByName(repeated[1]).unionByName(repeated[2])
    joined = rows.join(per_document(repeated, "repeated"), ["id", "print"], "left")

    def cut(batches):
        for batch in batches:
            kept, spans, sizes = [], [], []
            row, start, end = _covered(batch.column("repeated"), length - 1)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for i, text in enumerate(text_bytes(batch.column("text"))):
                own = slice(bounds[i], bounds[i + 1])
                ends = list(zip(start[own].tolist(), end[own].tolist()))
                at, parts = 0, []
                for a, b in ends:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                kept.append(b"".join(parts))
                spans.append([{"start": a, "end": b} for a, b in ends])
                sizes.append(len(text))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["doc", "n_bytes", "kept", "spans"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([rows.schema["doc"], T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", span)])
    return joined.select("doc", "text", "repeated").mapInArrow(cut, out)
