"""Benchmark decontamination by an FM-index of every training shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from threadlake.llm.common import Words, bounded, list_array, packed, prepared, text_bytes

#: Bytes between words once A-Z is lowered: ASCII other than digits and letters.
SEPARATORS = (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
SHARD_BYTES = 4 << 20
#: Words of benchmark text whose windows travel with one pass over the documents (8 bytes each).
BLOCK_WORDS = 1 << 20
SAMPLE_RATE = 8
SPAN = "struct<first:int,last:int,start:int,end:int>"


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Positions in the order of the suffixes that start there; an end is smaller than any symbol.

    As many symbols as fit one word give the first ranks, each further round doubles the depth until no two
    suffixes share a rank.
    """
    n = len(symbols)
    reach = max(1, 62 // bits)
    padded = np.concatenate((symbols, np.zeros(reach, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(reach):
        key = (key << bits) | padded[j:j + n]
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n or reach >= 2 * n:
            return order
        later = np.concatenate((rank[reach:], np.zeros(min(reach, n), np.int64)))
        key = rank * (n + 1) + later
        reach *= 2


class WaveletTree:
    """Ranks of symbols, one level of bits below the other, zeros left and ones right."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(bool)
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((shift, bit, ones, zeros))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix that ends at ``at`` ends on the lowest level, among equal symbols."""
        for shift, _, ones, zeros in self.levels:
            one = ones[at]
            at = np.where((symbol >> shift) & 1, zeros + one, at - one)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a place and its place on the lowest level."""
        symbol = np.zeros(len(at), np.int64)
        for shift, bit, ones, zeros in self.levels:
            is_one, one = bit[at], ones[at]
            symbol |= is_one.astype(np.int64) << shift
            at = np.where(is_one, zeros + one, at - one)
        return symbol, at


class FMIndex:
    """Index of one shard over symbols 1..sigma, with a 0 after each run.

    Positions are sampled at a rate and at the start of every run, so a walk back never leaves its run.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, rate: int = SAMPLE_RATE):
        bits = max(1, int(sigma).bit_length())
        order = suffix_order(symbols, bits)
        before = symbols[order - 1]
        self.tree = WaveletTree(before, bits)
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.below = np.concatenate(([0], np.cumsum(counts)))[:-1]
        every = np.arange(sigma + 1)
        self.origin = self.tree.down(every, np.zeros(sigma + 1, np.int64))
        self.size = len(symbols)
        sampled = (order % rate == 0) | (before == 0)
        self.sampled, self.places = sampled, order[sampled]
        self.sampled_before = np.concatenate(([0], np.cumsum(sampled)))

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of every phrase; a phrase is the last ``length`` symbols of its line."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > step) & (hi > lo))
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - step]
            shift = self.below[symbol] - self.origin[symbol]
            lo[live] = shift + self.tree.down(symbol, lo[live])
            hi[live] = shift + self.tree.down(symbol, hi[live])
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, position) of every occurrence."""
        found = hi - lo
        found[found < 0] = 0
        phrase = np.repeat(np.arange(len(lo)), found)
        row = np.arange(int(found.sum())) - np.repeat(np.cumsum(found) - found, found) + np.repeat(lo, found)
        place, open_, steps = np.empty(len(row), np.int64), np.arange(len(row)), 0
        while len(open_):
            known = self.sampled[row[open_]]
            done = open_[known]
            place[done] = self.places[self.sampled_before[row[done]]] + steps
            open_ = open_[~known]
            symbol, at = self.tree.access(row[open_])
            row[open_] = self.below[symbol] + at - self.origin[symbol]
            steps += 1
        return phrase, place


class Phrases:
    """Distinct windows of a block of items as symbols of the block's own vocabulary."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        known = [np.array(words, np.int64).view(np.uint64) for _, words in items]
        self.vocabulary = np.unique(np.concatenate([*known, np.zeros(0, np.uint64)]))
        self.window = window
        owners: dict[bytes, set[int]] = {}
        self.names = [name for name, _ in items]
        for i, words in enumerate(known):
            symbols = np.searchsorted(self.vocabulary, words) + 1
            for at in range(max(1, len(symbols) - window + 1) if len(symbols) else 0):
                line = np.zeros(window, np.int64)
                part = symbols[at:at + window]
                line[window - len(part):] = part
                owners.setdefault(line.tobytes(), set()).add(i)
        lines = list(owners)
        self.lines = np.frombuffer(b"".join(lines), np.int64).reshape(len(lines), window)
        self.lengths = (self.lines > 0).sum(axis=1)
        self.shortest = int(self.lengths.min()) if len(lines) else 0
        listed = [sorted(owners[x]) for x in lines]
        self.owner_count = np.array([len(x) for x in listed], np.int64)
        self.owner_start = np.cumsum(self.owner_count) - self.owner_count
        self.owners = np.array([x for one in listed for x in one], np.int64)

    def find(self, hashes: np.ndarray, owner: np.ndarray):
        """(first word, number of words, phrase) of every occurrence in a shard, by its FM-index."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.lines) or not len(hashes):
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        # runs of benchmark words inside one document; shorter ones than every phrase can't hold any
        fresh = np.concatenate(([True], (symbol[1:] > 0) != (symbol[:-1] > 0))) | np.concatenate(([True], owner[1:] != owner[:-1]))
        starts = np.flatnonzero(fresh)
        lengths = np.diff(np.append(starts, len(symbol)))
        runs = (symbol[starts] > 0) & (lengths >= self.shortest)
        starts, lengths = starts[runs], lengths[runs]
        if not len(starts):
            return none
        # each run is followed by a 0
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
        target = np.arange(len(place)) + np.repeat(np.arange(len(starts)), lengths)
        text = np.zeros(len(place) + len(starts), np.int64)
        word = np.zeros(len(text), np.int64)
        text[target], word[target] = symbol[place], place
        index = FMIndex(text, len(self.vocabulary))
        phrase, found = index.locate(*index.search(self.lines, self.lengths))
        return word[found], self.lengths[phrase], phrase


def _spans(hit: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of every maximal hit run that stays in one document."""
    if not hit.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.flatnonzero(hit)
    cut = np.concatenate(([True], (np.diff(places) > 1) | (np.diff(owner[places]) > 0)))
    starts = places[cut]
    ends = places[np.append(np.flatnonzero(cut)[1:] - 1, len(places) - 1)]
    return starts, ends


def _without(text: str, spans: list[dict]) -> str:
    at, parts = 0, []
    for span in spans:
        parts.append(text[at:span["start"]])
        at = span["end"]
    return "".join(parts) + text[at:]


def _searched(batch: pa.RecordBatch, phrases: Phrases, words: Words, cut: bool) -> pa.RecordBatch:
    texts = text_bytes(batch.column("text"))
    hashes, owner, begin, end = words.split(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    base = np.cumsum(n_words) - n_words
    hit = np.zeros(len(hashes) + 1, np.int64)
    first, length, phrase = phrases.find(hashes, owner)
    np.add.at(hit, first, 1)
    np.add.at(hit, first + length, -1)
    hit = np.cumsum(hit)[:-1] > 0
    earlier = batch.column("spans").to_pylist()
    for i, spans in enumerate(earlier):
        for span in spans:
            hit[base[i] + span["first"]:base[i] + span["last"] + 1] = True
    named = [set(x) for x in batch.column("items").to_pylist()]
    count = phrases.owner_count[phrase]
    which = np.repeat(owner[first], count)
    item = phrases.owners[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(phrases.owner_start[phrase], count)]
    for i, j in np.unique(np.stack((which, item), 1), axis=0) if len(item) else ():
        if phrases.names[j] is not None:
            named[i].add(phrases.names[j])
    starts, ends = _spans(hit, owner)
    spans = [[] for _ in texts]
    for a, b in zip(starts, ends):
        i = owner[a]
        to_point = texts[i]
        spans[i].append({
            "first": int(a - base[i]), "last": int(b - base[i]),
            "start": len(to_point[:begin[a]].decode()), "end": len(to_point[:end[b]].decode()),
        })
    kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "start", "end")]))
    text = batch.column("text")
    if cut and any(spans):
        text = pa.array([_without(t, s) if s else t for t, s in zip(text.to_pylist(), spans)], pa.string())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc"), text, pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array([sorted(x) for x in named], pa.list_(pa.string()))],
        ["doc", "text", "n_words", "spans", "items"])


def find_passages(docs: DataFrame, items: DataFrame, window: int = 10, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """Every row with the places where it repeats windows of benchmark items.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lowered.  A window is ``window`` consecutive words of an
    item; an item of fewer words, but not none, is one window.  Returns ``doc`` (the input columns without the text),
    ``text``, ``n_words``, ``spans`` (maximal hit runs: first and last word, start and end in code points) and
    ``items`` (sorted ids, as strings, of items with occurring windows).  With ``cut`` the spans are cut out of the text;
    their places are those in the whole text.

    * null and empty texts have no words and no hits; null or empty items have no window;
    * repeated items count once; an item without an id still marks words but is not listed;
    * an empty table on either side gives rows without hits (no rows for no documents).

    Each batch of about 4 MB of text is a shard: its words become numbers, the words that no item has only separate, and
    an FM-index over the rest answers all windows by backward search.  The items travel in blocks of about
    ``block_words`` words, so what one pass broadcasts is bounded whatever the benchmark's size; the passes follow
    each other without a shuffle.  Words are compared by 64-bit fingerprints.
    """
    spark = prepared(docs.sparkSession).sparkContext

    def fingerprints(batches):
        words = Words(SEPARATORS)
        for batch in batches:
            hashes, owner, _, _ = words.split(text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), list_array(hashes.view(np.int64), np.bincount(owner, minlength=batch.num_rows))], ["item", "words"])

    listed = items.select(F.col(item_column).cast("string").alias("item"), F.col(item_text).alias("text")).mapInArrow(
        fingerprints, "item string, words array<long>").where(F.size("words") > 0)
    total = listed.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    state = packed(docs, (text_column,), text=text_column).select(
        "doc", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(f"array<{SPAN}>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])
    for block in range(blocks):
        own = listed.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block)
        sent = spark.broadcast([(r.item, r.words) for r in own.collect()])

        def search(batches, sent=sent, cut=cut and block == blocks - 1):
            phrases, words = Phrases(sent.value, window), Words(SEPARATORS)
            for batch in batches:
                for part in bounded(batch, "text", SHARD_BYTES):
                    yield _searched(part, phrases, words, cut)

        state = state.mapInArrow(search, schema)
    return state
