"""Cross-entropy difference of matched target and background n-gram models."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from threadlake.llm.common import GOLDEN, Words, bounded, mix, packed, prepared, text_bytes, whole_ids
from threadlake.session import materialize

#: Bytes between words once A-Z is lowered: ASCII other than letters and digits.
SEPARATORS = (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
#: Words found less often in both training sets together are one unknown word, pairs found less often back off.
MIN_WORDS, MIN_PAIRS = 3, 4
#: Weight of the word model inside the pair model.
BACK_OFF = 40.0
#: Entries of both models up to which they are broadcast (16 bytes each, 64 MB in all); larger ones are joined.
BROADCAST_ENTRIES = 1 << 22
#: Tokens a task counts together before it hands them on.
GROUP = 1 << 20
#: Bytes of text in a block, which is scored with its own part of the models; a longer text is a block of its own.
BLOCK_BYTES = 1 << 24
#: Rounds in which grams are counted, each those of one remainder of their key; a round shuffles that share of them.
ROUNDS = 2


def pair_id(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Fingerprint of a word after another."""
    return mix(before * GOLDEN + word)


class Pairs:
    """Words of texts, and for each the one before it in its text (0 for the first, which forms no pair)."""

    def __init__(self):
        self.words = Words(SEPARATORS)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes, owner, _, _ = self.words.split(texts)
        return hashes, owner

    @staticmethod
    def before(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        same = owner[1:] == owner[:-1]
        out[1:][same] = words[:-1][same]
        return out


class Counts:
    """Sorted fingerprints with counts in the target and background training sets."""

    def __init__(self, known: np.ndarray, target: np.ndarray, background: np.ndarray):
        order = np.argsort(known)
        kind = np.uint32 if max(target.max(initial=0), background.max(initial=0)) < 1 << 32 else np.uint64
        self.known, self.counts = known[order], np.stack((target.astype(kind), background.astype(kind)), 1)[order]

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Counts of both models, 0 for what is not known."""
        if not len(self.known):
            return np.zeros((len(wanted), 2))
        at = np.minimum(np.searchsorted(self.known, wanted), len(self.known) - 1)
        return self.counts[at].astype(np.float64) * (self.known[at] == wanted)[:, None]


def matched(totals: tuple[float, float]) -> tuple[float, float]:
    """Factors that bring the tokens of both sides to those of the smaller one; beside an empty side both models are even."""
    least = min(totals)
    return tuple(least / total if total else 0.0 for total in totals)


def losses(pair: np.ndarray, word: np.ndarray, history: np.ndarray, totals: np.ndarray, vocabulary: int) -> np.ndarray:
    """Loss in nats of each token under both models from its counts, which are scaled to the same number of tokens."""
    scale = np.array(matched(tuple(totals)))
    alone = (scale * word + 1.0) / (scale * totals + vocabulary)
    return -np.log((scale * pair + BACK_OFF * alone) / (scale * history + BACK_OFF))


def training_sets(docs: DataFrame, target: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Id, text and side of every row: 0 for target documents, 1 for all others, rows without an id among them."""
    whole_ids(docs, id_column)
    whole_ids(target, target.columns[0])
    ids = target.select(F.col(target.columns[0]).cast("long").alias("id")).where("id is not null").distinct()
    ids = materialize(ids.withColumn("side", F.lit(0)), "target")
    if ids.count() <= BROADCAST_ENTRIES:
        ids = F.broadcast(ids)
    rows = packed(docs, id=id_column, text=text_column).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(ids, "id", "left").select("id", "text", F.coalesce("side", F.lit(1)).alias("side"))


def _counted(batches, unit):
    """(fingerprint, target count, background count), summed over groups of tokens; ``unit`` gives those of texts."""
    held, sides, n = [], [], 0

    def summed():
        found, background = np.concatenate(held), np.concatenate(sides)
        known, place = np.unique(found, return_inverse=True)
        both = np.bincount(place, minlength=len(known))
        second = np.bincount(place, weights=background, minlength=len(known)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(both - second, pa.int64()), pa.array(second, pa.int64())], ["gram", "target", "background"])

    for batch in batches:
        for part in bounded(batch, "text"):
            found, owner = unit(text_bytes(part.column("text")))
            held.append(found)
            sides.append(np.asarray(part.column("side"))[owner] == 1)
            n += len(found)
            if n >= GROUP:
                yield summed()
                held, sides, n = [], [], 0
    if n:
        yield summed()


COUNTS = "gram long, target long, background long"
SCORES = "id long, n_tokens long, target_loss double, background_loss double, score double"


def _summed(frame: DataFrame, least: int) -> DataFrame:
    return frame.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background")).where(F.col("target") + F.col("background") >= least)


def _collected(table: DataFrame) -> Counts:
    gram, target, background = (column.to_numpy() for column in table.select("gram", "target", "background").toArrow().columns)
    return Counts(gram.view(np.uint64), target, background)


def train(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, tuple[float, float]]:
    """Word and pair counts of both training sets, and the tokens in each.

    The target set is the documents named by ``target``, the background set all others, so every document is counted in
    one of them and the tables grow with the corpus.  The models share the vocabulary: words counted ``MIN_WORDS`` times
    in the two sets together.  They are matched in size when they are used (``matched``), not by leaving documents out.
    """
    prepared(docs.sparkSession)
    rows = training_sets(docs, target, id_column, text_column)

    def words(batches):
        reader = Pairs()
        return _counted(batches, reader.read)

    def pairs(batches):
        reader = Pairs()

        def unit(texts):
            found, owner = reader.read(texts)
            before = reader.before(found, owner)
            inner = before != 0
            return pair_id(before[inner], found[inner]), owner[inner]

        return _counted(batches, unit)

    # a pair that is frequent enough has two known words
    word_table = materialize(_summed(rows.mapInArrow(words, COUNTS), 1), "words")
    totals = word_table.agg(F.sum("target"), F.sum("background")).first()
    known = materialize(word_table.where(F.col("target") + F.col("background") >= MIN_WORDS), "vocabulary")
    pair_table = materialize(_summed(rows.mapInArrow(pairs, COUNTS), MIN_PAIRS), "pairs")
    return known, pair_table, (float(totals[0] or 0), float(totals[1] or 0))


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """Written rows (id, text, side) with the block each is in: neighbours of one task, up to ``block_bytes`` together."""

    def cut(batches):
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in bounded(batch, "text", min(block_bytes, GROUP)):
                size = part.column("text").nbytes
                if held and held + size > block_bytes:
                    block, held = block + 1, 0
                held += size
                yield part.append_column("block", pa.array(np.full(part.num_rows, block)))

    return materialize(rows.mapInArrow(cut, "id long, text string, side int, block long"), "blocks")


def _keys(reader: Pairs, texts: list[bytes]):
    """Keys of words (even) and of pairs (odd, 0 for the first word of a text), and the text each is in."""
    found, owner = reader.read(texts)
    before = reader.before(found, owner)
    pairs = pair_id(before, found) | np.uint64(1)
    pairs[before == 0] = 0
    return found & ~np.uint64(1), pairs, before & ~np.uint64(1), owner


def _grams(batches, remainder: int):
    """(gram, block, target, background): words and pairs of one round in a block, with their counts on its two sides."""
    reader, held, sides, n, block = Pairs(), [], [], 0, None

    def summed():
        found, background = np.concatenate(held), np.concatenate(sides)
        known, place = np.unique(found, return_inverse=True)
        both = np.bincount(place, minlength=len(known))
        second = np.bincount(place[background], minlength=len(known))
        columns = [known.view(np.int64), np.full(len(known), block), both - second, second]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["gram", "block", "target", "background"])

    for batch in batches:
        for part in bounded(batch, "text"):
            numbers = np.asarray(part.column("block"))
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for start, end in zip([0, *edges], [*edges, len(numbers)]):
                if n and (numbers[start] != block or n >= 4 * GROUP):
                    yield summed()
                    held, sides, n = [], [], 0
                block = numbers[start]
                rows = part.slice(start, end - start)
                words, pairs, _, owner = _keys(reader, text_bytes(rows.column("text")))
                behind = np.asarray(rows.column("side"))[owner] == 1
                for keys in (words, pairs):
                    wanted = ((keys >> np.uint64(1)) % np.uint64(ROUNDS) == remainder) & (keys != 0)
                    held.append(keys[wanted])
                    sides.append(behind[wanted])
                    n += len(held[-1])
    if n:
        yield summed()


def _short(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as one byte each, and those of 255 and more as longs."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype(np.int64).tobytes()


def _long(short: bytes, more: bytes) -> np.ndarray:
    out = np.frombuffer(short, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(more, np.int64)
    return out


SENT = "block long, grams binary, target binary, more_target binary, background binary, more_background binary"


def _sent(batches):
    """Known grams of a task, those for one block in one row."""
    held, n = [], 0

    def rows():
        block, gram, target, background = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order])) + 1
        out = []
        for at in np.split(order, edges):
            out.append((int(block[at[0]]), gram[at].tobytes(), *_short(target[at]), *_short(background[at])))
        names = [name.split()[0] for name in SENT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i else pa.int64()) for i, x in enumerate(zip(*out))], names)

    for batch in batches:
        held.append([column.to_numpy(zero_copy_only=False) for column in batch.columns])
        n += batch.num_rows
        if n >= 2 * GROUP:
            yield rows()
            held, n = [], 0
    if n:
        yield rows()


def score_corpus(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``score_documents(docs, train(docs, target))`` for models of any size, with one shuffle of the grams.

    Documents are dealt to blocks of bounded size.  In ``ROUNDS`` rounds, a block sends each of its words and pairs once, with the block's
    counts; where a gram's blocks meet, the counts are summed, and what the models know goes back to those blocks.  A
    block is then scored with its own part of the models, so nothing that grows with the corpus is broadcast, and a task
    holds one block.  Nulls, empty texts, repeated rows and ids are treated as ``score_documents`` does.
    """
    prepared(docs.sparkSession)
    blocks = _blocks(training_sets(docs, target, id_column, text_column), block_bytes)
    gram = Window.partitionBy("gram")
    is_word = F.col("gram").bitwiseAND(1) == 0
    both = F.col("all_target") + F.col("all_background")

    def round_of(remainder: int) -> DataFrame:
        counted = blocks.mapInArrow(lambda batches: _grams(batches, remainder), "gram long, block long, target long, background long")
        summed = counted.withColumns({f"all_{side}": F.sum(side).over(gram) for side in ("target", "background")}).where(is_word | (both >= MIN_PAIRS))
        # a block's own counts are kept for words, which say how many tokens there are
        return materialize(summed.withColumns({side: F.when(is_word, F.col(side)) for side in ("target", "background")}), "parts")

    parts = reduce(DataFrame.unionByName, map(round_of, range(ROUNDS)))
    words = parts.where(is_word).groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    held = words.agg(F.sum("target"), F.sum("background"), F.count_if(F.col("target") + F.col("background") >= MIN_WORDS)).first()
    totals, n_words = np.array([float(held[0] or 0), float(held[1] or 0)]), held[2]

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        reader = Pairs()
        sent = [column.to_pylist() for column in known.columns[1:]]
        grams = np.frombuffer(b"".join(sent[0]), np.uint64)
        counts = [np.concatenate([np.zeros(0, np.int64), *map(_long, sent[i], sent[i + 1])]) for i in (1, 3)]
        part = Counts(grams, *counts)
        out = []
        for batch in texts.combine_chunks().to_batches():
            for rows in bounded(batch, "text"):
                word, pair, before, owner = _keys(reader, text_bytes(rows.column("text")))
                distinct, place = np.unique(np.concatenate((word, pair)), return_inverse=True)
                found = part.of(distinct)[place]
                history = np.zeros((len(word), 2))
                history[1:] = found[:max(0, len(word) - 1)]
                history[before == 0] = 0
                at_pair = found[len(word):] * (pair != 0)[:, None]
                out.append(_means(rows, owner, losses(at_pair, found[:len(word)], history, totals, n_words + 1)))
        return pa.Table.from_batches(out)

    known = parts.where(~is_word | (both >= MIN_WORDS)).select("block", "gram", "all_target", "all_background")
    number = max(1, blocks.select("block").distinct().count())
    texts, known = (frame.repartition(number, "block").groupBy("block") for frame in (blocks.select("block", "id", "text"), known.mapInArrow(_sent, SENT)))
    return texts.cogroup(known).applyInArrow(score, SCORES)


def _means(rows: pa.RecordBatch, owner: np.ndarray, loss: np.ndarray) -> pa.RecordBatch:
    """Mean losses of each row's tokens, and the score."""
    n = np.bincount(owner, minlength=rows.num_rows)
    mean = [np.bincount(owner, weights=loss[:, i], minlength=rows.num_rows) / np.maximum(n, 1) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(
        [rows.column("id"), pa.array(n, pa.int64()), pa.array(mean[0]), pa.array(mean[1]), pa.array(mean[1] - mean[0])],
        ["id", "n_tokens", "target_loss", "background_loss", "score"])


def score_documents(docs: DataFrame, model, id_column: str = "doc_id", text_column: str = "text", broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of every row.

    Losses are means over the tokens in nats; ``score`` is background loss less target loss: the higher, the more a text
    is like the target, and 0 where one side has no tokens.  A token's probability is its pair count with ``BACK_OFF`` counts of the smoothed word model.

    * null, empty and wordless texts have no tokens and score 0; so does every text when both models are empty;
    * repeated rows score alike; an empty table gives an empty table; only the two named columns are read;
    * ids must be whole numbers or null; other types are refused with a TypeError.

    Models of up to ``broadcast_entries`` entries are broadcast and documents are scored where they are.  Larger ones are
    joined with the distinct pairs of each document by fingerprint; the result is the same.
    """
    prepared(docs.sparkSession)
    whole_ids(docs, id_column)
    word_table, pair_table, totals = model
    n_words, n_pairs = word_table.count(), pair_table.count()
    rows = packed(docs, id=id_column, text=text_column).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    if n_words + n_pairs <= broadcast_entries:
        return _score_here(rows, _collected(word_table), _collected(pair_table), totals)
    return _score_joined(rows, word_table, pair_table, totals, n_words)


def _score_here(rows: DataFrame, words: Counts, pairs: Counts, totals) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((words, pairs))
    both = np.array(totals)

    def score(batches):
        reader = Pairs()
        words, pairs = sent.value
        for batch in batches:
            for part in bounded(batch, "text"):
                found, owner = reader.read(text_bytes(part.column("text")))
                before = reader.before(found, owner)
                loss = losses(pairs.of(pair_id(before, found)), words.of(found), words.of(before), both, len(words.known) + 1)
                yield _means(part, owner, loss)

    return rows.mapInArrow(score, SCORES)


def _score_joined(rows: DataFrame, words: DataFrame, pairs: DataFrame, totals, n_words: int) -> DataFrame:
    def grams(batches):
        reader = Pairs()
        for batch in batches:
            for part in bounded(batch, "text"):
                texts = text_bytes(part.column("text"))
                found, owner = reader.read(texts)
                before = reader.before(found, owner)
                key = np.stack((owner.astype(np.uint64), before, found), 1)
                distinct, n = np.unique(key, axis=0, return_counts=True) if len(key) else (key, np.zeros(0, np.int64))
                names = np.asarray(part.column("text_id"))[distinct[:, 0].astype(np.int64)] if len(key) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (distinct[:, 1], distinct[:, 2], pair_id(distinct[:, 1], distinct[:, 2]))), pa.array(n, pa.int64())],
                    ["text_id", "before", "word", "gram", "n"])

    # equal texts are one text; it is named by its content
    named = rows.withColumn("text_id", F.xxhash64("text"))
    texts = named.select("text_id", "text").dropDuplicates(["text_id"])
    tokens = texts.mapInArrow(grams, "text_id long, before long, word long, gram long, n long")
    side = lambda table, key, tag: table.select(F.col("gram").alias(key), F.col("target").alias(f"{tag}_t"), F.col("background").alias(f"{tag}_b"))
    met = tokens.join(side(pairs, "gram", "pair"), "gram", "left").join(side(words, "word", "word"), "word", "left").join(side(words, "before", "history"), "before", "left")
    met = met.na.fill(0, [f"{x}_{y}" for x in ("pair", "word", "history") for y in "tb"])
    loss = {}
    for y, scale, total in zip("tb", matched(totals), totals):
        alone = (scale * F.col(f"word_{y}") + 1.0) / (scale * total + n_words + 1)
        loss[y] = F.sum(-F.log((scale * F.col(f"pair_{y}") + BACK_OFF * alone) / (scale * F.col(f"history_{y}") + BACK_OFF)) * F.col("n"))
    summed = met.groupBy("text_id").agg(F.sum("n").alias("n_tokens"), loss["t"].alias("t"), loss["b"].alias("b"))
    scored = named.select("id", "text_id").join(summed, "text_id", "left")
    n = F.coalesce("n_tokens", F.lit(0))
    mean = lambda x: F.when(n > 0, F.col(x) / n).otherwise(0.0)
    return scored.select("id", n.alias("n_tokens"), mean("t").alias("target_loss"), mean("b").alias("background_loss"), (mean("b") - mean("t")).alias("score"))
