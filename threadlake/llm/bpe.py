"""BPE encoding and decoding; long texts are encoded in pieces and joined as a tree."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from threadlake.llm.common import Words, bounded, list_array, packed, prepared, text_bytes

LEAF = 32_768
#: Words whose ids a worker remembers, about 30 bytes each.
MEMO_WORDS = 1 << 19
#: Words that are encoded in one call; their intermediate objects are large.
CALL_WORDS = 1 << 12
SPACES = (0x20, 0x09, 0x0A, 0x0D)
#: Text put on both sides of a place to see whether a definition looks across it.
PROBES = ("a", "Zz", "it's", "'", "7", "42", "é", "e\u0301", "\u0301", "ΑΣ", "日本", "ß", "_", "...", "<|", "|>", "🙂", "\u200d", "\xa0", "\x1c")
#: First steps that drop white space.
DROPS_SPACE = ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")


@lru_cache(maxsize=4)
def joints(definition: str) -> re.Pattern:
    """Characters before which a text may be cut without changing its ids: white space, and digits if they stand alone.

    Refused with a ValueError are definitions whose ids depend on white space (byte-level ones keep it in their tokens):
    the first step must remove it, no added token may hold it, and ids of probes on both sides of it must be those of
    the probes alone.
    """
    from tokenizers import Tokenizer

    held = json.loads(definition)
    steps = held.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    drops = first.get("type") in DROPS_SPACE or (first.get("type") == "Split" and first.get("behavior") == "Removed")
    whole = not any(re.search(r"\s", token["content"]) for token in held.get("added_tokens", []))
    tokenizer = Tokenizer.from_str(definition)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    alone = {text: ids(text) for text in ("", *PROBES)}

    def free(between: str) -> bool:
        own = ids(between)
        return all(ids(a + between + b) == alone[a] + own + alone[b] for a, b in product(alone, alone))

    if not (drops and whole and all(not ids(x) and free(x) for x in (" ", "\t", "\n", "\r", "  ", " \n\t"))):
        raise ValueError("ids of this tokenizer depend on white space; it must be dropped by the first step of its pre-tokenizer")
    return re.compile("[ \t\n\r0-9]" if all(map(free, "0123456789")) else "[ \t\n\r]")


class Encoder:
    """One tokenizer per worker, with the ids of the words it has met.

    Words between spaces are encoded on their own: the normalizer and the pre-tokenizer of the vocabulary never look
    across a space, tab or line break, so the ids of a text are those of its words in order.  A word is known by its
    64-bit fingerprint.
    """

    _held: dict[str, "Encoder"] = {}

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.joints = joints(definition)
        self.words = Words(SPACES, fold=False)
        self._remember(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    @classmethod
    def of(cls, definition: str) -> "Encoder":
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if definition not in cls._held:
            cls._held.clear()
            cls._held[definition] = cls(definition)
        return cls._held[definition]

    def _remember(self, known, count, flat) -> None:
        start = np.cumsum(count) - count
        order = np.argsort(known)
        self.known, self.start, self.count, self.flat = known[order], start[order], count[order], flat

    def _learn(self, fresh: np.ndarray, words: list[str], used: np.ndarray) -> None:
        if len(self.known) + len(fresh) > MEMO_WORDS:
            at = np.flatnonzero(np.isin(self.known, used))
            count = self.count[at]
            self._remember(self.known[at], count, self.flat[_ranges(self.start[at], count)])
        counts, flats = [], []
        for at in range(0, len(words), CALL_WORDS):
            got = [e.ids for e in self.tokenizer.encode_batch(words[at:at + CALL_WORDS], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            flats.append(np.fromiter((i for x in got for i in x), np.int32, int(counts[-1].sum())))
        count, flat = np.concatenate(counts), np.concatenate(flats)
        start = np.concatenate((self.start, np.cumsum(count) - count + len(self.flat)))
        known = np.concatenate((self.known, fresh))
        order = np.argsort(known)
        self.known, self.start, self.count = known[order], start[order], np.concatenate((self.count, count))[order]
        self.flat = np.concatenate((self.flat, flat))

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        hashes, owner, begin, end = self.words.split(texts)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        missing = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        missing[inside] = self.known[at[inside]] != distinct[inside]
        if missing.any():
            at = first[missing]
            self._learn(distinct[missing], [texts[o][a:b].decode() for o, a, b in zip(owner[at], begin[at], end[at])], distinct)
            at = np.searchsorted(self.known, distinct)
        start, count = self.start[at][place], self.count[at][place]
        sizes = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        return self.flat[_ranges(start, count)], sizes

    def one(self, text: str) -> np.ndarray:
        return self.ids([text.encode()])[0]

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``count[0]`` places, then those of the next."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


def join_pieces(encoder: Encoder, left: str, right: str, left_ids: np.ndarray, right_ids: np.ndarray, width: int = 64) -> np.ndarray:
    """Ids of ``left + right`` from the ids of both.

    A window around the join is encoded again.  It grows until it starts and ends before a joint (white space, a digit
    that is a token of its own, or an end of the text) and what each side had inside the window is exactly the tail or head of that side's ids; there both sides
    agree, and what lies beyond is not changed by the join.
    """
    text = left + right
    cut = len(left)
    while True:
        lo, hi = max(0, cut - width), min(len(text), cut + width)
        spaces = [m.start() for m in encoder.joints.finditer(text, lo, hi)]
        begin = 0 if lo == 0 else next((x for x in spaces if x < cut), -1)
        end = len(text) if hi == len(text) else next((x for x in reversed(spaces) if x >= cut), -1)
        if begin >= 0 and end >= 0:
            tail, head = encoder.one(left[begin:]), encoder.one(right[:end - cut])
            keep = len(left_ids) - len(tail)
            if np.array_equal(left_ids[keep:], tail) and np.array_equal(right_ids[:len(head)], head):
                return np.concatenate((left_ids[:keep], encoder.one(text[begin:end]), right_ids[len(head):]))
        width *= 2


def tree_ids(encoder: Encoder, pieces: list[str], ids: list[np.ndarray]) -> np.ndarray:
    """Joins neighbours level by level until one sequence is left."""
    while len(pieces) > 1:
        ids = [
            join_pieces(encoder, pieces[i], pieces[i + 1], ids[i], ids[i + 1]) if i + 1 < len(pieces) else ids[i]
            for i in range(0, len(pieces), 2)
        ]
        pieces = ["".join(pieces[i:i + 2]) for i in range(0, len(pieces), 2)]
    return ids[0]


def encode_texts(docs: DataFrame, definition: str, text_column: str = "text", leaf: int = LEAF) -> DataFrame:
    """Every row with the ids of its whole text and the text those ids decode to.

    ``definition`` is the tokenizer as JSON text; it is read once by the caller and travels with the tasks, so no
    executor opens a file.  Returns ``doc`` (the input columns without the text), ``ids`` array<int>, ``decoded``.

    * null text is empty; an empty text has no ids and decodes to the empty string;
    * texts of up to ``leaf`` code points are encoded where they are.  Longer ones are cut into leaves of that many
      code points at whatever place that is, the leaves are spread over the cluster and encoded in parallel, and
      neighbours are joined as a binary tree, each join encoding a growing window around it again;
    * a definition whose ids depend on white space is refused with a ValueError (``joints``);
    * repeated rows stay repeated; an empty table gives an empty table; other columns may have any name.
    """
    joints(definition)
    prepared(docs.sparkSession)
    rows = packed(docs, (text_column,), text=text_column).withColumn("text", F.coalesce("text", F.lit("")))
    out = T.StructType([rows.schema["doc"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def finish(encoder, doc, flat, sizes):
        decoded = [encoder.decode(x) for x in np.split(flat, np.cumsum(sizes)[:-1])]
        return pa.RecordBatch.from_arrays([doc, list_array(flat, sizes, pa.int32()), pa.array(decoded, pa.string())], ["doc", "ids", "decoded"])

    def short(batches):
        encoder = Encoder.of(definition)
        for batch in batches:
            for part in bounded(batch, "text"):
                yield finish(encoder, part.column("doc"), *encoder.ids(text_bytes(part.column("text"))))

    def leaves(batches):
        encoder = Encoder.of(definition)
        for batch in batches:
            ids = list_array(*encoder.ids(text_bytes(batch.column("piece"))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("at"), batch.column("piece"), ids], ["key", "at", "piece", "ids"])

    def joined(batches):
        encoder = Encoder.of(definition)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = batch.column("parts")[i].values
                ids = [np.asarray(x.values, np.int32) for x in parts.field("ids")]
                flat = tree_ids(encoder, parts.field("piece").to_pylist(), ids)
                yield finish(encoder, batch.column("doc").slice(i, 1), flat, np.array([len(flat)]))

    is_long = F.char_length("text") > leaf
    near = rows.where(~is_long).mapInArrow(short, out)
    # a long text is named by its content: equal long texts are encoded once
    far = rows.where(is_long).withColumn("key", F.sha2("text", 256))

    def cut(batches):
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                pieces = [text[i:i + leaf] for i in range(0, len(text), leaf)]
                yield pa.RecordBatch.from_pydict(
                    {"key": [key] * len(pieces), "at": pa.array(range(len(pieces)), pa.int32()), "piece": pieces})

    pieces = far.select("key", "text").mapInArrow(cut, "key string, at int, piece string")
    pieces = pieces.groupBy("key", "at").agg(F.first("piece").alias("piece"))
    encoded = pieces.mapInArrow(leaves, "key string, at int, piece string, ids array<int>")
    whole = encoded.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "ids"))).alias("parts"))
    far = far.select("doc", "key").join(whole, "key").select("doc", "parts").mapInArrow(joined, out)
    return near.unionByName(far)
