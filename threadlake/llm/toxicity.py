"""Toxic spans by a linear-chain conditional random field, aggregated to document scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from threadlake.llm.common import GOLDEN, Words, bounded, mix, packed, prepared, text_bytes
from threadlake.session import materialize

#: Bytes between words once A-Z is lowered: ASCII other than letters and digits.
SEPARATORS = (*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80))
#: Labelled documents of each class the model is fitted on, at most; half for the field, half for the document scores.
TRAIN_PER_CLASS = 8_000
#: Word, prefix and suffix evidence kept, at most (12 bytes each).
LEXICON = 1 << 16
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)
#: Evidence of a token in log odds, cut into the observations of the field; below the first cut is observation 0.
CUTS = np.array([0.75, 1.25, 1.75, 2.0, 2.25, 2.75, 3.25, 3.75, 4.25, 4.75])
OBSERVED = len(CUTS) + 1
SHRINK = 5.0
#: Least likelihood ratio statistic of a feature.
SURE = 18.0
#: Least-hash sketch of the word triples of a text, its bands, and the share of equal entries from which texts are copies.
SKETCH, BANDS, COPY = 64, 16, 0.5
TOXIC_EVIDENCE = 2.0
ROUNDS = 8
BLOCK = 64


@dataclass
class Field:
    """Weights of the two-state field: first state, step, observation."""

    first: np.ndarray
    step: np.ndarray
    seen: np.ndarray


@dataclass
class Model:
    known: np.ndarray
    evidence: np.ndarray
    field: Field | None
    weights: np.ndarray
    prior: float


class Tokens:
    """Words of a batch with the fingerprints of the features of each distinct word."""

    def __init__(self):
        self.words = Words(SEPARATORS)

    def read(self, texts: list[bytes]):
        hashes, owner, begin, end = self.words.split(texts)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        parts = [texts[o][a:b].lower() for o, a, b in zip(owner[first], begin[first], end[first])]
        return owner, begin, end, place, distinct, parts

    def features(self, distinct: np.ndarray, parts: list[bytes]):
        """(number of the word, fingerprint) of its prefixes and suffixes and of the word itself."""
        which, found = [np.arange(len(parts))], [distinct]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        for tag, lengths in ((1, PREFIXES), (2, SUFFIXES)):
            for k in lengths:
                at = np.flatnonzero(sizes > k)
                if len(at):
                    cut = [parts[i][:k] if tag == 1 else parts[i][-k:] for i in at]
                    raw = np.frombuffer(b"".join(x.ljust(8, b"\0") for x in cut), np.uint64)
                    which.append(at)
                    found.append((raw ^ np.uint64((tag * 16 + k) << 56)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(tag * 16 + k))
        return np.concatenate(which), np.concatenate(found)

    def evidence(self, distinct: np.ndarray, parts: list[bytes], model: Model) -> np.ndarray:
        """Largest log odds among the features of each distinct word."""
        out = np.zeros(len(parts))
        if len(model.known):
            which, found = self.features(distinct, parts)
            at = np.minimum(np.searchsorted(model.known, found), len(model.known) - 1)
            hit = model.known[at] == found
            np.maximum.at(out, which[hit], model.evidence[at[hit]])
        return out


def scan(matrices: np.ndarray) -> np.ndarray:
    """Running products of 2x2 matrices, each scaled to sum 1: blocks side by side, then the blocks' own products."""
    n = len(matrices)
    if n <= BLOCK:
        out = matrices.copy()
        for i in range(1, n):
            out[i] = out[i - 1] @ matrices[i]
            out[i] /= out[i].sum()
        return out
    blocks = -(-n // BLOCK)
    padded = np.concatenate((matrices, np.broadcast_to(np.eye(2), (blocks * BLOCK - n, 2, 2)))).reshape(blocks, BLOCK, 2, 2)
    out = padded.copy()
    for i in range(1, BLOCK):
        out[:, i] = _product(out[:, i - 1], padded[:, i])
    before = scan(out[:-1, -1].copy())
    out[1:] = _product(before[:, None], out[1:])
    return out.reshape(-1, 2, 2)[:n]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.broadcast_arrays(a, b)
    out = np.empty(a.shape)
    for i in (0, 1):
        for j in (0, 1):
            out[..., i, j] = a[..., i, 0] * b[..., 0, j] + a[..., i, 1] * b[..., 1, j]
    return out / out.sum(axis=(-2, -1), keepdims=True)


def marginals(field: Field, observed: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each state at each token, and of each pair of states of a token and the one before.

    Tokens of many documents stand in one row; ``opens`` marks the first of each.  A document's first matrix does not
    look at the state before, so nothing passes from one document to the next.
    """
    n = len(observed)
    if not n:
        return np.zeros((0, 2)), np.zeros((0, 2, 2))
    emit = np.exp(field.seen[:, observed]).T
    step = np.exp(field.step)
    forward = step[None] * emit[:, None, :]
    forward[opens] = (np.exp(field.first) * emit[opens])[:, None, :]
    forward /= forward.sum(axis=(1, 2), keepdims=True)
    alpha = scan(forward).sum(axis=1)
    alpha /= alpha.sum(axis=1, keepdims=True)
    # backwards: what follows a token weighs its states; the last token of a document sees nothing after it
    after = np.empty((n, 2, 2))
    after[:-1] = (step[None] * emit[1:, None, :]).transpose(0, 2, 1)
    closes = np.append(opens[1:], True)
    after[closes] = 1.0
    after /= after.sum(axis=(1, 2), keepdims=True)
    beta = scan(after[::-1].copy()).sum(axis=1)[::-1]
    both = alpha * beta
    both /= both.sum(axis=1, keepdims=True)
    pair = np.zeros((n, 2, 2))
    if n > 1:
        pair[1:] = alpha[:-1, :, None] * step[None] * (emit[1:] * beta[1:])[:, None, :]
        pair[1:] /= pair[1:].sum(axis=(1, 2), keepdims=True)
    pair[opens] = 0.0
    return both, pair


def _opens(owner: np.ndarray) -> np.ndarray:
    opens = np.ones(len(owner), bool)
    opens[1:] = owner[1:] != owner[:-1]
    return opens


def _observe(evidence: np.ndarray) -> np.ndarray:
    return np.searchsorted(CUTS, evidence, side="right")


def _document(model: Model, tokens: Tokens, texts: list[bytes]):
    """Per document: sum of the marginals of toxic tokens and largest marginal; per token: owner, places, marginal."""
    owner, begin, end, place, distinct, parts = tokens.read(texts)
    observed = _observe(tokens.evidence(distinct, parts, model))[place]
    toxic = marginals(model.field, observed, _opens(owner))[0][:, 1]
    # a token counts when it is more likely toxic than not; the many others of a long clean text add up to nothing
    total = np.bincount(owner, weights=np.where(toxic >= 0.5, toxic, 0.0), minlength=len(texts))
    most = np.zeros(len(texts))
    np.maximum.at(most, owner, toxic)
    return (total, most), owner, begin, end, toxic


def _design(total: np.ndarray, most: np.ndarray) -> np.ndarray:
    return np.stack((np.ones(len(total)), np.log(total + 0.1), most), 1)


def _logistic(design: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    w = np.zeros(design.shape[1])
    ridge = np.diag([0.01, 0.2, 0.2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (weight * (label - p)) - ridge @ w
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        w = w + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return w


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, id_column: str, text_column: str) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Text, label and half of a bounded labelled sample, and (rows taken, rows there) per class.

    Rows are taken in the order of a hash of the id.  Only their ids are broadcast, so no text of other rows moves.
    """
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("id").cast("string")) % 5 != 0)
    there = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    taken = []
    for label in (0, 1):
        taken += known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()
    counts = {label: (sum(r.toxic == label for r in taken), there.get(label, 0)) for label in (0, 1)}
    chosen = spark.createDataFrame([(r.id, r.toxic) for r in taken], "id long, toxic int")
    rows = packed(docs, id=id_column, text=text_column).select(F.col("id").cast("long").alias("id"), "text")
    rows = rows.join(F.broadcast(chosen), "id").select("text", "toxic", (F.xxhash64(F.lit("half"), "id") % 2 == 0).alias("scored"))
    return materialize(rows, "labelled"), counts


def _sketches(batches):
    """(key, sketch) of each text: the least hash of its word triples under each of some mixings."""
    words = Words(SEPARATORS)
    salts = mix(np.arange(1, SKETCH + 1, dtype=np.uint64))
    for batch in batches:
        for part in bounded(batch, "text"):
            hashes, owner, _, _ = words.split(text_bytes(part.column("text")))
            cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
            out = []
            for a, b in zip(cut[:-1], cut[1:]):
                w, least = hashes[a:b], np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
                w = mix(mix(w[:-2] * GOLDEN + w[1:-1]) * GOLDEN + w[2:]) if len(w) > 2 else mix(w)
                for at in range(0, len(w), 4096):
                    np.minimum(least, mix(w[at:at + 4096, None] ^ salts[None]).min(axis=0), out=least)
                out.append(least.tobytes())
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.binary())], ["key", "sketch"])


def copy_groups(sketches: np.ndarray) -> np.ndarray:
    """Number of the group of near copies of each row of sketches: rows that agree in a band and in ``COPY`` of all entries."""
    parent = np.arange(len(sketches))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for band in np.split(sketches, BANDS, axis=1):
        bucket = np.unique(band, axis=0, return_inverse=True)[1].reshape(-1)
        left = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
        # each round links rows to the first one left of their bucket; what is unlike it waits for the next
        while len(left):
            _, first, place = np.unique(bucket[left], return_index=True, return_inverse=True)
            head = left[first][place.reshape(-1)]
            alike = (sketches[left] == sketches[head]).mean(axis=1) >= COPY
            for i, j in zip(left[alike].tolist(), head[alike].tolist()):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            left = left[~alike]
    return np.array([root(i) for i in range(len(parent))], np.int64)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Lexicon, field and document weights from labelled rows outside the held-out fold.

    Token labels come from the document labels: every token of a clean document is clean; a token of a toxic one is
    toxic when a word, prefix or suffix of it is found far more often in toxic documents.  Near copies of one text count
    as one document of their label: a feature is counted once for all of them, so what only copies share is no evidence,
    and what few documents have is, once they are many enough for the likelihood ratio.
    """
    rows, counts = training_rows(docs, labels, per_class, id_column, text_column)
    all_rows = counts[0][1] + counts[1][1]
    prior = (counts[1][1] + 0.5) / (all_rows + 2)
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), None, np.zeros(3), prior)
    if not counts[0][0] or not counts[1][0]:
        return empty

    part_rows = rows.where("not scored").select(F.xxhash64("text").alias("key"), "text", "toxic")
    sketched = part_rows.mapInArrow(_sketches, "key long, sketch binary").groupBy("key").agg(F.first("sketch").alias("sketch"), F.count("*").alias("n")).orderBy("key").collect()
    keys = np.array([r.key for r in sketched], np.int64)
    group = copy_groups(np.frombuffer(b"".join(bytes(r.sketch) for r in sketched), np.uint64).reshape(-1, SKETCH))
    several = np.bincount(group, weights=[r.n for r in sketched], minlength=len(keys))[group] > 1 if len(keys) else np.zeros(0, bool)
    copies = docs.sparkSession.sparkContext.broadcast((keys[several], group[several]))

    def groups_of(key):
        """Group of near copies of each row, -1 for texts without any."""
        known, group = copies.value
        if not len(known):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        return np.where(known[at] == key, group[at], -1)

    def grouped(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(groups_of(np.asarray(batch.column("key"))), pa.int64())], ["toxic", "copies"])

    def count(batches):
        tokens = Tokens()
        for batch in batches:
            for part in bounded(batch, "text"):
                texts, toxic = text_bytes(part.column("text")), np.asarray(part.column("toxic"))
                own = groups_of(np.asarray(part.column("key")))
                owner, _, _, place, distinct, parts = tokens.read(texts)
                seen = np.unique(np.stack((owner, place), 1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
                which, found = tokens.features(distinct, parts)
                # a feature counts once per document that has it
                order = np.argsort(which, kind="stable")
                which, found = which[order], found[order]
                many = np.bincount(which, minlength=len(parts))
                start = np.cumsum(many) - many
                size = many[seen[:, 1]]
                at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[seen[:, 1]], size)
                pairs = np.unique(np.stack((np.repeat(seen[:, 0], size).astype(np.uint64), found[at]), 1), axis=0)
                row = pairs[:, 0].astype(np.int64)
                for label in (0, 1):
                    for lone in (True, False):
                        at = (toxic[row] == label) & ((own[row] < 0) == lone)
                        value, n = np.unique(np.stack((own[row[at]].view(np.uint64), pairs[at, 1]), 1), axis=0, return_counts=True)
                        value = np.ascontiguousarray(value.T).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(value[1]), pa.array(np.full(len(n), label), pa.int32()), pa.array(value[0]), pa.array(n, pa.int64())], ["feature", "toxic", "copies", "n"])

    once = F.when(F.col("copies") < 0, F.col("n")).otherwise(1)
    sides = part_rows.select("key", "toxic").mapInArrow(grouped, "toxic int, copies long").groupBy("toxic", "copies").agg(F.count("*").alias("n")).groupBy("toxic").agg(F.sum(once).alias("n"))
    sides = {r.toxic: r.n for r in sides.collect()}
    n_clean, n_toxic = sides.get(0, 0), sides.get(1, 0)
    if not n_clean or not n_toxic:
        return empty
    share = n_toxic / (n_clean + n_toxic)
    lexicon = part_rows.mapInArrow(count, "feature long, toxic int, copies long, n long").groupBy("feature", "toxic", "copies").agg(F.sum("n").alias("n"))
    lexicon = lexicon.withColumn("n", once).groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    both = F.col("bad") + F.col("good")
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    # what chance alone brings about among many rare features is left out by the likelihood ratio
    sure = 2 * (part(F.col("bad"), both * share) + part(F.col("good"), both * (1 - share)))
    lexicon = lexicon.withColumn("evidence", F.log((F.col("bad") + SHRINK * share) / (F.col("good") + SHRINK * (1 - share))) - float(np.log(share / (1 - share))))
    lexicon = lexicon.where((F.col("evidence") >= float(CUTS[0])) & (sure >= SURE)).orderBy(F.desc("evidence"), "feature").limit(LEXICON).collect()
    known = np.array([r.feature for r in lexicon], np.int64).view(np.uint64)
    order = np.argsort(known)
    model = Model(known[order], np.array([r.evidence for r in lexicon])[order], None, np.zeros(3), prior)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def observe(batches):
        tokens = Tokens()
        for batch in batches:
            for part in bounded(batch, "text"):
                owner, _, _, place, distinct, parts = tokens.read(text_bytes(part.column("text")))
                evidence = tokens.evidence(distinct, parts, sent.value)[place]
                is_toxic = np.asarray(part.column("toxic"))[owner] == 1
                code = _observe(evidence) * 2 + ((evidence >= TOXIC_EVIDENCE) & is_toxic)
                cut = np.cumsum(np.bincount(owner, minlength=part.num_rows))[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.uint8).tobytes() for x in np.split(code, cut)], pa.binary())], ["tokens"])

    coded = materialize(rows.where("not scored").select("text", "toxic").mapInArrow(observe, "tokens binary"), "tokens")
    model.field = _fit_field(coded)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        tokens = Tokens()
        for batch in batches:
            for part in bounded(batch, "text"):
                found, *_ = _document(sent.value, tokens, text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([*map(pa.array, found), part.column("toxic")], ["total", "most", "toxic"])

    got = rows.where("scored").select("text", "toxic").mapInArrow(measure, "total double, most double, toxic int").collect()
    label = np.array([r.toxic for r in got], float)
    if len(set(label)) < 2:
        return empty
    weight = np.where(label == 1, counts[1][1] / counts[1][0], counts[0][1] / counts[0][0])
    model.weights = _logistic(_design(*(np.array([r[x] for r in got]) for x in ("total", "most"))), label, weight / weight.mean())
    return model


def _fit_field(coded: DataFrame) -> Field:
    """Generalized iterative scaling: each round compares expected with labelled counts, summed over the tasks.

    A token has two features, its observation and its step, which makes half the log ratio the step to take.
    """
    def counted(field):
        def run(batches):
            sums = np.zeros(2 + 4 + 2 * OBSERVED)
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    group = [np.frombuffer(x, np.uint8) for x in batch.column(0).slice(at, 64).to_pylist()]
                    owner = np.repeat(np.arange(len(group)), [len(x) for x in group])
                    code = np.concatenate([np.zeros(0, np.uint8), *group]).astype(np.int64)
                    opens, observed = _opens(owner), code >> 1
                    if field is None:
                        both = np.stack((1.0 - (code & 1), (code & 1).astype(float)), 1)
                        pair = np.zeros((len(code), 2, 2))
                        pair[np.arange(1, len(code)), code[:-1] & 1, code[1:] & 1] = 1.0
                        pair[opens] = 0.0
                    else:
                        both, pair = marginals(field, observed, opens)
                    seen = [np.bincount(observed, weights=both[:, s], minlength=OBSERVED) for s in (0, 1)]
                    sums += np.concatenate((both[opens].sum(axis=0), pair.sum(axis=0).ravel(), *seen))
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["sums"])

        parts = coded.mapInArrow(run, "sums array<double>")
        return np.array(parts.agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(6 + 2 * OBSERVED))).first(), float) + 0.5

    def unpacked(values):
        return Field(values[:2], values[2:6].reshape(2, 2), values[6:].reshape(2, OBSERVED))

    labelled = counted(None)
    start = unpacked(labelled)
    field = Field(np.log(start.first / start.first.sum()), np.log(start.step / start.step.sum(axis=1, keepdims=True)), np.log(start.seen / start.seen.sum(axis=1, keepdims=True)))
    for _ in range(ROUNDS):
        ratio = unpacked(0.5 * np.log(labelled / counted(field)))
        field = Field(field.first + ratio.first, field.step + ratio.step, field.seen + ratio.seen)
    return field


def score_documents(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Every row with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``spans``, the offending code point ranges.

    A span is a run of words whose toxic marginal is 0.5 or more.  ``doc`` holds the input columns without the text, which
    stands beside it.

    * null, empty and wordless texts have no token: their score is what the document weights give for no evidence;
    * a model without labels of both classes gives every row the smoothed share of toxic labels and no spans;
    * repeated rows score alike; an empty table gives an empty table; other columns may have any name.
    """
    prepared(docs.sparkSession)
    rows = packed(docs, (text_column,), text=text_column)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def score(batches):
        tokens = Tokens()
        for batch in batches:
            for part in bounded(batch, "text"):
                texts = text_bytes(part.column("text"))
                spans: list[list[dict]] = [[] for _ in texts]
                if sent.value.field is None:
                    scores = np.full(len(texts), sent.value.prior)
                else:
                    found, owner, begin, end, toxic = _document(sent.value, tokens, texts)
                    scores = 1 / (1 + np.exp(-np.clip(_design(*found) @ sent.value.weights, -30, 30)))
                    bad = np.flatnonzero(toxic >= 0.5)
                    fresh = np.ones(len(bad), bool)
                    fresh[1:] = (np.diff(bad) > 1) | (owner[bad[1:]] != owner[bad[:-1]])
                    heads = np.flatnonzero(fresh)
                    for a, b in zip(bad[heads], bad[np.append(heads[1:], len(bad)) - 1] if len(bad) else ()):
                        text = texts[owner[a]]
                        left = len(text[:begin[a]].decode(errors="ignore"))
                        spans[owner[a]].append({"start": left, "end": left + len(text[begin[a]:end[b]].decode(errors="ignore"))})
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("text"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, span)],
                    ["doc", "text", "score", "predicted", "spans"])

    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([rows.schema["doc"], rows.schema["text"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", kind)])
    return rows.mapInArrow(score, schema)
