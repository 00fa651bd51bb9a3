"""The field against enumeration, and held-out accuracy of the whole."""

import itertools
import random

import numpy as np
import pytest

from threadlake.llm import toxicity
from threadlake.llm.queries import QUERIES
from threadlake.llm.toxicity import OBSERVED, Field, fit, marginals, score_documents


def test_marginals_against_enumeration(monkeypatch):
    rng = np.random.default_rng(0)
    field = Field(rng.normal(size=2), rng.normal(size=(2, 2)), rng.normal(size=(2, OBSERVED)))
    lengths = [1, 5, 8, 3]
    observed = rng.integers(0, OBSERVED, sum(lengths))
    opens = np.zeros(len(observed), bool)
    opens[np.cumsum([0] + lengths[:-1])] = True
    for block in (64, 3):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        both, pair = marginals(field, observed, opens)
        at = 0
        for n in lengths:
            o, total, want, pairs = observed[at:at + n], 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
            for y in itertools.product((0, 1), repeat=n):
                w = np.exp(field.first[y[0]] + sum(field.seen[s, x] for s, x in zip(y, o)) + sum(field.step[a, b] for a, b in zip(y, y[1:])))
                total += w
                for i, s in enumerate(y):
                    want[i, s] += w
                    if i:
                        pairs[i, y[i - 1], s] += w
            assert np.allclose(want / total, both[at:at + n]) and np.allclose(pairs / total, pair[at:at + n])
            at += n


def corpus(seed, n=600):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8)))
    bad = ["zwogling", "Zwogster", "zwogéa", "vile-thing", "xyxy"]
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(3, 80))]
        if i % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_accuracy_and_spans(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, 0.0, "p") for i, t, _ in rows], "doc_id long, text string, score double, spans string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 400], "doc_id long, quality int, toxic int")
    got = {r.doc["doc_id"]: r for r in score_documents(docs, fit(docs, labels)).collect()}
    held = rows[400:]
    assert np.mean([got[i].predicted == y for i, _, y in held]) >= 0.95
    named = [text[s.start:s.end].lower() for i, text, y in held if y for s in got[i].spans]
    assert sum(any(b in n for b in ("zwog", "vile", "thing", "xyxy")) for n in named) >= 0.9 * len(named) > 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_rare_toxic_words_are_found(spark):
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    clean, bad = [word("abcdefgh") for _ in range(400)], [word("mnopqrstuvwxyz") for _ in range(150)]
    rows = []
    for i in range(10_000):
        words = [rng.choice(clean) for _ in range(rng.randint(6, 20))]
        for _ in range(2 * (i % 2)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = score_documents(docs, fit(docs, labels)).where("crc32(cast(doc.doc_id as string)) % 5 = 0").select("doc.doc_id", "predicted").collect()
    assert sum(r.predicted == 1 for r in got if r.doc_id % 2) >= 0.98 * sum(r.doc_id % 2 for r in got)
    assert sum(r.predicted for r in got if r.doc_id % 2 == 0) <= 0.01 * len(got)


def test_near_copies_are_one_document():
    rng = np.random.default_rng(3)
    words = lambda: " ".join("w%d" % x for x in rng.integers(0, 5000, 80))
    base, texts = words(), []
    for i in range(40):
        w = base.split()
        w[i] = "changed%d" % i
        texts.append(" ".join(w))
    texts += [base, base] + [words() for _ in range(20)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["key", "text"])
    found = [b.column("sketch").to_pylist() for b in toxicity._sketches([batch])]
    sketches = np.frombuffer(b"".join(x for part in found for x in part), np.uint64).reshape(-1, toxicity.SKETCH)
    group = toxicity.copy_groups(sketches)
    assert len(set(group[:42])) == 1 and len(set(group[41:])) == 21


def test_labels_of_the_held_out_fold_change_nothing(spark):
    from pyspark.sql import functions as F

    rows = corpus(5, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    wrong = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda l: {r.doc["doc_id"]: round(r.score, 12) for r in score_documents(docs, fit(docs, l)).collect()}
    assert score(labels) == score(wrong)


@pytest.mark.parametrize("kept", [[], [0], [1]])
def test_without_both_classes(spark, kept):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "x " * 60_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in (1, 2, 7) for y in kept] + [(None, 1), (3, None), (4, 5)], "doc_id long, toxic int")
    got = score_documents(docs, fit(docs, labels)).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1 and all(r.spans == [] for r in got)
    assert score_documents(docs.limit(0), fit(docs.limit(0), labels)).count() == 0


def test_query_fold(spark):
    import zlib

    got = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
