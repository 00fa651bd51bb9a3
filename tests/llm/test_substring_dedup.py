"""Substring deduplication against a dictionary of all windows."""

import random

import numpy as np
import pytest

from threadlake.llm import substring_dedup
from threadlake.llm.queries import QUERIES
from threadlake.llm.substring_dedup import drop_repeated_substrings


def brute(rows, length):
    seen, out = {}, {}
    for key, text in sorted(rows):
        data = text.encode()
        for p in range(len(data) - length + 1):
            seen.setdefault(data[p:p + length], (key, p))
    for key, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if seen[data[p:p + length]] < (key, p):
                gone[p:p + length] = b"\1" * length
        out[key] = (bytes(b for b, g in zip(data, gone) if not g), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    texts = ["", "short", "a" * 700, "ab" * 300 + "c" + "ab" * 300, prose(300), "x" * 99, "y" * 100, "y" * 100, "z" * 20 + "y" * 101]
    for i in range(40):
        base = rng.choice(texts[4:])
        kind = i % 4
        if kind == 0:
            texts.append(base)
        elif kind == 1:
            at = rng.randrange(len(base) + 1)
            texts.append(base[:at] + "#" + base[at:])
        elif kind == 2:
            texts.append(prose(rng.randint(0, 60)) + rng.choice(shared) + prose(rng.randint(0, 40)) + rng.choice(shared))
        else:
            texts.append(prose(rng.randint(1, 200)))
    rng.shuffle(texts)
    return [(i * 3 - 20, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,length,piece", [(1, 100, 1 << 20), (2, 100, 257), (3, 20, 64), (4, 40, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, seed, length, piece):
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", piece)
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "s", 0) for k, t in rows], "doc_id long, text string, spans string, id int").repartition(5)
    got = {r.doc_id: (bytes(r.kept), len(r.spans), r.n_bytes) for r in drop_repeated_substrings(docs, length).select("doc.doc_id", "kept", "spans", "n_bytes").collect()}
    want = brute(rows, length)
    assert {k: v[:2] for k, v in got.items()} == want
    assert all(got[k][2] == len(t.encode()) for k, t in rows)


def test_edges(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(None, "q" * 100), (5, "q" * 100), (5, "q" * 100), (6, None)], schema)
    got = sorted((r.doc_id is None, r.doc_id or 0, bytes(r.kept)) for r in drop_repeated_substrings(docs).select("doc.doc_id", "kept").collect())
    assert got == [(False, 5, b""), (False, 5, b""), (False, 6, b""), (True, 0, b"q" * 100)]
    assert drop_repeated_substrings(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_a_repeated_row_keeps_its_only_copy(spark, parts):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    alone, inside, copied = text(400), "a" * 300, text(150)
    rows = [(1, alone)] * 3 + [(2, inside)] * 2 + [(3, copied)] * 2 + [(4, copied)] * 2 + [(None, alone[:120] + "!")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r.doc_id or 0, bytes(r.kept).decode()) for r in drop_repeated_substrings(docs).select("doc.doc_id", "kept").collect())
    assert got == sorted([(0, alone[:120] + "!")] * 2 + [(1, alone[120:])] * 3 + [(2, "a")] * 2 + [(3, copied)] * 2 + [(4, "")] * 2)


@pytest.mark.parametrize("seed,piece", [(1, 1 << 20), (2, 257)])
def test_clashing_and_missing_ids(spark, monkeypatch, seed, piece):
    """Different texts under one id, or under none, are documents of their own; the same text under one id is one."""
    monkeypatch.setattr(substring_dedup, "PIECE_BYTES", piece)
    rng = random.Random(seed)
    rows = [(None if i % 5 == 0 else rng.randint(0, 6), t) for i, (_, t) in enumerate(corpus(seed))]
    rows += rng.sample(rows, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    print_of = {r.text: r.p for r in docs.selectExpr("text", "xxhash64(text) as p").collect()}
    key = lambda k, t: (k is not None, k or 0, print_of[t])
    want = brute([(key(k, t), t) for k, t in rows], 100)
    keyed = docs.withColumn("named", docs.text)
    got = [(key(r.doc_id, r.named), bytes(r.kept), len(r.spans)) for r in drop_repeated_substrings(keyed).select("doc.doc_id", "doc.named", "kept", "spans").collect()]
    assert sorted(got) == sorted((key(k, t), *want[key(k, t)]) for k, t in rows)


def test_no_text_is_lost_from_every_row(spark):
    rng = random.Random(4)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    docs = spark.createDataFrame([(0, a), (1, a), (1, b), (2, c), (None, c), (None, c[:50] + a), (5, b)], "doc_id long, text string")
    kept = b"\n".join(bytes(r.kept) for r in drop_repeated_substrings(docs).select("kept").collect())
    assert all(x.encode() in kept for x in (a, b, c))


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    with pytest.raises(TypeError, match="doc_id"):
        drop_repeated_substrings(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


@pytest.mark.parametrize("size", [1, 2, 100])
def test_starts_are_counted_once_over_batches(size):
    rows = [(1, 5, 1, 0), (1, 5, 1, 0), (1, 5, 1, 0), (2, 6, 1, 9), (2, 6, 1, 9), (2, 6, 2, 0), (2, 6, 2, 0), (3, 7, 1, 3), (3, 8, 1, 4)]
    bucket, refined, own, place = (np.array(x, np.int64) for x in zip(*rows))
    columns = [bucket, refined, own, own * 7, place, np.full(len(rows), 4, np.int64)]
    batch = substring_dedup.pa.RecordBatch.from_arrays([substring_dedup.pa.array(x) for x in columns], ["bucket", "refined", "id", "print", "place", "size"])
    found = [(r["id"], r["place"], r["size"], r["open"]) for b in substring_dedup._resolve(batch.slice(i, size) for i in range(0, len(rows), size)) for r in b.to_pylist()]
    assert sorted(found) == [(1, 3, 1, True), (1, 4, 1, True), (2, 0, 1, False)]


def test_query(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 100)
    for r in QUERIES["op8_substring_dedup"](spark, sf).collect():
        kept, n_spans = want[r.doc_id]
        assert (r.n_spans, r.kept_sha256) == (n_spans, hashlib.sha256(kept).hexdigest())
        assert r.n_removed == r.n_bytes - len(kept)
