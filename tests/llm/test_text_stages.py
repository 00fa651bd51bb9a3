"""Line deduplication and BPE against brute force, and their edge cases."""

import hashlib

import pytest

from threadlake.llm import bpe, queries
from threadlake.llm.line_dedup import drop_frequent_lines

SCHEMA = "doc_id long, text string, hashes string, drop int"


def brute_lines(texts, min_docs):
    strip, lower = " \t\n\x0b\x0c\r", str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    keys = [[x.strip(strip).translate(lower) for x in (t or "").split("\n")] for t in texts]
    count = {}
    for row in keys:
        for key in set(row):
            count[key] = count.get(key, 0) + 1
    return [
        "\n".join(x for x, k in zip((t or "").split("\n"), row) if not k or count[k] < min_docs)
        for t, row in zip(texts, keys)
    ]


def test_lines(spark):
    texts = ["a\nB \nc", " b\nB\n\n", None, "", "\tb", "É\né\na", "x" * 50_000 + "\nb\n" + "y\n" * 3000, "only", "b", "b"]
    docs = spark.createDataFrame([(i % 9, t, "h", 1) for i, t in enumerate(texts)], SCHEMA)
    got = drop_frequent_lines(docs, min_docs=4).select("doc.doc_id", "text", "n_lines", "doc.hashes").collect()
    want = sorted(zip([i % 9 for i in range(10)], brute_lines(texts, 4)))
    assert sorted((r.doc_id, r.text) for r in got) == want
    assert all(r.hashes == "h" for r in got)
    assert {r.n_lines for r in got if r.text == ""} >= {1}


def test_repeated_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "own\nshared", "", 0)] * 5 + [(i, "shared", "", 0) for i in (2, 3)] + [(4, "own", "", 0)], SCHEMA)
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in drop_frequent_lines(docs, min_docs=3).select("doc.doc_id", "text", "n_dropped").collect())
    assert got == [(1, "own", 1)] * 5 + [(2, "", 1), (3, "", 1), (4, "own", 0)]


def test_lines_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "q\nz", "", 0), (None, "q", "", 0), (1, "q", "", 0)], SCHEMA)
    assert sorted(r.text for r in drop_frequent_lines(docs, min_docs=3).collect()) == ["", "", "z"]
    assert drop_frequent_lines(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(queries.vocabulary())


TEXTS = [
    None, "", " ", "Hello, World's 123 <|endoftext|>x <|startoftext|>", "á é x y\x1cz\x85w", "naïve İSTANBUL ΣΑΣ ß ﬁ",
    "日本語のテキスト" * 400, "abc" * 3000, "it's they'll 'st ''s " * 500, "🙂👩‍👩‍👧 ok\n\n\tq\r\nz", "the cat sat " * 4000, "the cat sat " * 4000, "́x ́y",
]


@pytest.mark.parametrize("leaf", [7, 64, 32_768])
def test_bpe(spark, library, leaf):
    texts = TEXTS if leaf > 7 else [t for t in TEXTS if not t or len(t) < 4000]
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)], "doc_id long, text string, key string, ids int")
    got = {r.doc_id: r for r in bpe.encode_texts(docs, queries.vocabulary(), leaf=leaf).select("doc.doc_id", "ids", "decoded").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == want, (i, leaf)
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_texts(docs, queries.vocabulary()).count() == 0


def test_bpe_refuses_tokens_with_white_space(spark):
    docs = spark.createDataFrame([(1, "hello  world foo")], "doc_id long, text string")
    with pytest.raises(ValueError, match="white space"):
        bpe.encode_texts(docs, queries.vocabulary("byte_bpe_50k.json"))


def test_bpe_joins_at_digits(library):
    """Long text without white space: windows end at digits, so little is encoded again and the ids are the library's."""
    import base64
    import random

    text = base64.b64encode(random.Random(3).randbytes(60_000)).decode() + "héÉ9ſt'9s'1t9\u03019\u0345" * 40
    encoder = bpe.Encoder.of(queries.vocabulary())
    pieces = [text[i:i + 1000] for i in range(0, len(text), 1000)]
    ids = [encoder.one(piece) for piece in pieces]
    again, one = [], encoder.one
    encoder.one = lambda part: again.append(len(part)) or one(part)
    try:
        got = bpe.tree_ids(encoder, pieces, ids)
    finally:
        del encoder.one
    assert got.tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(again) < len(text) / 2


def test_bpe_query(spark, library):
    from public_tokenizers import path  # noqa: F401

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op5_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
