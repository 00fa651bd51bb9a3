"""Spelling groups against all pairs of words."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadlake.llm import spelling
from threadlake.llm.queries import misspelled
from threadlake.llm.spelling import spelling_groups, word_counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    if len(a) == len(b):
        return a != b and a[at + 1:] == b[at + 1:]
    return len(b) == len(a) + 1 and a[at:] == b[at + 1:]


def brute(n, ratio):
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= ratio * n[a] else None
    out = set()
    for a in n:
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, form[a], root, n[a], len(near[a]), n[form[a]] if form[a] else None))
    return out


def as_rows(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("bucket", [64, 2])
def test_all_pairs(spark, monkeypatch, bucket):
    """Few letters, so that signatures are shared by many words; anagrams, repeated letters, chains of forms."""
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    rng = random.Random(3)
    n = Counter()
    for _ in range(250):
        word = "".join(rng.choice("aabcdéÿx") for _ in range(rng.choice([1, 2, 4, 5, 5, 6])))
        n[word] += rng.choice([1, 2, 30, 400, 5000])
    n.update({"aaaaaaaa": 1, "aaaaaaa": 10, "aaaaaa": 100, "aaaaa": 1000, "z": 1, "zz": 2, "a]^-b": 3, "a]^b": 40, "a\\q": 1, "q" * 30_000: 7, "q" * 30_001: 70, "q" * 29_999 + "r": 700})
    df = spark.createDataFrame([(w, c, None) for w, c in n.items()], "word string, n long, near string")
    for ratio in (10, 2):
        assert as_rows(spelling_groups(df, ratio)) == brute(n, ratio)


def test_hot_signature(spark):
    """Several thousand words share their letters; a bucket of them must not become all pairs."""
    rng = random.Random(4)
    n = {"".join(rng.sample("abcdefghij", 10)): rng.choice([1, 50]) for _ in range(3000)}
    n.update({w[:4] + "k" + w[5:]: 2 for w in list(n)[:300]})
    assert as_rows(spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n, 10)


def test_words_of_documents(spark):
    rows = [
        (1, "Straße straße STRASSE überlang Überlang a1bcdefgh", 0), (2, None, 0), (3, "", 0), (4, "lettersletters " * 3 + "Lettersletters", 0), (4, "letters" * 2, 0),
        (None, "nameless-nameless", 0), (5, "x" * 200_000 + " " + "x" * 200_000, 0), (6, "ÉCLAIRE éclaire éclaire", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = {r.word: r.n for r in word_counts(df, 7, 2).collect()}
    # only A-Z is lowered, so words with a capital umlaut or accent are others
    assert got == {"lettersletters": 5, "nameless": 2, "x" * 200_000: 2, "éclaire": 2}
    assert spelling_groups(word_counts(df.limit(0), 7, 2)).count() == 0


def test_no_words_and_nulls(spark):
    df = spark.createDataFrame([(None, 5), ("alone", None), ("single", 3)], "word string, n long")
    assert as_rows(spelling_groups(df)) == {("single", None, "single", 3, 0, None)}


def test_misspelled(spark):
    rng = random.Random(5)
    pairs = [(str(rng.randrange(10_000)), "".join(rng.choice("abcéÿ") for _ in range(rng.randrange(7, 12)))) for _ in range(2000)]
    got = [tuple(r) for r in spark.createDataFrame(pairs, "id string, w string").select("id", "w", misspelled(F.col("id"), F.col("w"))).collect()]
    changed = 0
    for i, w, out in got:
        h = zlib.crc32(f"{i}:{w}".encode())
        want = w[:h % len(w)] + w[h % len(w) + 1:] if h % 31 == 0 else w
        assert out == want
        changed += out != w
    assert changed > 20
