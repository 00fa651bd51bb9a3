"""FM-index search against a plain scan."""

import random
import re

import numpy as np
import pytest

from threadlake.llm.fm_index import FMIndex, find_passages

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(texts, items, window):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    lines = []
    for item, text in items:
        w = words(text)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            lines.append((item, w[at:at + window]))
    out = []
    for text in texts:
        w = words(text)
        hit, named = [False] * len(w), set()
        for item, line in lines:
            for at in range(len(w) - len(line) + 1):
                if w[at:at + len(line)] == line:
                    hit[at:at + len(line)] = [True] * len(line)
                    if item is not None:
                        named.add(str(item))
        out.append((len(w), sum(hit), sorted(named)))
    return out


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    for sigma, depth in ((1, 3), (3, 10), (70, 4)):
        text = rng.integers(0, sigma + 1, 3000)
        text[-1] = 0
        index = FMIndex(text, sigma)
        phrases, lengths = np.zeros((200, depth), np.int64), rng.integers(1, depth + 1, 200)
        for i, n in enumerate(lengths):
            at = rng.integers(0, len(text) - n)
            part = text[at:at + n]
            phrases[i, depth - n:] = np.where(part > 0, part, 1)
        which, place = index.locate(*index.search(phrases, lengths))
        got = {}
        for i, p in zip(which, place):
            got.setdefault(int(i), []).append(int(p))
        for i, n in enumerate(lengths):
            want = [p for p in range(len(text) - n + 1) if (text[p:p + n] == phrases[i, depth - n:]).all()]
            assert sorted(got.get(i, [])) == want


@pytest.mark.parametrize("block_words", [1 << 20, 40])
def test_against_scan(spark, block_words):
    rng = random.Random(5)
    vocabulary = ["the", "A", "cat", "ÉTÉ", "x1", "on", "mat", "日本"]
    phrase = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(rng.choice([1, 3, 4, 6, 9]) if i % 5 == 0 else rng.randint(4, 12))) for i in range(1, 30)] + [(7, phrase(5)), (40, None), (41, ""), (42, "..."), (None, "on on on on")]
    items = [x for x in items if x[1] is None or len(WORD.findall(x[1])) != 1]
    texts = [phrase(rng.randint(0, 200)) for _ in range(60)] + [None, "", "!!", phrase(20_000)] + [items[3][1]] * 3
    docs = spark.createDataFrame([(i // 2, t, "n", 5) for i, t in enumerate(texts)], "doc_id long, text string, items string, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_passages(docs, bench, window=4, block_words=block_words)
    got = [(r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), r["items"]) for r in found.collect()]
    assert sorted(got) == sorted(brute(texts, items, 4))
    whole = sorted((r.doc["doc_id"], r.text or "", [tuple(s) for s in r.spans]) for r in found.collect())
    cut = sorted((r.doc["doc_id"], [tuple(s) for s in r.spans], r.text or "") for r in find_passages(docs, bench, window=4, block_words=block_words, cut=True).collect())
    want = []
    for key, text, spans in whole:
        for _, _, start, end in reversed(spans):
            text = text[:start] + text[end:]
        want.append((key, [*spans], text))
    assert cut == sorted((key, [tuple(s) for s in spans], text) for key, spans, text in want)


def test_cut_text_and_empty_sides(spark):
    docs = spark.createDataFrame([(1, "Keep é this; a b c d. and that"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "A, b c D")], "item_id string, text string")
    rows = {r.doc["doc_id"]: r for r in find_passages(docs, bench, window=4, cut=True).collect()}
    assert rows[1].text == "Keep é this; . and that" and rows[1]["items"] == ["q"] and rows[2].text is None
    assert [r.spans for r in find_passages(docs, bench.limit(0)).collect()] == [[], []]
    assert find_passages(docs.limit(0), bench).count() == 0
