"""Jaccard components against all pairs, and connected components against union-find."""

import random

import pytest

from threadlake.llm import set_join
from threadlake.llm.common import components
from threadlake.llm.set_join import jaccard_components

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, n=5):
    words = [w for w in (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def labels(nodes, edges):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute(rows, percent=80):
    sets = [(k, shingles(t)) for k, t in rows]
    edges = [
        (a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i]
        if x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    found = labels({k for k, _ in rows}, edges)
    return sorted((k, len(s), found[k]) for k, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    passage = prose(30)
    bases = [prose(rng.randint(6, 120)) for _ in range(12)] + [prose(60) + passage for _ in range(6)]
    texts = [None, "", " \t\n", "one", "one", "ONE two", "one two three four", "a b c d e", "A b c D e", "a b c d f", "Á b c d e"]
    for base in bases:
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(copy))
                copy[at:at + rng.choice([0, 1])] = [rng.choice(words)] * rng.choice([0, 1, 2])
            texts.append(rng.choice([" ", "  ", "\n"]).join(copy))
    # a chain: neighbours link, ends do not
    chain = prose(100)
    for i in range(12):
        texts.append(" ".join(chain[i * 2:i * 2 + 80]))
    rng.shuffle(texts)
    return [(3 * i - 30, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,late", [(1, 1 << 16), (2, 5), (3, 1 << 16)])
def test_against_all_pairs(spark, monkeypatch, seed, late):
    monkeypatch.setattr(set_join, "LATE_SHINGLES", late)
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, 1, "t") for k, t in rows], "doc_id long, text string, node int, token string").repartition(4)
    got = sorted((r.id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == brute(rows)


def test_edges(spark):
    text = " ".join(f"x{i}" for i in range(20_000))
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, "a  B c"), (9, text), (8, text + " y"), (7, None)], "doc_id long, text string")
    got = sorted(((r.id or -1), r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == [(-1, 1, None), (2, 1, 2), (4, 1, 2), (4, 1, 2), (7, 0, 7), (8, 19_997, 8), (9, 19_996, 8)]
    assert jaccard_components(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(999, i) for i in range(500, 560)] + [(5, 5), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == labels({x for e in real for x in e}, real)
