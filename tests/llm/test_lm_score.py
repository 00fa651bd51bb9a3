"""Cross-entropy difference: both plans against a plain computation, and that it tells the sides apart."""

import math
import random
import re
from collections import Counter

import pytest

from threadlake.llm import queries
from threadlake.llm.lm_score import BACK_OFF, MIN_PAIRS, MIN_WORDS, score_corpus, score_documents, train

SCHEMA = "doc_id long, text string, gram string, n int"


def corpus(seed=1):
    rng = random.Random(seed)
    good, bad = ["the", "cat", "sat", "on", "a", "mat"], ["buy", "now", "cheap", "the", "pills", "a"]
    rows = [(i, " ".join(rng.choice(good if i % 3 == 0 else bad) for _ in range(rng.randint(0, 60)))) for i in range(240)]
    return rows + [(240, None), (241, ""), (242, "...!"), (243, "Étrange CAT sat"), (3, rows[3][1]), (None, "the cat sat"), (244, "the cat " * 9000)]


def plain(training, texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    single, pair, total = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for text, side in training:
        w = words(text)
        single[side].update(w)
        pair[side].update(zip(w, w[1:]))
        total[side] += len(w)
    known = {w for w in single[0] | single[1] if single[0][w] + single[1][w] >= MIN_WORDS}
    pairs = {p for p in pair[0] | pair[1] if pair[0][p] + pair[1][p] >= MIN_PAIRS}
    least = min(total)
    scale = [least / t if t else 0.0 for t in total]
    out = []
    for text in texts:
        w, loss = words(text), [0.0, 0.0]
        for i, x in enumerate(w):
            for s in (0, 1):
                alone = (scale[s] * single[s][x] * (x in known) + 1) / (scale[s] * total[s] + len(known) + 1)
                p = (w[i - 1], x) if i else None
                c = pair[s][p] if p in pairs else 0
                h = single[s][w[i - 1]] if i and w[i - 1] in known else 0
                loss[s] -= math.log((scale[s] * c + BACK_OFF * alone) / (scale[s] * h + BACK_OFF))
        n = max(1, len(w))
        out.append((len(w), loss[0] / n, loss[1] / n))
    return out


def score(docs, target, plan):
    """Scores by small models that are sent, by models that are joined, or block by block."""
    if plan in ("sent", "joined"):
        return score_documents(docs, train(docs, target), broadcast_entries=1 << 21 if plan == "sent" else -1)
    return score_corpus(docs, target, block_bytes=plan)


PLANS = ["sent", "joined", 200, 1 << 23]


@pytest.mark.parametrize("plan", PLANS)
def test_against_plain_models(spark, plan):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "g", 1) for i, t in rows], SCHEMA)
    good = spark.createDataFrame([(i,) for i in range(0, 120, 3)] + [(None,), (9,)], "doc_id long")
    named = {*range(0, 120, 3), 9}
    training = [(t, 0 if i in named else 1) for i, t in rows]
    got = sorted((r["id"] is None, r["id"] or 0, r.n_tokens, round(r.target_loss, 9), round(r.background_loss, 9)) for r in score(docs, good, plan).collect())
    want = sorted((i is None, i or 0, n, round(a, 9), round(b, 9)) for (i, _), (n, a, b) in zip(rows, plain(training, [t for _, t in rows])))
    assert len(got) == len(want)
    for x, y in zip(got, want):
        assert x[:3] == y[:3] and x[3:] == pytest.approx(y[3:], abs=1e-6)


def test_held_out_documents_are_told_apart(spark):
    rows = corpus(7)
    docs = spark.createDataFrame([(i, t, "g", 1) for i, t in rows], SCHEMA)
    good = spark.createDataFrame([(i,) for i in range(0, 120, 3)], "doc_id long")
    score = {r["id"]: r.score for r in score_documents(docs, train(docs, good)).where("n_tokens >= 10").collect()}
    held = [(score[i], i % 3 == 0) for i in range(120, 240) if i in score]
    right = sum(a > b for a, x in held if x for b, y in held if not y)
    assert right >= 0.95 * sum(x for _, x in held) * sum(not x for _, x in held)


@pytest.mark.parametrize("plan", PLANS)
def test_empty_sides(spark, plan):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    got = sorted((r["id"], r.n_tokens, round(r.score, 9)) for r in score(docs, none, plan).collect())
    assert got == [(1, 2, 0.0), (2, 0, 0.0)]
    assert score(docs.limit(0), none, plan).count() == 0


def test_one_target_document_among_many(spark):
    """No resolution: the background is whole however small the target's share is."""
    rows = [(0, "rare words of one target text rare words")] + [(i, f"common text {i % 7} of the many") for i in range(1, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    words, _, totals = train(docs, spark.createDataFrame([(0,)], "doc_id long"))
    assert totals == (8.0, 6.0 * 2999)
    assert words.agg({"background": "sum"}).first()[0] == 6 * 2999


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = dict(zip([i for i, _ in rows], plain([(t, 0 if i in good else 1) for i, t in rows], [t for _, t in rows])))
    got = queries.QUERIES["op9_lm_score"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        n, target, background = want[r.doc_id]
        assert r.n_tokens == n and (r.target_loss, r.background_loss, r.score) == pytest.approx((target, background, background - target), abs=1e-6)


def test_ids_of_other_types_are_refused(spark):
    docs = spark.createDataFrame([("a", "x y")], "doc_id string, text string")
    with pytest.raises(TypeError, match="whole numbers"):
        train(docs, spark.createDataFrame([(1,)], "doc_id long"))
