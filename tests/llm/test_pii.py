"""Strict personal data against plain patterns, and what the trees add."""

import random
import re

from threadlake.llm.pii import KINDS, find_personal_data
from threadlake.llm.queries import QUERIES

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for i, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((i, m.start(), m.end()))
    return out


def spans(found):
    return [tuple(s) for s in found]


def test_base_against_plain_patterns(spark):
    rng = random.Random(8)
    bits = ["a", "b.", "@", "x@y.zz", "%d", "1", "23", "255", ".", "256", " ", "-", "+", "(", ")", "+4", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "00", "é", "𝔘", "\n", "a@b.c", "@c.d", "+1 (365) 555-9807"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "0001.02.3.255", "9" * 30_000, "a" * 50_000, "a.a@" * 4000, "1.2.3.4 " * 3000, "x@y.z," * 2500, "+1" + " " * 5000]
    docs = spark.createDataFrame([(i, t, "b", 2) for i, t in enumerate(texts)], "doc_id int, text string, base string, spans int")
    for r in find_personal_data(docs).select("doc.doc_id", "base", "spans").collect():
        want = brute(texts[r.doc_id])
        assert spans(r.base) == want, repr(texts[r.doc_id])[:300]
        assert set(want) <= set(spans(r.spans)) and spans(r.spans) == sorted(spans(r.spans))


def test_trees_add_spans_of_the_same_look(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        rows.append(f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now")
        rows.append(f"chapter {i} has 12 pages in {rng.randint(1900, 2020)}")
        rows.append(f"order {rng.randint(10**9, 10**10)} of lot {rng.randint(10**7, 10**8)}")
    rows += ["call 1 (365) 555-9807 now", "nothing here", None, ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    found = {r.doc["doc_id"]: r for r in find_personal_data(docs).collect()}
    extra = found[len(rows) - 4]
    assert not extra.base and spans(extra.spans) == [(3, 5, 21)]
    assert all(spans(found[i].spans) == spans(found[i].base) for i in range(len(rows)) if i != len(rows) - 4)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "no data 12"), (2, None)], "doc_id int, text string")
    assert [(r.base, r.spans) for r in find_personal_data(docs).collect()] == [([], []), ([], [])]
    assert find_personal_data(docs.limit(0)).count() == 0


def test_query_and_plan(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    df = QUERIES["op3_pii"](spark, sf)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in df.collect():
        want = brute(texts[r.doc_id])
        named = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        assert set(filter(None, named.split(","))) <= set(r.spans.split(","))
