"""Personal data: strict patterns, plus candidate spans that boosted trees accept.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from threadlake.llm.common import packed, prepared

KINDS = ("email", "ip", "card", "phone")

# The strict patterns.  Quantifiers are possessive and starts are tied to the start of a run, so a search is linear in
# the text; the matches are those of the plain patterns (nothing is given back that could match further left).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Generators with high recall.  A numeric run holds every strict number that touches it, a token every strict address.
NUMERIC = r"[+(0-9][+0-9 ().-]*+"
TOKEN = r"(?<![^ \t\n\x0B\f\r])[^ \t\n\x0B\f\r@]*+@[^ \t\n\x0B\f\r]*+"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({](?:dot|DOT)[\])}]) ?[A-Za-z0-9-]++)++"
# Words before a span that speak for a kind.
CUES = (
    ("phone", r"(?i)\b(?:tel|telephone|phone|mobile|cell|call|fax|whatsapp|telefon|téléphone|teléfono)\W*$"),
    ("card", r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\W*(?:no|number|nr)?\W*$"),
    ("ip", r"(?i)\b(?:ip|host|server|address|addr|adresse)\W*$"),
    ("email", r"(?i)\b(?:mail|e-mail|email|contact|write|correo)\W*$"),
)
FEATURES = ("digits", "groups", "dots", "dashes", "spaces", "parens", "lead", "cue", "after", "shape")
ROUNDS, RATE, PRECISION = 24, 0.4, 0.95
CHUNK = 512


def _starts(gaps: Column, matches: Column) -> Column:
    """Where each match starts, in code points: gaps and earlier matches summed, in chunks so that it stays near linear."""
    sizes = F.zip_with(gaps, matches, lambda g, m: F.struct(F.char_length(g).alias("g"), F.coalesce(F.char_length(m), F.lit(0)).alias("m")))

    def chunk(at):
        return F.aggregate(
            F.slice(sizes, at + 1, F.lit(CHUNK)), F.struct(F.lit(0).alias("to"), F.array().cast("array<int>").alias("at")),
            lambda acc, x: F.struct((acc["to"] + x["g"] + x["m"]).alias("to"), F.concat(acc["at"], F.array(acc["to"] + x["g"])).alias("at")))

    chunks = F.transform(F.sequence(F.lit(0), F.size(matches) - 1, F.lit(CHUNK)), chunk)
    placed = F.aggregate(
        chunks, F.struct(F.lit(0).alias("to"), F.array().cast("array<array<int>>").alias("at")),
        lambda acc, c: F.struct((acc["to"] + c["to"]).alias("to"), F.concat(acc["at"], F.array(F.transform(c["at"], lambda x: x + acc["to"]))).alias("at")))
    return F.flatten(placed["at"])


MATCH = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def matches(df: DataFrame, name: str, pattern: str, wanted: Column) -> DataFrame:
    """Adds the leftmost non-overlapping matches with their places and what stands around them."""
    gaps, found, starts = (f"{name}_{x}" for x in ("gaps", "found", "starts"))
    df = df.withColumn(found, F.when(wanted, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    some = F.size(found) > 0
    df = df.withColumn(gaps, F.when(some, F.split("text", pattern, -1)))
    df = df.withColumn(starts, F.when(some, _starts(F.col(gaps), F.col(found))))
    rows = F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.struct(
        F.get(starts, i).alias("start"), (F.get(starts, i) + F.char_length(F.get(found, i))).alias("end"), F.get(found, i).alias("match"),
        F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after")))
    return df.withColumn(name, F.when(some, rows).otherwise(F.array().cast(MATCH))).drop(gaps, found, starts)


def valid(kind: str, text: Column) -> Column:
    digits = F.translate(text, " ().+-", "")
    if kind == "ip":
        return text.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.char_length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    return F.lit(True)


def _strict(kind: str):
    return lambda m: valid(kind, m["match"])


def _numbered(i: int):
    return lambda m: F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def _features(kind: Column, text: Column, before: Column, after: Column) -> list[Column]:
    """Format and context as small numbers, none of them a strict rule itself."""
    count = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    cue = F.lit(0)
    for i, (_, pattern) in enumerate(CUES):
        cue = F.when(before.rlike(pattern), i + 1).otherwise(cue)
    address = text.contains("@") | text.rlike(r"[\[({](?:at|AT)[\])}]")
    shape = F.when(text.rlike(r"^\+?[0-9]{0,3} ?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}$"), 1).when(
        text.rlike(r"^[0-9]{13,19}$|^[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -]?[0-9]{1,3})?$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$"), 2).when(
        text.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), 3).when(
        text.rlike(r"^[^@]+@[^@.]+(?:\.[^@.]+)*\.\p{L}{2,}$"), 4).when(
        text.rlike(r"(?i)[\[({]at[\])}].*(?:\.|[\[({]dot[\])}]) ?[a-z]{2,}$"), 5).otherwise(0)
    capped = lambda column, top: F.least(column, F.lit(top))
    return [
        capped(count("0123456789"), 20).alias("digits"),
        capped(F.when(address, F.size(F.split(text, r"[.]"))).otherwise(F.size(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)))), 6).alias("groups"),
        capped(count("."), 4).alias("dots"), capped(count("-"), 4).alias("dashes"), capped(count(" "), 4).alias("spaces"), capped(count("()[]{}"), 2).alias("parens"),
        F.when(text.rlike(r"^\p{L}"), 1).when(text.rlike(r"^0"), 2).otherwise(0).alias("lead"), cue.alias("cue"),
        F.when(after.rlike(r"^[\p{L}_]"), 1).when(after.rlike(r"^[.,;:!?)\]\"']"), 2).otherwise(0).alias("after"), shape.alias("shape"),
    ]


def candidates(df: DataFrame) -> DataFrame:
    """Adds ``proposed``: overlapping spans of all generators with kind, features and whether the strict rule holds."""
    has_digit = F.col("text").rlike("[0-9]")
    df = matches(df, "runs", NUMERIC, has_digit)
    df = matches(df, "tokens", TOKEN, F.col("text").contains("@"))
    df = matches(df, "spelled", SPELLED, F.col("text").rlike(r"(?i)[\[({]at[\])}]"))

    def spans(name: str, kind: str, left: str, right: str, wanted) -> Column:
        def one(m):
            head = F.char_length(F.regexp_extract(m["match"], left, 0))
            core = F.regexp_replace(F.substring(m["match"], head + 1, F.char_length(m["match"])), right, "")
            return F.struct(
                F.lit(kind).alias("kind"), (m["start"] + head).alias("start"), (m["start"] + head + F.char_length(core)).alias("end"), core.alias("text"),
                m["before"].alias("before"), m["after"].alias("after"),
                F.exists(F.regexp_extract_all(m["match"], F.lit(BASE[kind]), F.lit(0)), lambda x: valid(kind, x)).alias("strict"))

        return F.filter(F.transform(name, one), lambda c: wanted(c["text"]))

    digits = lambda text: F.char_length(F.translate(text, " ().+-", ""))
    lead, tail = r"^[+ ().-]*", r"(?<=[0-9])[+ ().-]++$"
    df = df.withColumn("proposed", F.concat(
        spans("runs", "ip", lead, tail, lambda t: t.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")),
        spans("runs", "card", lead, tail, lambda t: digits(t).between(13, 19)),
        spans("runs", "phone", r"^[ ).-]*", tail, lambda t: digits(t).between(7, 15)),
        spans("tokens", "email", r"^[^\p{L}0-9@]*", r"(?<=[\p{L}0-9])[^\p{L}0-9@]++$", lambda t: t.rlike(r"^[^@]+@[^@]+$")),
        spans("spelled", "email", r"^[._%+-]*", r"(?!x)x", lambda t: F.char_length(t) > 0)))
    return df.drop("runs", "tokens", "spelled").withColumn("proposed", F.transform("proposed", lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["strict"].alias("strict"),
        *_features(c["kind"], c["text"], c["before"], c["after"]))))


class Trees:
    """Gradient boosted trees of depth two over counted feature patterns, and the threshold fitted to them."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int, int]]):
        self.trees, self.threshold = [], None
        total, positive = sum(n for _, n, _ in patterns), sum(k for _, _, k in patterns)
        if not positive:
            return
        self.start = math.log((positive + 0.5) / (total - positive + 0.5))
        scores = [self.start] * len(patterns)
        for _ in range(ROUNDS):
            chance = [1 / (1 + math.exp(-s)) for s in scores]
            slope = [k - n * p for (_, n, k), p in zip(patterns, chance)]
            bend = [n * p * (1 - p) for (_, n, _), p in zip(patterns, chance)]
            tree = self._grow(patterns, slope, bend, list(range(len(patterns))), 2)
            self.trees.append(tree)
            scores = [s + self._value(tree, x) for s, (x, _, _) in zip(scores, patterns)]
        # calibration: the lowest score above which enough of what is accepted satisfies the strict rule
        kept = hits = 0
        ranked = sorted(zip(scores, patterns), key=lambda x: -x[0])
        for i, (score, (_, n, k)) in enumerate(ranked):
            kept, hits = kept + n, hits + k
            last_of_ties = i + 1 == len(ranked) or ranked[i + 1][0] < score
            if last_of_ties and hits >= PRECISION * kept:
                self.threshold = score - 1e-9

    def _grow(self, patterns, slope, bend, rows, depth):
        g, h = sum(slope[i] for i in rows), sum(bend[i] for i in rows)
        leaf = RATE * g / (h + 1.0)
        if not depth:
            return leaf
        best, cut = 1e-6, None
        for f in range(len(FEATURES)):
            by: dict[int, list[float]] = {}
            for i in rows:
                held = by.setdefault(patterns[i][0][f], [0.0, 0.0])
                held[0] += slope[i]
                held[1] += bend[i]
            left_g = left_h = 0.0
            for value in sorted(by)[:-1]:
                left_g, left_h = left_g + by[value][0], left_h + by[value][1]
                gain = left_g ** 2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g ** 2 / (h + 1)
                if gain > best:
                    best, cut = gain, (f, value)
        if cut is None:
            return leaf
        f, value = cut
        sides = [i for i in rows if patterns[i][0][f] <= value], [i for i in rows if patterns[i][0][f] > value]
        return (f, value, *(self._grow(patterns, slope, bend, side, depth - 1) for side in sides))

    def _value(self, tree, x) -> float:
        while isinstance(tree, tuple):
            f, value, left, right = tree
            tree = left if x[f] <= value else right
        return tree

    def score(self, c: Column) -> Column:
        def column(tree):
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            f, value, left, right = tree
            return F.when(c[FEATURES[f]] <= value, column(left)).otherwise(column(right))

        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + column(tree)
        return total


def fit(rows: DataFrame) -> dict[str, Trees]:
    """One model per kind from counts over all proposals.

    The strict rule labels a proposal; the features leave the rule itself out (check digits, the plus sign, octet
    values), so trees learn how such spans look and what stands before them.  What reaches the driver is one row per
    feature pattern, whose number has a fixed bound given by the feature ranges.
    """
    one = rows.select(F.explode("proposed").alias("c"))
    counted = one.groupBy("c.kind", *(F.col(f"c.{x}").alias(x) for x in FEATURES)).agg(F.count("*").alias("n"), F.sum(F.col("c.strict").cast("long")).alias("k"))
    by: dict[str, list] = {kind: [] for kind in KINDS}
    for r in counted.collect():
        by[r["kind"]].append((tuple(r[x] for x in FEATURES), r["n"], r["k"]))
    return {kind: Trees(sorted(by[kind])) for kind in KINDS}


def find_personal_data(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Every row with its personal data: ``doc`` (the input columns without the text), ``base`` and ``spans``.

    Both are arrays of (kind number, start, end) in code points, end exclusive, ordered by kind (email, ip, card,
    phone) and start.  ``base`` are the strict matches, leftmost and non-overlapping per kind; matches that fail their
    check are dropped.  ``spans`` adds proposals of the generators whose score reaches the calibrated threshold of
    their kind and whose run or token holds no strict match of any kind; of several kinds the best margin wins.

    * null and empty texts have no spans; repeated rows have the same ones; no row is dropped;
    * where no proposal satisfies a strict rule there is nothing to learn from, and nothing is added;
    * an empty table gives an empty table; other columns are carried in ``doc`` under any name.
    """
    prepared(docs.sparkSession)
    rows = packed(docs, (text_column,), text=text_column).withColumn("text", F.coalesce("text", F.lit("")))
    models = fit(candidates(rows.select("text")))
    has_digit = F.col("text").rlike("[0-9]")
    wanted = {"email": F.col("text").contains("@"), "ip": has_digit, "card": has_digit, "phone": F.col("text").contains("+")}
    span = "array<struct<kind:int,start:int,end:int>>"
    base = []
    for i, kind in enumerate(KINDS):
        rows = matches(rows, kind, BASE[kind], wanted[kind])
        held = F.filter(kind, _strict(kind))
        base.append(F.transform(held, _numbered(i)))
    rows = rows.withColumn("base", F.concat(*base).cast(span)).drop(*KINDS)
    live = {kind: model for kind, model in models.items() if model.threshold is not None}
    if not live:
        return rows.select("doc", "base", F.col("base").alias("spans"))
    rows = candidates(rows)

    def margin(c):
        out = F.lit(-1.0)
        for kind, model in live.items():
            out = F.when(c["kind"] == kind, model.score(c) - model.threshold).otherwise(out)
        return out

    number = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]).cast("int") - 1
    # proposals of one run have nearly the same place: grouped by their end, the strict ones close the group
    scored = F.transform("proposed", lambda c: F.struct(
        c["end"].alias("end"), F.when(c["strict"], F.lit(1e9)).otherwise(margin(c)).alias("margin"), c["start"].alias("start"), number(c).alias("kind")))
    rows = rows.withColumn("ranked", F.array_sort(F.filter(scored, lambda c: c["margin"] >= 0)))
    size = F.size("ranked")
    best = F.filter(F.transform("ranked", lambda c, i: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
        ((c["margin"] < 1e9) & ((i + 1 == size) | (F.get("ranked", i + 1)["end"] != c["end"]))).alias("wins"))), lambda c: c["wins"])
    added = F.transform(best, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.select("doc", "base", F.array_sort(F.concat("base", added.cast(span))).alias("spans"))
