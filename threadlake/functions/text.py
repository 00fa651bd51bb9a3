"""Search terms, term predicates, excerpts and highlighting."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlake.functions.scalars import fold


def search_terms(query: str) -> list[str]:
    """Quoted phrases or words of one query, lower case, distinct, in order."""
    found = [(a or b).strip() for a, b in re.findall(r'"([^"]+)"|(\S+)', (query or "").lower())]
    return list(dict.fromkeys(term for term in found if term))


def search_terms_column(query: Column) -> Column:
    """The same for a column of queries."""
    quoted = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r'("[^"]+"|\S+)'), F.lit(1))
    bare = F.transform(quoted, lambda t: F.trim(F.when(t.rlike('^"[^"]+"$'), F.regexp_replace(t, '"', "")).otherwise(t)))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def search_tokens(query: str) -> list[str]:
    """Runs of letters, digits, underscore and hyphen; the tokens of ranked search."""
    import regex

    return regex.findall(r"[\p{L}\p{N}_-]+", query or "")


def matches(haystack: Column, terms: Sequence[str], mode: str = "contains") -> Column:
    """All terms occur in the lower-cased text; no term matches everything."""
    text = F.lower(haystack)
    if mode == "whole":
        tests = [text.rlike(whole_word(term)) for term in terms]
    else:
        tests = [text.contains(term) for term in terms]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def whole_word(term: str) -> str:
    """Pattern of a term with no letter or digit next to it; underscore is a boundary."""
    return rf"(?iu)(^|[^\p{{L}}\p{{N}}])\Q{term}\E(?=$|[^\p{{L}}\p{{N}}])"


def excerpt(value: Column, terms: Sequence[str], maximum: int = 420, lead: int = 120) -> Column:
    """Part of a text around the first hit; an ellipsis marks each cut side."""
    text = F.coalesce(value, F.lit(""))
    lower = F.lower(text)
    size = F.length(text)
    hits = [F.when(F.instr(lower, term) > 0, F.instr(lower, term) - 1) for term in terms]
    hit = F.coalesce(F.least(*hits) if len(hits) > 1 else (hits[0] if hits else F.lit(0)), F.lit(0))
    start = F.greatest(F.lit(0), F.least(hit - lead, size - maximum))
    body = F.trim(F.regexp_replace(F.substring(text, start + 1, F.lit(maximum)), r"^\s+|\s+$", ""))
    cut = F.concat(
        F.when(start > 0, "…").otherwise(""), body, F.when(start + maximum < size, "…").otherwise("")
    )
    return F.when(size <= maximum, text).otherwise(cut)


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def highlight(text: Column, terms: Sequence[str], whole: bool = False) -> Column:
    """Escaped text with mark tags around each term, longest term first."""
    safe = escape_html(F.coalesce(text, F.lit("")))
    for term in sorted(dict.fromkeys(terms), key=len, reverse=True):
        if whole:
            safe = F.regexp_replace(
                safe, rf"(?iu)(^|[^\p{{L}}\p{{N}}])(\Q{term}\E)(?=$|[^\p{{L}}\p{{N}}])", "$1<mark>$2</mark>"
            )
        else:
            safe = F.regexp_replace(safe, rf"(?iu)(\Q{term}\E)", "<mark>$1</mark>")
    return safe


def tokens(text: Column) -> Column:
    """Lower-case letter and digit runs, the way the ranked index splits text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def folded_tokens(text: Column) -> Column:
    """The same without accents."""
    return tokens(fold(F.lower(F.coalesce(text, F.lit("")))))


def split_folded(text: str) -> list[str]:
    """What ``folded_tokens`` makes of a text, for one string."""
    import regex
    import unicodedata

    return regex.findall(r"[\p{L}\p{N}]+", regex.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", text.lower())))


def marked(text: str, phrases: Sequence[Sequence[str]], words: int) -> str:
    """About ``words`` words of a text from a few before the first phrase on; a whole phrase stands in brackets."""
    import regex

    # a word and the accents that follow its letters, as the search sees them
    found = list(regex.finditer(r"[\p{L}\p{N}][\p{L}\p{N}\u0300-\u036f]*", text))
    tokens = [(token, i) for i, word in enumerate(found) for token in split_folded(word.group())]
    hits: dict[int, int] = {}  # first word: last word
    for phrase in phrases:
        for at in range(len(tokens) - len(phrase) + 1):
            if all(tokens[at + k][0] == word for k, word in enumerate(phrase)):
                first, last = tokens[at][1], tokens[at + len(phrase) - 1][1]
                hits[first] = max(last, hits.get(first, 0))
    start = max(0, min(hits, default=0) - words // 4)
    if not found:
        return text.strip()
    stop = min(len(found), start + words)
    out, at, end = [], found[start].start(), -1
    for i in range(start, stop):
        out.append(text[at:found[i].start()])
        at = found[i].start()
        if i > end and i in hits:
            end = min(hits[i], stop - 1)
            out.append("[")
        out.append(text[at:found[i].end()])
        at = found[i].end()
        if i == end:
            out.append("]")
    out.append(text[at:found[stop].start() if stop < len(found) else len(text)])
    return ("…" if start else "") + "".join(out).strip() + ("…" if stop < len(found) else "")


def snippet(text: Column, phrases: Column, words: int = 18) -> Column:
    """The same for a column of texts and one of phrase lists.  For the few rows of a result: the search folds the way this does."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([marked(x or "", p, words) for x, p in zip(texts, asked)], dtype=object)

    return cut(text, phrases)
