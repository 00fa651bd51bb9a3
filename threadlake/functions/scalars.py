"""Scalar column functions: text cleaning, time, roles, titles, paths, sizes."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadlake import constants as K

_SECONDS_LIMIT = 1e12


def clean(text: Column) -> Column:
    """Whitespace runs collapsed to one blank, ends trimmed, null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"\s+", " "))


def first_nonempty(*values: Column) -> Column:
    """First cleaned value that is not empty, else the empty text."""
    return F.coalesce(*[F.nullif(clean(v), F.lit("")) for v in values], F.lit(""))


def first_string(*values: Column) -> Column:
    """First trimmed value that is neither empty nor ``0``."""
    return F.coalesce(*[F.when(~F.trim(v).isin("", "0"), F.trim(v)) for v in values])


def to_millis(value: Column) -> Column:
    """Epoch milliseconds of a text: seconds below 1e12, else milliseconds, else ISO time.

    Blank gives null, and so does text that is neither a number nor a time.
    """
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    iso = F.try_to_timestamp(text)
    return (
        F.when(text == "", None)
        .when(number.isNotNull() & ~F.isnan(number),
              F.floor(F.when(number < _SECONDS_LIMIT, number * 1000).otherwise(number)).cast("bigint"))
        .otherwise(F.unix_millis(iso))
    )


def to_millis_strict(number: Column, text: Column | None = None) -> Column:
    """Variant for typed numbers: 0 and null give null, above 1e12 counts as milliseconds."""
    numeric = F.when(
        number != 0,
        F.floor(F.when(number > _SECONDS_LIMIT, number).otherwise(number * 1000)).cast("bigint"),
    )
    if text is None:
        return numeric
    return F.coalesce(numeric, F.when(text != "", F.unix_millis(F.try_to_timestamp(text))))


def iso_time(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def total_tokens(explicit: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Explicit total, else the sum when either part is known (missing counts as 0)."""
    either = tokens_in.isNotNull() | tokens_out.isNotNull()
    parts = F.coalesce(tokens_in, F.lit(0)) + F.coalesce(tokens_out, F.lit(0))
    return F.coalesce(explicit, F.when(either, parts))


def agent_role(role: Column) -> Column:
    """Role of an agent message; unknown roles stay, empty means assistant."""
    text = F.lower(clean(role))
    return (
        F.when(text.isin("user", "human"), "user")
        .when(text.isin("assistant", "ai", "model", ""), "assistant")
        .otherwise(text)
    )


def report_role(role: Column) -> Column:
    """Role as a report shows it: matched by content, empty means message."""
    text = F.lower(clean(role))
    return (
        F.when(text == "", "message")
        .when(text.contains("assistant") | text.isin("bot", "model"), "assistant")
        .when(text.contains("user") | (text == "human"), "user")
        .when(text.contains("system"), "system")
        .when(text.contains("tool"), "tool")
        .otherwise(text)
    )


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def model_label(name: Column, model_id: Column, model_type: Column) -> Column:
    """``name (id)`` when both differ, else the first one present."""
    return F.when(
        (F.coalesce(name, F.lit("")) != "") & (F.coalesce(model_id, F.lit("")) != "") & (name != model_id),
        F.concat(name, F.lit(" ("), model_id, F.lit(")")),
    ).otherwise(first_nonempty(name, model_id, model_type))


def title_of(*candidates: Column) -> Column:
    """First usable title, cut at 120 characters."""
    title = first_nonempty(*candidates)
    cut = F.concat(F.trim(F.substring(title, 1, 120)), F.lit("..."))
    return F.when(title == "", "Untitled conversation").when(F.length(title) <= 120, title).otherwise(cut)


def short_preview(text: Column, fallback: str = "No preview available") -> Column:
    """Preview of at most 180 characters."""
    text = F.coalesce(text, F.lit(fallback))
    return F.when(F.length(text) > 180, F.concat(F.substring(text, 1, 177), F.lit("..."))).otherwise(text)


def slug(title: Column, fallback: str = "untitled-conversation") -> Column:
    """Lower-case ASCII slug of at most 80 characters."""
    ascii_text = fold(clean(title))
    dashed = F.lower(F.regexp_replace(F.regexp_replace(ascii_text, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    short = F.regexp_replace(F.substring(dashed, 1, 80), "-+$", "")
    return F.when(short == "", fallback).otherwise(short)


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD) without combining accents."""
    return text.map(lambda t: None if t is None else re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", t)))


def fold(text: Column) -> Column:
    """Letters without accents, ligatures and other forms taken apart; plain ASCII stays on the JVM."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(plain, text).otherwise(_decomposed(F.when(~plain, text)))


def safe_identifier(value: Column, fallback: str = "id") -> Column:
    text = F.regexp_replace(F.regexp_replace(clean(value), "[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(text == "", fallback).otherwise(text)


def artifact_stem(conversation_id: Column, title: Column) -> Column:
    return F.concat(safe_identifier(conversation_id, "conversation"), F.lit("--"), slug(title))


def safe_artifact_path(path: Column, extension: str) -> Column:
    return F.coalesce(
        path.startswith("conversations/") & path.endswith(extension)
        & ~path.contains("..") & ~path.contains("\\"),
        F.lit(False),
    )


def artifact_path(conversation_id: Column, title: Column, previous: Column, extension: str) -> Column:
    """Path of a conversation document; a safe earlier path is kept."""
    fresh = F.concat(F.lit("conversations/"), artifact_stem(conversation_id, title), F.lit(extension))
    return F.when(safe_artifact_path(previous, extension), previous).otherwise(fresh)


def fnv1a32(text: Column) -> Column:
    """FNV-1a 32-bit hash as eight hex digits."""
    codes = F.transform(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("bigint"),
    )
    # 2166136261 and 16777619 are the offset and the prime of FNV-1a 32
    mixed = F.aggregate(
        F.when(F.length(text) > 0, codes).otherwise(F.array().cast("array<bigint>")),
        F.lit(2166136261).cast("bigint"),
        lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619).cast("bigint"), F.lit(4294967296).cast("bigint")),
    )
    return F.lpad(F.lower(F.hex(mixed)), 8, "0")


def store_path(name: Column) -> Column:
    """File of a source store; the hash keeps clashing names apart."""
    text = F.trim(F.coalesce(name, F.lit("")))
    dashed = F.regexp_replace(F.regexp_replace(fold(text), "[^a-zA-Z0-9._-]+", "-"), "^-+|-+$", "")
    short = F.substring(dashed, 1, 140)
    safe = F.when(short == "", "unknown-store").otherwise(short)
    return F.concat(F.lit("stores/store--"), safe, F.lit("--"), fnv1a32(text), F.lit(".json"))


def word_count(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda word: word != "")
    return F.size(words).cast("bigint")


def shown_tokens(output_tokens: Column, total: Column, text: Column) -> Column:
    """Saved token count, else a quarter of the length, at least one for any text."""
    saved = F.coalesce(F.when(output_tokens > 0, output_tokens), F.when(total > 0, total))
    length = F.length(F.coalesce(text, F.lit("")))
    estimate = F.when(length > 0, F.greatest(F.lit(1), F.ceil(length / 4))).otherwise(0)
    return F.coalesce(saved, estimate).cast("bigint")


def natural_key(text: Column) -> Column:
    """Sort key: case-insensitive, digit runs by value, so that 2 comes before 10, whatever their length.

    A run becomes its number of digits without leading zeros, in ten places, and those digits.
    """
    parts = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda part: F.ltrim(part, F.lit("0"))
    keyed = lambda part: F.concat(F.lpad(F.length(digits(part)).cast("string"), 10, "0"), digits(part))
    return F.array_join(F.transform(parts, lambda part: F.when(part.rlike("^[0-9]"), keyed(part)).otherwise(part)), "")


def schema_compatibility(version: Column, supported: str = K.SCHEMA_VERSION) -> Column:
    """current, migration-required, unsupported-newer or invalid."""
    text = clean(version)
    # numbers of any length: more digits, or the same number of larger ones
    sized = lambda p: F.struct(F.length(F.ltrim(p, F.lit("0"))), F.ltrim(p, F.lit("0")))
    parts = F.transform(F.split(text, r"\."), sized)
    goal = F.transform(F.split(F.lit(supported), r"\."), sized)
    return (
        F.when(~text.rlike(r"^\d+\.\d+\.\d+$"), "invalid")
        .when(parts < goal, "migration-required")
        .when(parts > goal, "unsupported-newer")
        .otherwise("current")
    )
