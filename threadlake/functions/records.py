"""Column functions over schema-on-read records held as VARIANT."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadlake import constants as K


def parse(text: Column | str) -> Column:
    """VARIANT of a JSON text, or null when malformed."""
    return F.try_parse_json(text)


# JSON types by the first word of a VARIANT schema; everything else is a number
_KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean"}


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind_of(value: Column) -> Column:
    """object, array, string, number, boolean or null."""
    word = F.regexp_extract(F.schema_of_variant(value), "^(OBJECT|ARRAY|STRING|BOOLEAN|VOID|[A-Z])", 1)
    names = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair],
                         *[F.lit(x) for first in "BDFIST" for x in (first, "number")])
    return F.try_element_at(names, word)


def child(value: Column, name: str) -> Column:
    """A member as VARIANT; null when missing or JSON null."""
    found = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(~F.is_variant_null(found), found)


ENVELOPES = 4


def fields(value: Column) -> Column:
    """Members of an object as a map; null for anything that is no object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def unwrap(df: DataFrame, record: str = "record", out: str = "r") -> DataFrame:
    """Adds ``r``: the members of a record and of up to four envelopes inside it, inner ones first.

    An envelope is the first of the envelope fields that carries a value; a value
    that is no object ends the chain.
    """
    df = df.withColumn(out, fields(F.col(record)))
    for _ in range(ENVELOPES):
        inner = F.coalesce(*[lookup(out, name) for name in K.ENVELOPE_FIELDS])
        df = df.withColumn("_inner", fields(inner))
        outer = F.map_filter(out, lambda key, _: ~F.map_contains_key("_inner", key))
        df = df.withColumn(out, F.when(F.col("_inner").isNull(), F.col(out)).otherwise(F.map_concat(outer, "_inner"))).drop("_inner")
    return df


def lookup(r: str, name: str) -> Column:
    """A member of an unwrapped record as VARIANT; null when missing or JSON null."""
    return F.expr(f"if(is_variant_null(try_element_at({r}, '{name}')), null, try_element_at({r}, '{name}'))")


def _text(r: str, name: str) -> str:
    return f"try_variant_get(try_element_at({r}, '{name}'), '$', 'string')"


def text(r: str, name: str) -> Column:
    """A member of an unwrapped record as text."""
    return F.expr(_text(r, name))


def as_text(value: Column) -> Column:
    """Scalar VARIANT as text; containers give their JSON."""
    return F.try_variant_get(value, "$", "string")


def first_text(r: str, names: Iterable[str]) -> Column:
    """First string or number that is neither blank nor ``0`` after trimming."""
    def usable(name: str) -> str:
        # only texts that look like a boolean or a container can come from one
        value, saved_as_text = _text(r, name), f"schema_of_variant(try_element_at({r}, '{name}')) = 'STRING'"
        doubtful = rf"{value} rlike '^(true$|false$|[\\[{{])'"
        return f"case when trim({value}) not in ('', '0') and (not {doubtful} or {saved_as_text}) then trim({value}) end"

    return F.expr(f"coalesce({', '.join(usable(name) for name in names)})")


def first_value(r: str, names: Iterable[str]) -> Column:
    """First member that is neither blank text, the number 0 nor false, as text."""
    def usable(name: str) -> str:
        value, saved_as_text = _text(r, name), f"schema_of_variant(try_element_at({r}, '{name}')) = 'STRING'"
        return f"case when {value} <> '' and ({value} not in ('0', 'false') or {saved_as_text}) then {value} end"

    return F.expr(f"coalesce({', '.join(usable(name) for name in names)})")


def record_id(r: str, fallback: Column) -> Column:
    """Identifier of a record, or the fallback (store name and line number)."""
    named = [f"case when trim({_text(r, name)}) <> '' then {_text(r, name)} end" for name in K.RECORD_ID_FIELDS]
    return F.coalesce(F.expr(f"coalesce({', '.join(named)})"), fallback)


def finite_nonneg(*values: Column) -> Column:
    """First finite number of zero or more among texts; blank and non-numeric text is passed over."""
    def usable(value: Column) -> Column:
        number = F.trim(value).try_cast("double")
        return F.when((number >= 0) & (number < float("inf")), number)

    return F.coalesce(*[usable(value) for value in values])


def _child(value: str, name: str) -> str:
    found = f"try_variant_get({value}, '$.{name}', 'variant')"
    return f"if(is_variant_null({found}), null, {found})"


def _flat(value: str, depth: int) -> str:
    """SQL text of :func:`readable_text`; each level names its value once, in a lambda."""
    saved = "try_variant_get({0}, '$', 'string')"
    if depth == 0:
        return f"if(schema_of_variant({value}) = 'STRING', {saved.format(value)}, '')"
    v, i, part = f"v{depth}", f"i{depth}", f"p{depth}"
    member = ", ".join(_child(v, name) for name in ("text", "content", "value", "summary"))
    items = (
        f"coalesce(transform(try_variant_get({v}, '$', 'array<variant>'), "
        f"{i} -> coalesce({_child(i, 'text')}, {_child(i, 'content')}, {i})), array(coalesce({member})))"
    )
    joined = f"array_join(filter(transform({items}, {part} -> {_flat(part, depth - 1)}), t -> t <> ''), '\\n')"
    body = f"if(schema_of_variant({v}) = 'STRING', {saved.format(v)}, {joined})"
    return f"coalesce(get(transform(array({value}), {v} -> {body}), 0), '')"


def _flattened(value) -> str:
    """:func:`readable_text` of a parsed value, however deep it is nested."""
    stack: list = [("open", value)]
    parts: list[list[str]] = [[]]  # texts of the arrays that are open, the outermost first
    while stack:
        step, value = stack.pop()
        if step == "close":
            done = "\n".join(p for p in parts.pop() if p)
            parts[-1].append(done)
        elif isinstance(value, str):
            parts[-1].append(value)
        elif isinstance(value, list):
            parts.append([])
            stack.append(("close", None))
            for item in reversed(value):
                inner = item
                if isinstance(item, dict):
                    inner = next((item[n] for n in ("text", "content") if item.get(n) is not None), item)
                stack.append(("open", inner))
        elif isinstance(value, dict):
            stack.append(("open", next((value[n] for n in ("text", "content", "value", "summary") if value.get(n) is not None), None)))
    return "".join(parts[0])


@F.pandas_udf(StringType())
def _deep_text(saved: pd.Series) -> pd.Series:
    return saved.map(lambda j: None if j is None else _flattened(json.loads(j)))


@F.pandas_udf(StringType())
def _deep_response(saved: pd.Series) -> pd.Series:
    def text(items):
        found = (_flattened(i.get("content")) for i in items if isinstance(i, dict) and i.get("type") == "message")
        return "\n\n".join(t for t in found if t).strip(" ")

    return saved.map(lambda j: None if j is None else text(json.loads(j)))


NATIVE_DEPTH = 4


def _deeper(name: str, depth: int) -> Column:
    """JSON text of values that may be nested deeper than native expressions look; null for all others."""
    saved = F.to_json(F.col(name))
    return F.when(F.length(saved) - F.length(F.translate(saved, "[{", "")) > depth, saved)


def readable_text(name: str) -> Column:
    """Readable text of a VARIANT column: a string, an array of parts or an object, nested to any depth.

    Values with few containers are read by native expressions, the others by a vectorized function.
    """
    return F.coalesce(_deep_text(_deeper(name, NATIVE_DEPTH)), F.expr(_flat(name, NATIVE_DEPTH)))


def response_text(name: str) -> Column:
    """Text of the items of type ``message`` only, joined by a blank line, nested to any depth."""
    messages = f"filter(try_variant_get({name}, '$', 'array<variant>'), m -> try_variant_get(m, '$.type', 'string') = 'message')"
    texts = f"transform({messages}, m -> {_flat(_child('m', 'content'), NATIVE_DEPTH)})"
    native = F.expr(f"trim(array_join(filter({texts}, t -> t <> ''), '\\n\\n'))")
    is_list = F.expr(f"try_variant_get({name}, '$', 'array<variant>') is not null")
    # the list, an item and its content stand above the first value looked at
    return F.coalesce(_deep_response(F.when(is_list, _deeper(name, NATIVE_DEPTH + 2))), native)


def canonical_json(value: Column) -> Column:
    """JSON with recursively sorted keys; VARIANT keeps object keys sorted."""
    return F.to_json(value)


def estimate_bytes(value: Column) -> Column:
    """Serialized size of a record in bytes."""
    return F.octet_length(F.to_json(value)).cast("bigint")
