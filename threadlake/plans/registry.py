"""Registry of queries over the provided tables, with a DuckDB twin where SQL can state it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from threadlake.plans.adapters import BASE_TABLES, VIEWS
from threadlake.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_PLACEHOLDER = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


@dataclass
class Tables:
    """Provided tables and the adapter views over them, as DataFrames."""

    spark: SparkSession
    sf_dir: str
    _seen: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in BASE_TABLES:
                self._seen[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._seen[name] = self.sql(VIEWS[name][0])
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        used = {name: getattr(self, name) for name in set(_PLACEHOLDER.findall(text))}
        return self.spark.sql(text, **used)


def _duckdb_text(text: str) -> str:
    """Put the adapter views a statement names in front of it as CTEs."""
    ordered: dict[str, str] = {}

    def visit(statement: str) -> None:
        for name in _PLACEHOLDER.findall(statement):
            if name in BASE_TABLES or name in ordered:
                continue
            body = VIEWS[name][1] or VIEWS[name][0]
            visit(body)
            ordered[name] = body

    visit(text)
    identity = {name: name for name in (*BASE_TABLES, *ordered)}
    plain = {name: body.format_map(identity) for name, body in ordered.items()}
    text = text.format_map(identity).strip()
    if not plain:
        return text
    ctes = ",\n".join(f"{name} as ({body})" for name, body in plain.items())
    lowered = text.lower()
    if lowered.startswith("with recursive"):
        return f"with recursive {ctes},\n{text[len('with recursive'):]}"
    if lowered.startswith("with "):
        return f"with {ctes},\n{text[len('with '):]}"
    return f"with {ctes}\n{text}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = _duckdb_text(oracle)
        return fn

    return register
