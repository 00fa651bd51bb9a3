"""Runs registered queries on Spark and their twins on DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from threadlake.plans.adapters import BASE_TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def typed(value):
    """Value with the name of its type, so that 1, 1.0 and '1' differ."""
    value = plain(value)
    return (type(value).__name__, repr(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(typed(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short text with the difference."""
    df = fn(spark, sf_dir)
    spark_columns, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    duck_columns, duck_rows = rows_of(columns, cursor.fetchall())
    if spark_columns != duck_columns:
        return f"columns {spark_columns} != {duck_columns}"
    if not spark_rows:
        return "no rows"
    if spark_rows != duck_rows:
        left, right = set(spark_rows), set(duck_rows)
        show = lambda rows: [tuple(v for _, v in r) for r in sorted(rows)[:2]]
        return (
            f"rows {len(spark_rows)} vs {len(duck_rows)}; only spark {len(left - right)}: {show(left - right)}; "
            f"only duckdb {len(right - left)}: {show(right - left)}"
        )
    return None


def main() -> None:
    import importlib

    from threadlake.plans.registry import ORACLES, QUERIES
    from threadlake.session import local_session

    modules = sys.argv[1].split(",") if len(sys.argv) > 1 and sys.argv[1] != "all" else None
    sf_dir = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
    pattern = sys.argv[3] if len(sys.argv) > 3 else ""
    if modules is None:
        from threadlake.plans import load_all
        load_all()
    else:
        for module in modules:
            importlib.import_module(f"threadlake.plans.{module}")
    spark = local_session()
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if pattern and not any(p in name for p in pattern.split(",")):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, sf_dir, fn, ORACLES[name])
            else:
                count = len(fn(spark, sf_dir).collect())
                problem = None if count else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        kind = "oracle" if name in ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - start:.2f}s"
              + (f"\n     {problem}" if problem else ""), flush=True)
        bad += problem is not None
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
