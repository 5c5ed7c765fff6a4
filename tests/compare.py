"""Spark result against DuckDB result, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_names, want = rows_of(names, cursor.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want_names != got_names:
        return f"columns {got_names} instead of {want_names}"
    if want != got:
        extra, missing = got - want, want - got
        return (
            f"{sum(got.values())} rows instead of {sum(want.values())};"
            f" {sum(extra.values())} extra, e.g. {list(extra)[:2]};"
            f" {sum(missing.values())} missing, e.g. {list(missing)[:2]}"
        )
    types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for field in df.schema.fields:
        expected = kinds.get(field.dataType.simpleString())
        if expected and types[field.name] != expected:
            return f"type of {field.name}: {field.dataType.simpleString()} against {types[field.name]}"
    return None


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
