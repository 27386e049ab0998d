"""Runs one registered query on Spark and its SQL on DuckDB and reports the difference."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value + 0.0)
    if value is None:
        return "\0null"
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when schema and values agree, otherwise a short description."""
    got = df.toArrow()
    want = con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} vs {sorted(want.column_names)}"
    types = []
    for name in got.column_names:
        a, b = str(got.schema.field(name).type), str(want.schema.field(name).type)
        a, b = (t.replace("large_", "").replace("string_view", "string") for t in (a, b))
        if a != b:
            types.append(f"{name}: {a} vs {b}")
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} vs {want.num_rows}"
    left = _rows(got.column_names, list(zip(*[c.to_pylist() for c in got.columns])))
    right = _rows(want.column_names, list(zip(*[c.to_pylist() for c in want.columns])))
    bad = [(x, y) for x, y in zip(left, right) if x != y]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first {sorted(got.column_names)}: {bad[0]}; types {types}"
    if got.num_rows == 0:
        return "both empty"
    if types:
        return f"types {types}"
    return None
