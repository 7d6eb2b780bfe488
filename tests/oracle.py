"""Running a query's SQL in DuckDB over the same tables and comparing rows."""

from __future__ import annotations

import math
import os

import duckdb


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        return repr(float(v))
    return str(v)


def same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    found = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    names = list(found.columns)
    want = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in found.fetchall())
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    assert got == want
