"""Hold a Spark query against the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import os

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            path = f"{sf_dir}/{f}"
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
