"""Comparison of a query with its DuckDB form, as multisets of rows by column name."""

from __future__ import annotations

from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def duck_rows(sql: str, folder: str):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    return sorted(columns), rows_of(columns, cur.fetchall())


def assert_same(df, sql: str, folder: str) -> None:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    columns, want = duck_rows(sql, folder)
    assert sorted(df.columns) == columns
    assert got == want
