"""Compares a query with its DuckDB SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return x if x is None or isinstance(x, (int, bool, str)) else str(x)


def rows_of(df, columns):
    return sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)


def same_rows(spark, sf_dir, query, sql) -> None:
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    rel = c.sql(sql)
    assert sorted(rel.columns) == columns
    assert rows_of(df, columns) == sorted((tuple(map(plain, r)) for r in rel.select(*columns).fetchall()), key=repr)
