"""Comparison of a query with its SQL in DuckDB over the same tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(x):
    return f"{x:.5f}" if isinstance(x, float) else str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, name: str, query, sql: str, sf_dir: str, con=None) -> None:
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    got = (con or connect(sf_dir)).execute(sql)
    columns = [d[0] for d in got.description]
    theirs = rows_of(columns, got.fetchall())
    assert sorted(df.columns) == sorted(columns), (name, df.columns, columns)
    assert len(mine) == len(theirs), (name, len(mine), len(theirs), mine[:3], theirs[:3])
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not wrong, (name, len(wrong), wrong[:4])
