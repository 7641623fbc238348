"""Order-insensitive comparison of a Spark result with DuckDB's result of the reference statement."""

from __future__ import annotations

import math

import duckdb

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return x.item() if hasattr(x, "item") else x


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in at) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def check(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
