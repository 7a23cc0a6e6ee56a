"""Rows of DuckDB SQL over the test tables, and a comparison that ignores order."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def same(df, sql: str, sf_dir: str) -> int:
    """Asserts equal columns and equal rows, whatever their order; returns their number."""
    columns, want = rows_of(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    at = [columns.index(c) for c in order]
    want = [tuple(plain(r[i]) for i in at) for r in want]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g == w
    return len(got)
