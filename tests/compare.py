"""Spark rows against DuckDB rows."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, float):
        return round(v, 9)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    got = con.sql(sql)
    return got.columns, got.fetchall()


def same(df, sql, sf_dir):
    columns, want = duck(sql, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(want, columns)
