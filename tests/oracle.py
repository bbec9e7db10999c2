"""Spark against DuckDB on the driver's tables: same columns, same rows in any order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def _plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def assert_same(df, sql: str, sf_dir: str = SF) -> None:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    done = con.execute(sql)
    names = [c[0] for c in done.description]
    want, got = done.fetchall(), df.collect()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    at = [names.index(c) for c in order]
    a = sorted(tuple(_plain(r[c]) for c in order) for r in got)
    b = sorted(tuple(_plain(r[i]) for i in at) for r in want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
