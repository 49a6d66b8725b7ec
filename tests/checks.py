"""DuckDB as an oracle."""

from __future__ import annotations

import os


def duck(sf: str):
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def same(df, sql: str, sf: str) -> None:
    """The rows of a Spark result against those of DuckDB's."""
    rel = duck(sf).sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
    assert a == b
