"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import json
import os

import duckdb


def _plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    return x


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted(json.dumps([_plain(r[c]) for c in cols], default=str) for r in df.collect())
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(json.dumps([_plain(r[i]) for i in at], default=str) for r in cur.fetchall())
    assert ours == theirs
