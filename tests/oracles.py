"""Side-by-side comparison of a query and its SQL."""

import datetime
import decimal
import glob
import os

import duckdb


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return ("f", round(float(v), 9))
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def same(df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = con.sql(sql)
    names = list(r.columns)
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    ours = sorted(repr([_plain(x[c]) for c in cols]) for x in df.collect())
    theirs = sorted(repr([_plain(dict(zip(names, x, strict=True))[c]) for c in cols]) for x in r.fetchall())
    assert ours == theirs
