"""Rows of a query and of its SQL, made comparable: columns by name, rows in order, numbers as they are."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pandas as pd

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(folder: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    found = con.execute(sql)
    return pd.DataFrame(found.fetchall(), columns=[c[0] for c in found.description], dtype=object)


def _plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list | tuple):
        return tuple(_plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    if x is None or isinstance(x, float) and x != x or x is pd.NA or x is pd.NaT:
        return "null"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float) and abs(x) < 1e15 and x == int(x):
        return int(x)
    return x


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)
