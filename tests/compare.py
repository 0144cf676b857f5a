"""Run one catalogue query on Spark and its checking SQL on DuckDB and compare all rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import pathlib

import duckdb

from tablekeep.plans.fixtures import BASE_TABLES


def connect(folder: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        path = pathlib.Path(folder) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, folder, run, sql, con=None):
    con = con or connect(folder)
    frame = run(spark, folder)
    got_cols, got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    cur = con.execute(sql)
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns differ: {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:3]
        lack = [r for r in want if r not in set(got)][:3]
        return f"row counts differ: {len(got)} != {len(want)}\n  only spark {extra}\n  only check {lack}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return (f"{len(bad)} rows differ, columns {got_cols}, first {bad[0]}" if bad else None), len(got)
