"""Runs a query and its SQL on the same tables and compares the rows."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{at}'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(db, sql):
    r = db.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    return cols, sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
