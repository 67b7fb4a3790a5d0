"""Run a query and its SQL and compare the rows, whatever their order."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def table_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same_rows(spark, sf, query, sql):
    df = query(spark, sf)
    ours = table_of(df.columns, df.collect())
    result = connect(sf).execute(sql)
    names = [d[0] for d in result.description]
    theirs = table_of(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(ours) == len(theirs)
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not different, different[:3]
    assert [type(v) for v in ours[0]] == [type(v) for v in theirs[0]] if ours else True
