"""Comparison of a query with its SQL, row for row, whatever the order."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd


def value(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(value(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(value(x) for x in r)) for r in frame.itertuples(index=False))


def database(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(spark, sf_dir, query, sql):
    ours, theirs = query(spark, sf_dir).toPandas(), database(sf_dir).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
