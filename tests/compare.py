"""Order-insensitive comparison of a Spark result with DuckDB's."""

import datetime
import numbers
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def cell(v):
    if isinstance(v, (list, np.ndarray)):
        return str([cell(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, numbers.Integral):
        return str(int(v))
    if isinstance(v, numbers.Real):
        return str(int(v)) if float(v) == int(v) else f"{float(v):.8g}"
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        return str(pd.Timestamp(v))
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


def same(spark_frame, duck_frame):
    a, b = spark_frame.toPandas(), duck_frame.df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
