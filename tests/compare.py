"""Spark rows against DuckDB rows, columns by name, rows in any order."""

import math

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def value(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(value(y) for y in x)
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return round(float(x), 9) + 0.0
    return str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(value(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def assert_same(got, expected):
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
