"""Rows of a Spark query beside those of its SQL in DuckDB, as comparable tuples."""

import math
import os

import numpy as np


def plain(v):
    if v is None:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return float(v) if type(v).__name__ == "Decimal" else v


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(sql, folder):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    columns = sorted(names)
    at = [names.index(x) for x in columns]
    return columns, sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
