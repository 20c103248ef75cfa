"""Hold a Spark query against its SQL in DuckDB: columns by name, rows as a multiset."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26]
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__module__ in ("numpy", "decimal"):
        f = float(x)
        return None if math.isnan(f) else round(f, 7) + 0.0
    return str(x)


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in data)


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    frame = query(spark, sf_dir)
    got = rows(frame.columns, frame.collect())
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    want = rows(names, answer.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return ""
