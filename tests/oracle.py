"""A query's rows against its SQL in DuckDB."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def differences(spark, df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.sql(sql)
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    want = Counter(tuple(plain(r[found.columns.index(n)]) for n in names) for r in found.fetchall())
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    return got - want, want - got
