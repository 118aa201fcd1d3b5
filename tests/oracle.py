"""Compares a query's rows with DuckDB's for its SQL."""

import decimal
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, dict, bool)):
        return str(v)
    if v is None or pd.isna(v):
        return "~"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_plain(v) for v in r) for r in df.itertuples(index=False, name=None))


def check(spark, c, query, sql, sf=SF):
    got, want = query(spark, sf).toPandas(), c.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    # Integers may come as floats from one side where a column has nulls.
    same = [tuple(x.removesuffix(".0") for x in r) for r in a] == [tuple(x.removesuffix(".0") for x in r) for r in b]
    assert same, (len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
