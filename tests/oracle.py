"""Spark beside DuckDB on the same tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb

DATA = os.environ.get("KINWEAVE_TESTDATA", "/root/testdata/sf0.001")


def views(directory=DATA):
    c = duckdb.connect()
    for p in glob.glob(f"{directory}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return str(v)


def agree(spark, query, sql, directory=DATA):
    df = query(spark, directory)
    cols = sorted(df.columns)
    cur = views(directory).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    assert got == want
