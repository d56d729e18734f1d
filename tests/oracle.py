"""Run a registered query in Spark and its SQL twin in DuckDB and compare them as multisets of rows."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NaT:
        return None
    if isinstance(v, (np.bool_, bool)):
        return bool(v)
    if isinstance(v, (np.integer, int)):
        return int(v)
    if isinstance(v, (np.floating, float)):
        return repr(float(v) + 0.0)
    return str(v)


def bag(pdf: pd.DataFrame) -> Counter:
    pdf = pdf[sorted(pdf.columns)]
    return Counter(tuple(_cell(v) for v in row) for row in pdf.itertuples(index=False, name=None))


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    mine = fn(spark, sf_dir).toPandas()
    spent = time.time() - t
    if sql is None:
        return None, f"{len(mine)} rows (no oracle) {spent:.2f}s"
    theirs = con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return False, f"columns {sorted(mine.columns)} vs {sorted(theirs.columns)}"
    kinds = {
        c: (mine[c].dtype.kind, theirs[c].dtype.kind)
        for c in mine.columns
        if mine[c].dtype.kind != theirs[c].dtype.kind or (mine[c].dtype.kind in "if" and mine[c].dtype != theirs[c].dtype)
    }
    a, b = bag(mine), bag(theirs)
    if a == b and not kinds:
        return True, f"{len(mine)} rows {spent:.2f}s"
    only_a, only_b = list((a - b).items()), list((b - a).items())
    return False, (
        f"rows {len(mine)} vs {len(theirs)}; types {kinds}; differing {len(only_a)}/{len(only_b)}\n"
        f"   spark {str(only_a[:2])[:700]}\n   duck  {str(only_b[:2])[:700]}"
    )


if __name__ == "__main__":
    import __spark_entry__ as E
    from tomewright.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name, fn in E.queries().items():
        if wanted and name not in wanted and fn.__module__.rsplit(".", 1)[-1] not in wanted:
            continue
        try:
            ok, note = compare(spark, con, name, fn, E.oracle_sql().get(name), sf)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += ok is False
        print({True: "ok  ", False: "FAIL", None: "rows"}[ok], name, note, flush=True)
    print("failures:", bad)
