"""Compare registered queries with their SQL in DuckDB: python -m tests.check [sf0.01] [names
or prefixes]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

DATA = Path("/root/testdata")


def connect(sf: str):
    con = duckdb.connect()
    for p in (DATA / sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else str(list(v)) if isinstance(v, (list, np.ndarray)) else v)
            try:
                df[c] = df[c].astype(float)
            except (TypeError, ValueError):
                df[c] = df[c].astype(str)
        elif str(df[c].dtype).startswith("bool"):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def diff(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = norm(got), norm(want)
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}: {(~same).sum()} differ, e.g.\n{a.loc[i].to_dict()}\n{b.loc[i].to_dict()}"
    return None


def main(argv):
    from starfold.catalog import all_queries, all_sql
    from starfold.session import get_spark

    sf = "sf0.01"
    if argv and argv[0].startswith("sf0"):
        sf, argv = argv[0], argv[1:]
    spark = get_spark("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    q, sql = all_queries(), all_sql()
    names = [n for n in q if not argv or any(n == a or n.startswith(a) for a in argv)]
    con, bad = connect(sf), 0
    for n in names:
        t0 = time.time()
        try:
            got = q[n](spark, str(DATA / sf)).toPandas()
            t1 = time.time()
            if n in sql:
                want = con.sql(sql[n]).df()
                d = diff(got, want)
            else:
                want, d = None, None
            t2 = time.time()
        except Exception as e:  # report and go on with the next query
            print(f"FAIL {n}: {type(e).__name__} {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        tag = "ok  " if d is None else "DIFF"
        bad += d is not None
        print(f"{tag} {n}: rows {len(got)} spark {t1-t0:.2f}s duck {t2-t1:.2f}s {'' if n in sql else '(no sql)'} {d or ''}", flush=True)
        if d is None and n not in sql:
            print(got.head(4).to_string(), flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
