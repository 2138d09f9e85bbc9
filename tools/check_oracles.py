"""Run registered queries against their oracle SQL in DuckDB.

usage: python tools/check_oracles.py [--sf DIR] [--module NAME] [query ...]
"""

import argparse
import glob
import importlib
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from dayweave.plans import QUERY_MODULES, registry  # noqa: E402
from dayweave.session import local_session  # noqa: E402


def normalise(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(pd.Timestamp(v)))
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT else (str(list(v)) if isinstance(v, (list, np.ndarray)) else (str(pd.Timestamp(v)) if type(v).__name__ in ("date","datetime","Timestamp") else str(v))))
    return df


def sort_rows(df):
    keys = pd.DataFrame({c: df[c].map(lambda v: "" if v is None else (f"{v:.9g}" if isinstance(v, float) else str(v))) for c in df.columns})
    return df.loc[keys.sort_values(list(keys.columns)).index].reset_index(drop=True)


def compare(got, want):
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}"
    got, want = sort_rows(normalise(got)), sort_rows(normalise(want))
    notes = []
    for c in got.columns:
        a, b = got[c], want[c]
        num = pd.api.types.is_numeric_dtype(a) and pd.api.types.is_numeric_dtype(b)
        if num:
            if a.dtype.kind != b.dtype.kind and not (a.isna().any() or b.isna().any()):
                notes.append(f"{c}: type {a.dtype}/{b.dtype}")
            x, y = a.astype(float).to_numpy(), b.astype(float).to_numpy()
            bad = ~((x == y) | (np.isnan(x) & np.isnan(y)))
            if bad.any():
                i = np.flatnonzero(bad)[0]
                close = np.isclose(x, y, rtol=1e-6, atol=1e-6, equal_nan=True).all()
                notes.append(f"{c}: {bad.sum()} {'CLOSE' if close else 'DIFFER'} e.g. {x[i]!r} {y[i]!r} row {dict(got.iloc[i])}")
        else:
            bad = [(p, q) for p, q in zip(a, b) if not (p == q or (pd.isna(p) and pd.isna(q)))]
            if bad:
                notes.append(f"{c}: {len(bad)} DIFFER e.g. {bad[0]}")
    return "; ".join(notes) or "ok"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module", action="append")
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    for m in args.module or QUERY_MODULES:
        importlib.import_module(f"dayweave.plans.{m}")
    spark = local_session("check")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{args.sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    failures = 0
    for name in args.names or list(registry.QUERIES):
        t0 = time.time()
        try:
            df = registry.QUERIES[name](spark, args.sf)
            if args.explain:
                df.explain("formatted")
            got = df.toPandas()
            t1 = time.time()
            sql = registry.ORACLES.get(name)
            if sql is None:
                status, rows = "rows-only", len(got)
            else:
                status, rows = compare(got, con.execute(sql).df()), len(got)
        except Exception as e:  # noqa: BLE001
            t1 = time.time()
            status, rows = "ERROR " + str(e).split("JVM stacktrace")[0][:700], -1
        failures += status not in ("ok", "rows-only")
        print(f"{name:45s} rows={rows:7d} spark={t1-t0:5.1f}s duck={time.time()-t1:5.1f}s {status}", flush=True)
    print("failures:", failures)


main()
