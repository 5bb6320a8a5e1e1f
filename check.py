"""Compare registered queries with their SQL in DuckDB.

    python check.py [--sf 0.01] [--only name,name] [--module windows]
"""

from __future__ import annotations

import argparse
import time

import duckdb
import numpy as np
import pandas as pd

from panelwright.suite import all_checks
from panelwright.suite import books, definitions, evaluation, learning, tables, windows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == bool or not (pd.api.types.is_numeric_dtype(df[c]) or str(df[c].dtype).startswith("datetime")) or str(df[c].dtype) == "boolean":
            df[c] = df[c].astype(object).where(df[c].notna(), None)
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)[:10] if hasattr(v, "year") else str(v))
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].dt.strftime("%Y-%m-%d")
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def differences(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = canonical(a), canonical(b)
    for c in a.columns:
        x, y = a[c], b[c]
        both_null = x.isna() & y.isna()
        bad = ~(both_null | (x == y))
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} differ in {c}; first:\n{a.loc[i].to_dict()}\n{b.loc[i].to_dict()}"
    return ""


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--module", default="")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    modules = dict(windows=windows, evaluation=evaluation, books=books, definitions=definitions, tables=tables, learning=learning)
    checks = modules[args.module].CHECKS if args.module else all_checks()
    if args.only:
        checks = {k: v for k, v in checks.items() if k in args.only.split(",")}
    spark = session()
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = []
    for name, check in checks.items():
        start = time.time()
        try:
            df = check.run(spark, sf_dir)
            got = df.toPandas()
            spark_s = time.time() - start
            if check.sql is None:
                print(f"rows {name:34s} {len(got):8d} rows {spark_s:6.1f}s", flush=True)
                continue
            start = time.time()
            want = con.execute(check.sql).df()
            bad = differences(got, want)
            if not bad:
                types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {check.sql}").fetchall()}
                names = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
                off = {c: (t, types[c]) for c, t in df.dtypes if t in names and names[t] != types[c]}
                bad = f"types {off}" if off else ""
        except Exception as e:  # noqa: BLE001
            bad = f"{type(e).__name__}: {str(e)[:1500]}"
            spark_s = time.time() - start
            got = []
        if bad:
            failed.append(name)
        print(f"{'FAIL' if bad else 'ok  '} {name:34s} {len(got):8d} rows {spark_s:6.1f}s {time.time() - start:6.1f}s {bad}", flush=True)
    print(f"{len(checks) - len(failed)} of {len(checks)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
