"""Run registered queries against their SQL oracles: python tests/compare.py [prefix ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session(cores: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", os.environ.get("SESSION_TZ", "UTC"))
        .getOrCreate()
    )


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pd.api.types.is_datetime64_any_dtype(pdf[c]):
            pdf[c] = pdf[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(pdf[c]):
            pdf[c] = pdf[c].astype(str)
        elif pd.api.types.is_numeric_dtype(pdf[c]):
            pdf[c] = pdf[c].astype(float)
        else:
            pdf[c] = pdf[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v))
    return pdf.sort_values(list(pdf.columns), key=lambda s: s.map(repr) if s.dtype == object else s).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"column {c}: {(~same).sum()} differ, e.g. {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def main(prefixes: list[str]) -> int:
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    from tidemark.operators import series

    # small chunks make every carry and halo cross chunk borders
    series.CHUNK_BARS = int(os.environ.get("CHUNK_BARS", series.CHUNK_BARS))
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in sqls:
                print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            start = time.time()
            problem = differences(got, con.execute(sqls[name]).df())
            note = f"{len(got)} rows spark {took:.1f}s duckdb {time.time() - start:.1f}s"
        except Exception as e:
            problem, note = f"{type(e).__name__}: {str(e)[:1500]}", ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}: {note} {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
