"""Run queries and their SQL side by side: python tests/compare.py [sf_dir] [name ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _kind(dtype) -> str:
    text = str(dtype)
    if text.startswith("datetime64"):
        return "datetime"
    return "text" if text in ("object", "str", "string") else text


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime64"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype.kind == "f":
            df[c] = df[c].map(lambda v: "null" if pd.isna(v) else repr(float(v) + 0.0))
        else:
            df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs between two results, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    kinds = {c: (_kind(got[c].dtype), _kind(want[c].dtype)) for c in got.columns if _kind(got[c].dtype) != _kind(want[c].dtype)}
    a, b = _plain(got), _plain(want)
    bad = (a != b).any(axis=1)
    if bad.any():
        at = bad.idxmax()
        cols = [c for c in a.columns if a[c][at] != b[c][at]]
        return f"{bad.sum()} rows differ, first {[(c, a[c][at][:200], b[c][at][:200]) for c in cols]} in {a.loc[at].to_dict()!s:.300}"
    return f"types {kinds}" if kinds else None


def main() -> int:
    import __spark_entry__ as entry
    from moodquarry.plans.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args[1:] or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
            took = time.time() - start
            if name in oracle:
                found = differences(got, con.execute(oracle[name]).df())
            else:
                found = None if len(got) else "no rows"
            tag = "SQL " if name in oracle else "rows"
            print(f"{'ok  ' if found is None else 'FAIL'} {tag} {name} {len(got)} rows {took:.2f}s {found or ''}", flush=True)
            failed += found is not None
        except Exception as e:  # report and go on
            failed += 1
            print(f"ERROR {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
