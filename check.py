"""Compare registered queries with their SQL: python check.py [scale] [name ...]."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

from skein.queries import ORACLES, QUERIES
from skein.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = canonical(got), canonical(want)
    kinds = [c for c in got if got[c].dtype != want[c].dtype]
    if kinds:
        return "types " + ", ".join(f"{c}: {got[c].dtype}/{want[c].dtype}" for c in kinds)
    for c in got:
        a, b = got[c], want[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{(~same).sum()} values of {c}, first {a[i]!r} != {b[i]!r}"
    return None


def main() -> int:
    scale = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/{scale}"
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - started
            if name not in ORACLES:
                print(f"rows  {name} {len(got)} rows {took:.1f}s", flush=True)
                continue
            started = time.time()
            want = con.execute(ORACLES[name]).df()
            diff = differences(got, want)
        except Exception as error:
            took, diff = time.time() - started, str(error)[:1500]
            if not diff:
                traceback.print_exc()
        bad += diff is not None
        tail = f"{len(got)} rows, sql {time.time() - started:.1f}s" if diff is None else diff
        print(f"{'FAIL ' if diff else 'ok   '} {name} {took:.1f}s {tail}", flush=True)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
