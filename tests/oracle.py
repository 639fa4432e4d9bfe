"""Runs queries of __spark_entry__ against their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def differences(spark, sf_dir: str, name: str, entry=None) -> str:
    """Empty if both sides agree."""
    if entry is None:
        import __spark_entry__ as entry
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    cur = views(sf_dir).execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(plain(r[k]) for k in at) for r in cur.fetchall()]
    got.sort(key=repr), want.sort(key=repr)
    if got == want:
        return ""
    only = lambda a, b: [x for x in a if x not in b][:2]
    return f"rows {len(got)} and {len(want)}; only here {only(got, want)}; only there {only(want, got)}"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from engramlake.runtime import session

    spark = session("8")
    spark.sparkContext.setLogLevel("ERROR")
    for name in [x for x in entry.oracle_sql() if len(sys.argv) < 3 or any(x.startswith(a) for a in sys.argv[2:])]:
        t = time.time()
        try:
            d = differences(spark, sys.argv[1], name, entry)
        except Exception as e:  # noqa: BLE001
            d = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {d or 'same'} ({time.time() - t:.1f} s)", flush=True)
