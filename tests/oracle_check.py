"""Run registered queries in Spark and their oracle SQL in DuckDB and compare
row counts, column names and order-insensitive values (local stand-in for the
driver's correctness gate).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

# Exact value comparison (both sides already round doubles to 6 places);
# REVIEWLENS_ORACLE_LOOSE=1 compares rounded values instead.
STRICT = os.environ.get("REVIEWLENS_ORACLE_LOOSE") != "1"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from reviewlens.session import local_session
    spark = local_session()
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or [n for n in qs if not n.startswith("op") and n != "pipeline"]):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sql:
            print(f"rows {name}: {len(srows)} rows ({ts:.1f}s, no oracle)")
            continue
        try:
            res = con.execute(sql[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        def kinds(rows, cols):
            out = {}
            for i, c in enumerate(cols):
                vals = [r[i] for r in rows if r[i] is not None]
                out[c] = type(vals[0]).__name__ if vals else "null"
            return out
        stypes, dtypes = kinds(srows, scols), kinds(drows, dcols)
        ok = sorted(scols) == sorted(dcols) and canon(srows, scols) == canon(drows, dcols)
        if ok and stypes != dtypes:
            print(f"     {name}: python value types differ: spark {stypes} duckdb {dtypes}")
        if ok:
            print(f"ok   {name}: {len(srows)} rows ({ts:.1f}s)")
        else:
            bad += 1
            print(f"FAIL {name}: spark {len(srows)} rows cols {scols} / duckdb {len(drows)} rows cols {dcols}")
            a, b = canon(srows, scols), canon(drows, dcols)
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            for x, y in diff:
                print("   spark :", str(x)[:300])
                print("   duckdb:", str(y)[:300])
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
