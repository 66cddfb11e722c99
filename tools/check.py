"""Compare registered queries with their SQL twins: python tools/check.py [folder] [key ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from aislewise.plans.registry import oracle_sql, queries  # noqa: E402
from aislewise.session import build_session  # noqa: E402

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings "
         "pages benchmark labels conversations").split()


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return repr(float(v))
    try:
        return repr(float(v)) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    q, o = queries(), oracle_sql()
    keys = sys.argv[2:] or list(q)
    import importlib
    keys = [k for arg in keys for k in (
        importlib.import_module(f"aislewise.plans.{arg[1:]}").QUERIES if arg.startswith("@")
        else [arg])]
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    bad = []
    for k in keys:
        t0 = time.time()
        try:
            df = q[k](spark, folder)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time() - t0
            if k not in o:
                print(f"{k:28s} rows={len(got):6d} {t1:6.2f}s  (no twin)", flush=True)
                if not got:
                    bad.append(k)
                continue
            res = con.execute(o[k])
            names = [d[0] for d in res.description]
            want = res.fetchall()
            a, b = rows(df.columns, got), rows(names, want)
            ok = sorted(df.columns) == sorted(names) and a == b
            print(f"{k:28s} rows={len(got):6d}/{len(want):6d} {t1:6.2f}s  {'ok' if ok else 'DIFF'}",
                  flush=True)
            if not ok:
                bad.append(k)
                print("   columns", sorted(df.columns), sorted(names)) if sorted(
                    df.columns) != sorted(names) else None
                onlya, onlyb = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
                print("   spark", len(onlya), onlya[:3])
                print("   duck ", len(onlyb), onlyb[:3])
        except Exception as e:  # report and go on to the next key
            bad.append(k)
            print(f"{k:28s} ERROR {type(e).__name__}: {str(e)[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
