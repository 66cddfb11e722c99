"""List columns whose kind of type differs between a query and its SQL twin."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import duckdb  # noqa: E402
from check import NAMES  # noqa: E402

from aislewise.plans.registry import oracle_sql, queries  # noqa: E402
from aislewise.session import build_session  # noqa: E402

KINDS = {"bigint": "int", "int": "int", "double": "float", "string": "text", "BIGINT": "int",
         "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "text"}


def main():
    folder = "/root/testdata/sf0.001"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    q = queries()
    for key, text in oracle_sql().items():
        ours = {f.name: f.dataType.simpleString() for f in q[key](spark, folder).schema}
        theirs = {r[0]: r[1] for r in con.execute(f"DESCRIBE {text}").fetchall()}
        for c, kind in ours.items():
            other = theirs.get(c, "missing")
            if KINDS.get(kind, kind) != KINDS.get(other, other):
                print(key, c, kind, other)


if __name__ == "__main__":
    main()
