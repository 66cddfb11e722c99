"""Every registered query with a SQL twin, row for row, on the smallest folder."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import NAMES, rows  # noqa: E402

from aislewise.plans.registry import oracle_sql, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TWINS = oracle_sql()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test data not mounted")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", list(TWINS))
def test_matches_twin(spark, duck, key):
    df = queries()[key](spark, FOLDER)
    result = duck.execute(TWINS[key])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, result.fetchall())


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(queries())
