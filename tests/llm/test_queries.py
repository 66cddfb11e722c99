"""Registered queries against their SQL twins, and the pipeline stage by stage."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import corpus_pipeline  # noqa: E402
from check import NAMES, rows  # noqa: E402

from aislewise.llm.common import table  # noqa: E402
from aislewise.llm.queries import ORACLES, QUERIES  # noqa: E402
from aislewise.session import stored  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", list(ORACLES))
def test_matches_twin(spark, duck, key):
    df = QUERIES[key](spark, FOLDER)
    result = duck.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, result.fetchall())


def test_every_operator_is_registered():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))


def test_pipeline_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, FOLDER))
        if k < 4:
            assert out.columns == columns
        if k == 1:
            assert out.select("text").distinct().count() == out.count()
        if k == 3:
            copies = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
            assert set(copies.values()) <= {1, 2}
        if k < 3:
            assert out.join(docs, "doc_id", "left_anti").isEmpty()
        sizes.append(out.count())
        docs = out
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    packed = docs.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
    assert packed <= 2048


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
