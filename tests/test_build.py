"""The whole batch build on a few raw rows per table."""

import random
import re

from pyspark.sql import types as T

from aislewise.operators import features as X
from aislewise.plans.build import KEYS, build
from aislewise.sources import tables as S
from aislewise.sources.schemas import SCHEMAS

KNOWN = {"customer_id": ["C1", "C2", "C3"], "product_id": ["P1", "P2"], "channel": ["Online"],
         "status": ["Active", "Abandoned", "Resolved"], "sentiment_label": ["Positive"],
         "store_id": ["S1"], "warehouse_id": ["W1"], "supplier_id": ["U1"]}


def raw_rows(name, schema, rng):
    rows = []
    for i in range(12):
        row = {}
        for field in schema:
            kind = field.dataType
            if field.name == KEYS.get(name, ""):
                value = KNOWN.get(field.name, [f"{name}{j}" for j in range(8)])
                row[field.name] = value[i % len(value)]
            elif field.name in KNOWN:
                row[field.name] = rng.choice(KNOWN[field.name])
            elif isinstance(kind, (T.DateType, T.TimestampType)):
                row[field.name] = rng.choice(["2024-01-01", f"2024-02-{10 + i}", "never"])
            elif isinstance(kind, T.BooleanType):
                row[field.name] = rng.choice([True, False, None])
            elif isinstance(kind, T.StringType):
                row[field.name] = f"{field.name}{i % 3}"
            else:
                row[field.name] = rng.choice(["1", "7", "n/a", None])
        rows.append(row)
    return rows


def test_build_writes_every_table(spark, tmp_path):
    rng, raw, out = random.Random(5), str(tmp_path / "raw"), str(tmp_path / "out")
    for name, schema in SCHEMAS.items():
        text = T.StructType([T.StructField(f.name, T.BooleanType() if isinstance(
            f.dataType, T.BooleanType) else T.StringType()) for f in schema])
        S.save(spark.createDataFrame(raw_rows(name, schema, rng), text), raw, name)
    names = build(spark, raw, out)
    assert len(names) == 31
    counts = {r["table_name"]: r["rows"] for r in S.table_summary(
        {n: S.load(spark, out, n) for n in names}).collect()}
    assert counts["customers"] == 3 and counts["feature_customers"] == 3
    assert counts["products"] == counts["feature_products"] == 2
    assert counts["transactions"] <= 8
    assert counts["feature_inventory_health"] == counts["inventory"]
    demand = X.recent_demand(S.load(spark, out, "transactions"))
    plan = demand._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*sales_year", plan)
    plain = X.recent_demand(S.load(spark, out, "transactions").drop("sales_year"))
    assert sorted(demand.collect()) == sorted(plain.collect())
    again = build(spark, raw, out)  # a second build replaces the first
    assert again == names
    assert S.load(spark, out, "customers").count() == 3
