"""List joins without an equality key and unpartitioned windows in every registered plan."""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from aislewise.plans.registry import queries  # noqa: E402
from aislewise.session import build_session  # noqa: E402

TRAINED = {"forecast_model", "demand_forecast", "nbo_weights", "audience_k", "audience_clusters",
           "health_weights", "ticket_model", "ticket_triage"}


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    for key, build in queries().items():
        if key in TRAINED:
            continue
        plan = build(spark, folder)._jdf.queryExecution().executedPlan().toString()
        loops = len(re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", plan))
        single = len(re.findall(r"Exchange SinglePartition, ENSURE", plan))
        python = len(re.findall(r"Python|InPandas", plan))
        print(f"{key:26s} loops={loops} single={single} python={python} "
              f"scans={plan.count('FileScan')} shuffles={plan.count('Exchange hashpartitioning')}")


if __name__ == "__main__":
    main()
