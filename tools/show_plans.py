"""Print the executed (adaptive) physical plan of registered queries.

    python tools/show_plans.py [sf_dir] [name ...]

Executes each query's own DataFrame first (results are discarded), so the
printed plan is the final one AQE settled on (join strategies, coalesced
partitions), and prints a one-line summary of join strategies and
exchanges.  Defaults to sf0.01 because the rows pass through the driver.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfcast.queries import QUERIES  # noqa: E402
from shelfcast.session import get_session, shared_dir  # noqa: E402

DEFAULT = ("x1_product_features", "x2_merchant_features", "a5_weekly_rollup", "f2_index_categories")


def summary(plan: str) -> str:
    plan = plan.split("== Initial Plan ==")[0]       # count the final adaptive plan only
    counts = {k: len(re.findall(k, plan)) for k in
              ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
               "CartesianProduct", "Exchange hashpartitioning", "Exchange rangepartitioning",
               "Exchange SinglePartition", "HashAggregate", "Window")}
    return ", ".join(f"{k}={v}" for k, v in counts.items() if v)


def main(argv: list[str]) -> None:
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")] or list(DEFAULT)
    spark = get_session(master="local[*]", shuffle_partitions=16, extra={"spark.driver.memory": "8g"})
    shared_dir(spark)
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.collect()        # runs this QueryExecution, so AQE finalises its plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"==== {name}: {summary(plan)}")
        print(plan)


if __name__ == "__main__":
    main(sys.argv)
