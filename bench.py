"""Headline-query timings.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs the headline queries on ``local[$BENCH_CPUS]`` and prints ONE JSON
line: {"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is fully executed through the ``noop`` sink (every row is
computed, nothing is collected to the driver).  A warm-up run on the
smallest scale loads classes first so JVM start-up is not billed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfcast.queries import QUERIES  # noqa: E402
from shelfcast.session import get_session, shared_dir  # noqa: E402

HEADLINE = (
    "x1_product_features",          # X1: feature table (scan, 2 aggregates, 3 joins, index)
    "x2_merchant_features",         # X2: merchant-level feature table
    "a5_weekly_rollup",             # A5: weekly rollup over X1
    "a4_monthly_rollup",            # A4: monthly rollup over the fastseller variant of X1
    "f2_index_categories",          # F2: seven category indexes over X2
    "m2_forest_regressor",          # M2: 20-tree forest fit + scoring
    "x3_weekly_model",              # X3: 3-depth × 4-fold CV forest over the saved table
    "s4_upsert_features",           # S4: two upserts of the feature table and the read-back
    "x4_monthly_model",             # X4: 20-tree forest over the saved monthly table
    "x5_stock_model",               # X5: cleansing, three indexes, decision tree over the saved table
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    shared_dir(spark)
    QUERIES["x1_product_features"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    match = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(match.group(1)) if match else sf_dir,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
