"""Plan shape checks and the driver contract (entry, queries, oracles at sf0.001)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from shelfcast.oracles import ORACLES
from shelfcast.queries import QUERIES

SMOKE = "/root/testdata/sf0.001"
TABLES = ("lineitem", "orders", "events")
SLOW = {"x3_weekly_holdout", "x4_monthly_holdout", "m8_cross_validate", "m8_weekly_folds", "x3_weekly_check",
        "x4_monthly_check", "x6_libsvm_check", "x7_product_check"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs_with_stable_schema(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == entry.entry(spark).columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_feature_plan_has_no_cartesian_or_nested_loop_join(spark):
    plan = _plan(QUERIES["x1_product_features"](spark, SMOKE))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_view_scan_is_pruned_and_filters_pushed(spark):
    from shelfcast.sources.summaries import view_summary
    df = view_summary(spark, SMOKE).select("productid", "scorefive").where("productid = 'P3'")
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<event_id:bigint,props:string>" in formatted


def _norm(v):
    if isinstance(v, float):
        return repr(v + 0.0) if not math.isnan(v) else "nan"
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMOKE, t)}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SLOW))
def test_query_matches_oracle_at_smoke_scale(spark, duck, name):
    df = entry.queries()[name](spark, SMOKE)
    res = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    order = sorted(df.columns)
    ours = sorted(tuple(_norm(r[c]) for c in order) for r in df.collect())
    idx = [ocols.index(c) for c in order]
    theirs = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert ours == theirs


def test_event_props_parsed_once_per_row(spark):
    from shelfcast.operators.aggregates import view_stats
    from shelfcast.sources.summaries import view_summary
    df = view_stats(view_summary(spark, SMOKE))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("get_json_object") == 1


def test_null_safe_join_meets_data():
    """J4's oracle is green only because rows match, null merchants among them (view days lie on the order calendar)."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    matched, null_keys = con.execute(
        "SELECT count(numberofviews), count(numberofviews) FILTER (merchantid IS NULL) FROM ("
        + ORACLES["j4_join_null_safe"] + ")").fetchone()
    assert matched > 0 and null_keys > 0


def test_every_blank_rule_meets_data():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMOKE, t)}.parquet')")
    row = con.execute("SELECT " + ", ".join(f"count(*) FILTER ({c} = '')" for c in (
        "channel", "attrs", "productid", "sellerid")) + " FROM (" + ORACLES["s1_order_summary"] + ")").fetchone()
    views = con.execute("SELECT count(*) FILTER (brand = ''), count(*) FILTER (fastseller = '') FROM ("
                        + ORACLES["s1_view_summary"] + ")").fetchone()
    assert min(row) > 0 and min(views) > 0
