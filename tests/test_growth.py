"""What the jobs read, write and train on must not grow faster than their input."""
import pytest
from pyspark.sql import functions as F

from shelfcast import queries
from shelfcast.operators import learners

SMOKE = "/root/testdata/sf0.001"


def _fitted_rows(monkeypatch, spark, name):
    """Rows of each frame that the query ``name`` trains on."""
    seen = []
    fit, validate = queries.fit, queries.cross_validate
    monkeypatch.setattr(queries, "fit", lambda df, stages: seen.append(df.count()) or fit(df, stages))
    monkeypatch.setattr(queries, "cross_validate",
                        lambda df, *args, **named: seen.append(df.count()) or validate(df, *args, **named))
    queries.QUERIES[name](spark, SMOKE)
    return seen


@pytest.mark.parametrize("name, most", [("m8_cross_validate", 4 * 50 * 4), ("m3_gbt_regressor", 4 * 50),
                                        ("m2_forest_regressor", 4 * 50)])
def test_one_feature_fits_take_distinct_rows(monkeypatch, spark, name, most):
    """Four price buckets, fifty amounts (and four folds): equal rows are trained on once, with their number."""
    seen = _fitted_rows(monkeypatch, spark, name)
    assert seen and max(seen) <= most


def test_weighted_rows_teach_what_all_rows_teach(spark):
    df = spark.range(500).select((F.col("id") % 4).cast("double").alias("x"),
                                 (F.col("id") * F.col("id") % 7).cast("double").alias("label"))
    weighted = learners.weighted_rows(df, ["x", "label"])
    assert weighted.count() < 40 and weighted.agg(F.sum("weight")).first()[0] == 500.0
    from shelfcast.operators.vectors import assemble
    every = learners.fit(assemble(df, ["x"]), [learners.tree_regressor()])
    once = learners.fit(assemble(weighted, ["x"]), [learners.tree_regressor(weightCol="weight")])
    values = assemble(df.select("x").distinct(), ["x"])
    told = [{r["x"]: round(r["prediction"], 12) for r in m.transform(values).collect()} for m in (every, once)]
    assert told[0] == told[1]


@pytest.mark.parametrize("name", ["m5_tree_classifier", "m13_classification_metrics"])
def test_class_fits_take_distinct_rows(monkeypatch, spark, name):
    """Four channels, at most nine stock values."""
    seen = _fitted_rows(monkeypatch, spark, name)
    assert seen and max(seen) <= 4 * 9


def _written(monkeypatch, spark, name):
    """Names and rows of what the query ``name`` materializes, apart from small lookups."""
    from shelfcast import session
    from shelfcast.plans import merchant_features, product_features, product_models, stock
    from shelfcast.sources import sinks
    seen, write = [], session.materialize

    def counted(df, label="stage"):
        out = write(df, label)
        seen.append((label, out.count()))
        return out
    for module in (queries, stock, merchant_features, product_features, product_models, sinks):
        monkeypatch.setattr(module, "materialize", counted)
    queries.QUERIES[name](spark, SMOKE).count()
    return seen


@pytest.mark.parametrize("name", ["f2_index_categories", "x5_stock_dataset", "x7_product_dataset"])
def test_stock_tables_write_orders_and_no_fanned_rows(monkeypatch, spark, name):
    from shelfcast.sources.summaries import order_summary
    n = order_summary(spark, SMOKE).count()
    assert [rows for _, rows in _written(monkeypatch, spark, name)] == [n]




@pytest.mark.parametrize("name", ["j1_join_view_stats", "j2_relative_brand"])
def test_lookup_joins_do_not_shuffle_the_orders(spark, name):
    df = queries.QUERIES[name](spark, SMOKE)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert joins and all("rightHint=(strategy=broadcast)" in line for line in joins)


def test_narrowing_keeps_the_greatest_row_of_each_key(spark):
    from shelfcast.sources.sinks import dedupe_latest, narrow_to_greatest
    rows = [(k, None if (k, i) in ((3, 0), (3, 1)) else float(i % 5 if k != 3 else 0), None if k == 4 else i % 7, f"{i:03d}")
            for k in (1, 2, 3, 4, None) for i in range(40)]
    df = spark.createDataFrame(rows, "key int, a double, b int, c string")
    few = narrow_to_greatest(df, ["key"], ["a", "b", "c"])
    assert few.count() <= 5 * 8 < df.count()
    assert sorted(map(str, dedupe_latest(few, ["key"]).collect())) == sorted(map(str, dedupe_latest(df, ["key"]).collect()))


def test_upsert_keeps_one_row_a_key_before_it_is_written(monkeypatch, spark, tmp_path):
    from shelfcast.sources import sinks
    df = spark.range(100).selectExpr("id % 2 AS k", "1 AS year", "id % 3 AS month", "cast(id AS string) AS v")
    sinks.write_features(df, str(tmp_path / "t"), ["k", "year", "month"])
    seen, write = {}, sinks.materialize
    monkeypatch.setattr(sinks, "materialize", lambda d, name: seen.__setitem__(name, d.count()) or write(d, name))
    sinks.write_features(df, str(tmp_path / "t"), ["k", "year", "month"])
    assert seen["upsert-batch"] == 6


@pytest.mark.parametrize("saved, table", [("_x1_saved", "_x1"), ("_x1_monthly_saved", "_x1_monthly"), ("_x2_saved", "_x2")])
def test_saved_tables_get_no_fanned_rows_and_keep_the_same(monkeypatch, spark, saved, table):
    """Rows that an upsert by key cannot keep do not reach the sink; what it keeps is what it keeps of all rows."""
    from shelfcast.sources.summaries import order_summary
    given, write = [], queries.write_features
    monkeypatch.setattr(queries, "write_features", lambda df, root, keys: given.append(df.count()) or write(df, root, keys))
    few = getattr(queries, saved)(spark, SMOKE)
    keys = queries.MERCHANT_ORDER_KEYS if table == "_x2" else queries.PRODUCT_ORDER_KEYS
    whole = getattr(queries, table)(spark, SMOKE)
    every = queries._saved(spark, whole, keys)
    n, fanned = order_summary(spark, SMOKE).count(), whole.count()
    most = 2 * n if table == "_x1_monthly" else n                # a product's greatest brand has several fastsellers
    assert given[0] <= most < fanned == given[1]
    assert few.columns == every.columns and sorted(map(str, few.collect())) == sorted(map(str, every.collect()))


def test_collapse_compares_missing_and_negative_prices_as_the_sink_does(spark, tiny_views):
    from tests.conftest import ORDER_SCHEMA
    from shelfcast.plans.product_features import product_features
    order = lambda pid, price, n: (pid, "S1", "M1", 2016, 8, 35, 29, "x", "web", price, price, price, n, 1, 5)
    orders = spark.createDataFrame([order("P1", None, 1), order("P1", -2000.0, 2), order("P3", None, 3), order("P3", 4.0, 4),
                                    order("P9", -1.0, 5), order(None, None, 6), order(None, float("nan"), 7)], ORDER_SCHEMA)
    keys = queries.PRODUCT_ORDER_KEYS
    few, every = (queries._saved(spark, product_features(orders, tiny_views, collapse=c), keys) for c in (True, False))
    assert few.count() == 4 and sorted(map(str, few.collect())) == sorted(map(str, every.collect()))
