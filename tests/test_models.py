"""Full-feature models (rows-only in the driver check): finite metrics and seed-repeatability."""

import math

import pytest

from shelfcast.plans.demand import monthly_model, weekly_model
from shelfcast.plans.stock import stock_classifier, stock_model
from shelfcast.queries import _x1, _x1_monthly, _x2
from shelfcast.session import materialize

SMOKE = "/root/testdata/sf0.001"


def _metrics(run):
    return run.metrics.first().asDict()


def _same(a, b, rel=1e-9):
    """Equal up to summation order: distributed sums differ in the last bits between runs."""
    return a.keys() == b.keys() and all(
        (x is None and y is None) or (x is not None and y is not None and math.isclose(x, y, rel_tol=rel))
        for x, y in ((a[k], b[k]) for k in a))


def _finite(m):
    return all(v is None or (isinstance(v, (int, float)) and math.isfinite(v)) for v in m.values())


def test_monthly_forest_metrics_finite_and_repeatable(spark):
    po = _x1_monthly(spark, SMOKE)
    first, second = _metrics(monthly_model(po, seed=3)), _metrics(monthly_model(po, seed=3))
    assert first["n"] > 0 and _finite(first)
    assert _same(first, second)
    assert first["nrmse"] is None or first["nrmse"] > 0


def test_stock_tree_uses_categorical_indexes_and_is_repeatable(spark):
    run = stock_model(_x2(spark, SMOKE), seed=3)
    m = _metrics(run)
    assert m["n"] > 0 and _finite(m)
    assert _same(m, _metrics(stock_model(_x2(spark, SMOKE), seed=3)))
    attrs = run.predictions.schema["features"].metadata["ml_attr"]["attrs"]
    assert {a["name"] for a in attrs["nominal"]} == {"channelindexed", "yearindexed", "fastsellerindexed"}


def test_weekly_cross_validated_forest_scores_the_whole_test_part(spark):
    """The forest scores the whole test part, picks a depth of the grid and errs less than the label's spread."""
    run = weekly_model(_x1(spark, SMOKE), seed=3)
    m = _metrics(run)
    label = run.predictions.selectExpr("stddev_pop(label) AS sd", "count(label) AS n").first()
    assert m["n"] == label["n"] > 0 and _finite(m)
    assert 0 < m["rmse"] < 1.5 * label["sd"]
    depths = {p.name: v for p, v in run.model.bestModel.stages[-1].extractParamMap().items()}["maxDepth"]
    assert depths in (4, 8, 10)


def test_weekly_model_does_not_depend_on_the_partitioning(spark):
    """Split and folds are properties of the row key."""
    po = materialize(_x1(spark, SMOKE), "x1")
    first, second = weekly_model(po, seed=3), weekly_model(po.repartition(5, "week"), seed=3)
    keys = ["productid", "sellerid", "year", "month", "week"]
    assert sorted(first.predictions.select(*keys).collect()) == sorted(second.predictions.select(*keys).collect())
    assert all(math.isclose(a, b, rel_tol=0.05) for a, b in zip(first.model.avgMetrics, second.model.avgMetrics))


def test_bins_must_hold_the_categories():
    from shelfcast.operators.learners import check_bins
    check_bins(40, 40)
    with pytest.raises(ValueError):
        check_bins(32, 40)


def test_stock_classifier_on_fourteen_features(spark):
    run = stock_classifier(_x2(spark, SMOKE), seed=3)
    m = _metrics(run)
    assert m["n"] > 0 and 0 <= m["accuracy"] <= 1 and math.isclose(m["accuracy"] + m["test_error"], 1)
    assert run.model.stages[-1].getMaxBins() == 158 and run.model.stages[-1].numFeatures == 14
