"""Node tables, CASE expressions and fold errors against MLlib; elastic net from sums against its solver."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelfcast.operators.learners import (cross_validate, fit, forest_regressor, gbt_regressor, last_model,
                                          linear_regressor, make_pipeline, param_grid, tree_classifier, tree_regressor)
from shelfcast.operators.linear_sums import elastic_net, fit_linear_sums, moments, predict_linear
from shelfcast.operators.trees import (close, fold_errors, model_check, node_faults, node_importances, node_table,
                                       score_by_nodes, tree_summary, with_leaf)
from shelfcast.operators.vectors import assemble, fit_vector_indexer


@pytest.fixture(scope="module")
def data(spark):
    """Two categorical features (one with gaps and a negative value) and two continuous ones."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        cat, odd = int(rng.integers(0, 4)), float(rng.choice([-1.0, 0.0, 3.0, 7.5]))
        a, b = float(rng.normal()), float(rng.normal() * 100)
        y = [3.0, -2.0, 0.5, 8.0][cat] + (5.0 if odd in (-1.0, 7.5) else 0.0) + 2 * a + (b > 30) + float(rng.normal() * 0.1)
        rows.append((float(cat), odd, a, b, y, i % 3, float(cat % 3)))
    frame = spark.createDataFrame(rows, "cat double, odd double, a double, b double, label double, fold int, cls double")
    indexed = fit_vector_indexer(assemble(frame, ["cat", "odd", "a", "b"]), max_categories=6)
    return indexed.transform(assemble(frame, ["cat", "odd", "a", "b"])).repartition(4).cache()


@pytest.mark.parametrize("learner", [
    lambda: tree_regressor("label", "indexedfeatures", maxDepth=7, seed=1),
    lambda: forest_regressor("label", "indexedfeatures", numTrees=5, maxDepth=8, seed=1),
    lambda: gbt_regressor("label", "indexedfeatures", maxIter=4, seed=1),
    lambda: tree_classifier("cls", "indexedfeatures", seed=1)])
def test_expressions_equal_transform(spark, data, learner):
    model = fit(data, [learner()])
    nodes = node_table(spark, model)
    scored = score_by_nodes(model.transform(data), nodes)
    assert scored.where(~close(F.col("prediction"), F.col("node_prediction"))).count() == 0
    assert nodes.where("categories is not null").count() > 0
    faults = node_faults(nodes).first()
    assert (faults["wrong_trees"], faults["wrong_counts"], faults["wrong_gains"]) == (0, 0, 0)
    told = last_model(model).featureImportances.toArray()
    if not hasattr(last_model(model), "treeWeights") or "Forest" in type(last_model(model)).__name__:
        for r in node_importances(nodes).collect():
            assert r["importance"] == pytest.approx(told[r["feature"]], abs=1e-9)


def test_forest_expressions_give_the_same_double(spark, data):
    model = fit(data, [forest_regressor("label", "indexedfeatures", numTrees=7, seed=2)])
    scored = score_by_nodes(model.transform(data), node_table(spark, model))
    assert scored.where("prediction != node_prediction").count() == 0


def test_leaves_of_one_tree_are_the_means_of_their_rows(spark, data):
    model = fit(data, [tree_regressor("label", "indexedfeatures", maxDepth=4, seed=1)])
    nodes = node_table(spark, model)
    landed = with_leaf(data, nodes).groupBy("leaf").agg(F.count("*").alias("n"), F.avg("label").alias("mean")).collect()
    leaves = {r["node"]: r for r in nodes.where("left_child is null").collect()}
    assert {r["leaf"] for r in landed} == set(leaves)
    for r in landed:
        assert leaves[r["leaf"]]["count"] == r["n"] and leaves[r["leaf"]]["prediction"] == pytest.approx(r["mean"])
    summary = tree_summary(nodes).collect()
    assert [(r["num_nodes"], r["leaves"], r["count"]) for r in summary] == [(2 * len(leaves) - 1, len(leaves), 1500)]


def test_model_check_sees_what_is_wrong(spark, data):
    model = fit(data, [tree_regressor("label", "indexedfeatures", maxDepth=3, seed=1)])
    scored = model.transform(data)
    good = model_check(spark, model, scored, data, exact_leaves=True).first()
    assert good["n_equal"] == good["n_test"] == good["n_train"] == 1500 and good["better"]
    assert sum(good[c] for c in good.asDict() if c.startswith("wrong_")) == 0
    assert good["sum_label"] == pytest.approx(good["sum_prediction"])
    zero = model_check(spark, model, scored.withColumn("prediction", F.lit(0.0)), data, exact_leaves=True).first()
    assert zero["n_equal"] == 0 and not zero["better"]
    other = model_check(spark, model, scored, data.where("a > 0"), exact_leaves=True).first()
    assert other["wrong_leaves"] > 0


def test_stump_without_a_split(spark):
    frame = assemble(spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "x double, label double"), ["x"], "indexedfeatures")
    model = fit(frame, [tree_regressor("label", "indexedfeatures")])
    nodes = node_table(spark, model)
    assert nodes.count() == 1 and node_importances(nodes).count() == 0
    assert [r["node_prediction"] for r in score_by_nodes(frame, nodes).collect()] == [2.0, 2.0]


def test_fold_errors(spark, data):
    forest = forest_regressor("label", "indexedfeatures", numTrees=3, seed=4)
    grid = param_grid(forest, {"maxDepth": [2, 5]})
    base = data.drop("indexedfeatures").withColumnRenamed("features", "raw")
    indexer = fit_vector_indexer(base, "raw", "indexedfeatures", 6)
    model, metrics = cross_validate(base, make_pipeline([indexer, forest]), grid, folds=3, fold_col="fold",
                                    keep_sub_models=True)
    errors = fold_errors(model, base, grid, "fold").collect()
    assert len(errors) == 6 and {r["n"] for r in errors} == {500}
    for r in errors:
        assert r["rmse"] == pytest.approx(r["mllib_rmse"], rel=1e-12)
    for r in metrics.collect():
        assert r["avg_metric"] == pytest.approx(np.mean([e["rmse"] for e in errors if e["grid_point"] == r["grid_point"]]))


def _sample(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4)) * [1, 50, 0.01, 3] + [0, 1000, 5, -2]
    x[:, 3] = x[:, 0] * 2 + rng.normal(size=400) * 0.5
    y = x @ [1.5, 0.02, 30, 0.0] + rng.normal(size=400)
    frame = spark.createDataFrame([(*map(float, r), 7.0, float(t)) for r, t in zip(x, y)],
                                  "a double, b double, c double, d double, flat double, label double")
    return x, y, frame, ["a", "b", "c", "d", "flat"]


def test_elastic_net_from_sums_equals_the_solver(spark):
    x, _, frame, columns = _sample(spark)
    found = fit_linear_sums(frame, columns)
    told = last_model(fit(assemble(frame, columns), [linear_regressor(maxIter=100, tol=1e-12)]))
    assert np.allclose(found.coefficients, told.coefficients, rtol=1e-5, atol=1e-6)
    assert found.intercept == pytest.approx(told.intercept, rel=1e-5)
    own = predict_linear(frame, columns, found).select("prediction").collect()
    wanted = x @ found.coefficients[:4] + 7.0 * found.coefficients[4] + found.intercept
    assert np.allclose([r[0] for r in own], wanted)


@pytest.mark.parametrize("reg, mix", [(0.0, 0.0), (0.5, 1.0), (2.0, 0.0), (0.1, 0.5)])
def test_elastic_net_from_sums_is_optimal(spark, reg, mix):
    """Subgradient of the standardised objective is 0 at the found coefficients, and sweeps never raise it."""
    x, y, frame, columns = _sample(spark)
    found = fit_linear_sums(frame, columns, reg=reg, mix=mix)
    sx, sy = x.std(axis=0, ddof=1), y.std(ddof=1)
    z, t = (x - x.mean(axis=0)) / sx, (y - y.mean()) / sy
    w = found.coefficients[:4] * sx / sy
    slope = z.T @ (z @ w - t) / len(y) + reg * (1 - mix) / sy * w
    l1 = reg * mix / sy
    for j in range(4):
        assert abs(slope[j] + l1 * np.sign(w[j])) < 1e-9 if w[j] else abs(slope[j]) <= l1 + 1e-9
    assert found.coefficients[4] == 0 and found.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ found.coefficients[:4])
    assert all(b <= a + 1e-12 for a, b in zip(found.objective_history, found.objective_history[1:]))


def test_moments_of_few_rows(spark):
    empty = moments(spark.createDataFrame([], "x double, label double"), ["x"])
    assert empty.n == 0 and elastic_net(empty).coefficients.tolist() == [0.0]
    one = fit_linear_sums(spark.createDataFrame([(2.0, 5.0)], "x double, label double"), ["x"])
    assert one.coefficients.tolist() == [0.0] and one.intercept == 5.0
    assert Vectors.dense(one.coefficients) == Vectors.dense([0.0])
