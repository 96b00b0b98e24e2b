"""Trees over a lookup join whose rows are not kept: against MLlib on the joined rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast import queries
from shelfcast.operators import joined_trees
from shelfcast.operators.joined_trees import Bins, best_split, fit_joined, order_points, split_points
from shelfcast.operators.learners import forest_regressor, last_model, tree_regressor
from shelfcast.operators.trees import close, node_faults, node_table
from shelfcast.operators.vectors import assemble
from tests.test_growth import SMOKE, _written

COLUMNS = ("cat", "a", "b", "kind", "c")                              # three of the table, two of its lookup
ARITY = {0: 4, 3: 3}


@pytest.fixture(scope="module")
def sides(spark):
    """(table with its partners' bins, the joined rows as vectors, bins): 0 to 3 partners; without any, one of its own."""
    rng = np.random.default_rng(3)
    partners = {p: [(float(rng.integers(0, 3)), float(rng.integers(0, 9))) for _ in range(p % 4)] for p in range(12)}
    table, joined = [], []
    for i in range(900):
        p, cat, a, b = int(rng.integers(0, 12)), float(rng.integers(0, 4)), float(rng.integers(0, 15)), float(rng.integers(-6, 6))
        y = float([3, 30, 9, 20][int(cat)] + (a > 7) * 5 + p % 3 + rng.normal())
        table.append((i, cat, a, b, y, [v for pair in partners[p] for v in pair] or [0.0, 0.0]))
        joined += [(cat, a, b, *pair, y + 0.0) for pair in partners[p] or [(0.0, 0.0)]]
    frame = spark.createDataFrame(joined, [*COLUMNS, "label"]).repartition(3)
    values = {c: [r[c] for r in frame.select(c).distinct().collect()] for c in COLUMNS}
    bins = [Bins(arity=ARITY[i]) if i in ARITY else Bins(split_points(values[c], [1.0] * len(values[c]), 31))
            for i, c in enumerate(COLUMNS)]
    rows = spark.createDataFrame(table, "id long, cat double, a double, b double, label double, partners array<double>")
    rows = rows.withColumn("_place", F.xxhash64("id")).withColumn("_bins", F.transform("partners", lambda x, i: F.when(
        i % 2 == 0, bins[3].column(x)).otherwise(bins[4].column(x)).cast("smallint"))).drop("partners", "id").repartition(4)
    nominal = {c: {"ml_attr": {"type": "nominal", "num_vals": ARITY[i], "name": c}} for i, c in enumerate(COLUMNS) if i in ARITY}
    for c, meta in nominal.items():
        frame = frame.withColumn(c, F.col(c).alias(c, metadata=meta))
    return rows, assemble(frame, COLUMNS, "indexedfeatures").cache(), bins


def _fit(rows, bins, learner):
    return fit_joined(rows, {"cat": 0, "a": 1, "b": 2}, [3, 4], bins, learner)


@pytest.mark.parametrize("settings", [{}, {"maxDepth": 2}, {"maxDepth": 6, "minInstancesPerNode": 30}, {"maxDepth": 0}])
def test_tree_over_the_join_is_the_tree_of_its_rows(spark, sides, settings):
    rows, joined, bins = sides
    learner = tree_regressor("label", "indexedfeatures", seed=1, **settings)
    found, told = _fit(rows, bins, learner), learner.fit(joined)
    both = found.transform(joined).withColumnRenamed("prediction", "found")
    assert told.transform(both).where(~close(F.col("found"), F.col("prediction"))).count() == 0
    assert (found.depth, found.numNodes) == (told.depth, told.numNodes)
    nodes = [sorted((r["count"], round(r["mass"], 6), round(r["gain"] or 0, 6), round(r["impurity"], 6), round(r["prediction"], 6))
                    for r in node_table(spark, m).collect()) for m in (found, told)]
    assert nodes[0] == nodes[1]
    assert np.allclose(found.featureImportances.toArray(), told.featureImportances.toArray())


def test_forest_draws_each_joined_row_and_repeats_itself(spark, sides, monkeypatch):
    rows, joined, bins = sides
    n = joined.count()
    learner = forest_regressor("label", "indexedfeatures", numTrees=12, seed=5)
    first = _fit(rows, bins, learner)
    counts = [r["count"] for r in node_table(spark, first).where("node = 0").collect()]
    assert len(counts) == 12 and len({*counts}) > 6 and all(abs(c - n) < 5 * n ** 0.5 for c in counts)
    faults = node_faults(node_table(spark, first)).first()
    assert (faults["wrong_trees"], faults["wrong_counts"], faults["wrong_gains"]) == (0, 0, 0)
    roots = node_table(spark, first).where("node = 0").select("feature").distinct().count()
    assert roots > 1                                                  # two of five inputs each
    error = lambda m: m.transform(joined).agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0]
    assert error(first) < 1.5 * error(learner.fit(joined))
    monkeypatch.setattr(joined_trees, "BLOCK_ROWS", 7)
    both = _fit(rows.repartition(2), bins, learner).transform(joined).withColumnRenamed("prediction", "again")
    assert first.transform(both).where(~close(F.col("again"), F.col("prediction"))).count() == 0


def test_forest_of_whole_rows_is_the_tree(sides):
    rows, joined, bins = sides
    forest = forest_regressor("label", "indexedfeatures", numTrees=3, bootstrap=False, featureSubsetStrategy="all", seed=5)
    both = _fit(rows, bins, forest).transform(joined).withColumnRenamed("prediction", "found")
    told = tree_regressor("label", "indexedfeatures", seed=1).fit(joined).transform(both)
    assert told.where(~close(F.col("found"), F.col("prediction"))).count() == 0


def test_poisson_counts():
    table = joined_trees._poisson_table(1.0)
    assert table.mean() == pytest.approx(1.0, abs=1e-3) and table.var() == pytest.approx(1.0, abs=5e-3)
    assert (table == 0).mean() == pytest.approx(np.exp(-1), abs=1e-4)


def test_split_points_and_weighted_quantiles(spark):
    assert split_points([3.0, 1.0, 1.0, 2.0], [1, 1, 1, 1], 5).tolist() == [1.5, 2.5]
    assert split_points([5.0], [1], 5).tolist() == []
    even = split_points(np.arange(1000.0), np.ones(1000), 3)
    assert np.allclose(even, [249.5, 499.5, 749.5], atol=1.5)
    # 300 rows up to 100 with nine partners outweigh 700 above with one.
    df = spark.range(1000).select(F.when(F.col("id") < 300, F.col("id") / 3).otherwise(F.col("id") * 1.0).alias("v"),
                                  F.when(F.col("id") < 300, 9).otherwise(1).alias("fan"))
    points, weights = order_points(df, ["v"], "fan")
    assert sum(weights) == pytest.approx(3400) and split_points(points["v"], weights, 1)[0] == pytest.approx(100 * 1700 / 2700, abs=2)


def test_empty_categories_and_pure_nodes():
    bins = [Bins(arity=4), Bins(np.array([1.0]))]
    f, left = best_split(np.array([[2.0, 0, 3, 0], [5, 0, 0, 0]]), np.array([[8.0, 0, 3, 0], [11, 0, 0, 0]]), [0, 1], bins, 1, 0.0)
    assert f == 0 and left.tolist() == [2]
    pure = np.array([[2.0, 2, 3, 0], [5, 2, 0, 0]])
    assert best_split(pure, pure * 7.3, [0, 1], bins, 1, 0.0) is None


def test_more_categories_than_bins_are_refused(sides):
    rows, _, bins = sides
    with pytest.raises(ValueError, match="categories"):
        _fit(rows, bins[:4] + [Bins(arity=40)], tree_regressor("label", "indexedfeatures"))


@pytest.mark.parametrize("name", ["x7_product_tree", "x7_product_forest", "x7_product_check"])
def test_product_models_write_orders_and_no_fanned_rows(monkeypatch, spark, name):
    from shelfcast.sources.summaries import order_summary
    n = order_summary(spark, SMOKE).count()
    written = _written(monkeypatch, spark, name)
    assert written and max(rows for _, rows in written) == n


def test_product_tables_leave_no_row_out(spark, tiny_orders, tiny_views):
    """Fills, indexes and the split as on the joined rows; the covering rows hold every value of every input."""
    from shelfcast.plans import product_models as pm
    tables = pm.product_tables(tiny_orders, tiny_views)
    whole = pm.product_rows(tables, tables.orders, tables.stats)
    assert whole.count() == 2 * 2 + 1 + 1                             # P1 has two brands; P2 no views, P3 one null brand
    assert whole.where("label = 25").first()["brandindexed"] == whole.where("label = 19").first()["brandindexed"]
    assert whole.where("label = 25").select("price", "sellergrade", "stock").first() == (-999.0, -999.0, 0.0)
    few = pm.covering_rows(tables)
    for c in pm.PRODUCT_FEATURES:
        assert {r[0] for r in few.select(c).collect()} == {r[0] for r in whole.select(c).collect()}
    tagged = {(r["productcount"], r["split"]) for r in tables.orders.collect()}
    from shelfcast.operators.clean import fill_numeric, fill_string
    from shelfcast.operators.vectors import with_split
    filled = with_split(fill_string(fill_numeric(tiny_orders)), pm.PRODUCT_SPLIT_KEYS, 0.7)
    assert tagged == {(r["productcount"], r["split"]) for r in filled.collect()}


@pytest.mark.parametrize("learner", [lambda: tree_regressor("label", "indexedfeatures", seed=1),
                                     lambda: forest_regressor("label", "indexedfeatures", numTrees=6, seed=5)])
def test_partners_by_number_give_the_same_model(spark, sides, learner):
    rows, joined, bins = sides
    known = [list(r[0]) for r in rows.select("_bins").distinct().collect()]
    numbers = spark.createDataFrame([(b, i) for i, b in enumerate(known)], "_bins array<smallint>, _set int")
    named = rows.join(F.broadcast(numbers), "_bins").drop("_bins")
    sets = joined_trees.numbered_sets(known, 2)
    found = fit_joined(named, {"cat": 0, "a": 1, "b": 2}, [3, 4], bins, learner(), sets)
    both = found.transform(joined).withColumnRenamed("prediction", "found")
    assert _fit(rows, bins, learner()).transform(both).where(~close(F.col("found"), F.col("prediction"))).count() == 0


def test_view_statistics_beyond_a_broadcast_give_the_same_model(spark):
    from shelfcast.plans.product_models import product_model
    made = []
    for limit in (str(2 ** 27), "1"):
        spark.conf.set("shelfcast.broadcast.maxBytes", limit)
        try:
            run = product_model(queries._orders(spark, SMOKE), queries._views(spark, SMOKE), forest=True)
            made.append(run.metrics.first().asDict())
        finally:
            spark.conf.unset("shelfcast.broadcast.maxBytes")
    assert made[0]["n"] == made[1]["n"] and made[0]["rmse"] == pytest.approx(made[1]["rmse"], rel=0.02)


def test_finer_reads_are_taken_back(spark):
    from shelfcast.session import finer_reads
    key = "spark.sql.files.minPartitionNum"
    assert spark.conf.get(key, None) is None
    with finer_reads(spark):
        assert int(spark.conf.get(key)) == 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key, None) is None


@pytest.mark.parametrize("limit", [str(2 ** 27), "1"])
def test_views_of_products_that_were_never_ordered_do_not_matter(spark, limit):
    """Their values are in no row of the join, so the indexer does not know them."""
    from shelfcast.plans.product_models import product_model
    orders = queries._orders(spark, SMOKE).where("productid IN ('P1', 'P2', 'P3')")
    views = queries._views(spark, SMOKE)
    spark.conf.set("shelfcast.broadcast.maxBytes", limit)
    try:
        every, few = (product_model(orders, v).metrics.first().asDict()
                      for v in (views, views.where("productid IN ('P1', 'P2', 'P3')")))
    finally:
        spark.conf.unset("shelfcast.broadcast.maxBytes")
    assert every["n"] > 0 and every["n"] == few["n"] and every["rmse"] == pytest.approx(few["rmse"])
