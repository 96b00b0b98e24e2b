"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each reads the driver tables (through the derived summaries) and runs its
each lives in :mod:`shelfcast.oracles` under the same name.  Aggregated
doubles are reported through the cross-engine quantization rule; the
library functions themselves return full precision.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.fixed import (MERCHANT_ORDER_KEYS, MERCHANT_VIEW_KEYS, MERCHANT_VIEW_MEANS, MONTHLY_FEATURES,
                             MONTHLY_KEYS, MONTHLY_MEANS, PRODUCT_FEATURES, PRODUCT_ORDER_CONTRACT,
                             PRODUCT_ORDER_KEYS, STOCK_FEATURES, STOCK_INDEXED, WEEKLY_FEATURES, WEEKLY_KEYS,
                             WEEKLY_MEANS)
from shelfcast.functions.columns import (cast_label, exp_prediction, key_bucket, log_label,
                                         named_prediction, quantize, quantize_columns,
                                         with_relative_price, with_scores, with_stock_flag)
from shelfcast.operators.aggregates import (brand_price_counts, grouped_means, prediction_range, row_count,
                                            view_stats, view_stats_by_merchant)
from shelfcast.operators.clean import fill_numeric, fill_string, replace_blank
from shelfcast.operators.indexing import index_category
from shelfcast.operators.joins import (ORDER_KEEP_COLUMNS, join_null_safe, join_view_stats, join_view_stats_by_merchant,
                                       pair_join_counts, pair_join_rows, with_relative_brand)
from shelfcast.operators.learners import (cross_validate, feature_importances, fit, forest_regressor, gbt_regressor,
                                          last_model, linear_regressor, linear_summary, make_pipeline,
                                          param_grid, score, tree_classifier, tree_regressor, tree_report,
                                          weighted_rows)
from shelfcast.operators.linear_sums import deviations, elastic_net, moments, objective
from shelfcast.operators.metrics import classification_metrics, nrmse, regression_metrics
from shelfcast.operators.rollups import having, having_count, monthly_rollup, weekly_rollup
from shelfcast.operators.trees import (close, fold_errors, model_check, node_importances, node_table,
                                       score_by_nodes)
from shelfcast.operators.vectors import (assemble, fit_vector_indexer, persisted, random_split, split,
                                         vector_category_report, vector_columns, with_split)
from shelfcast.plans.demand import (MONTHLY_MAX_CATEGORIES, WEEKLY_DEPTH_GRID, WEEKLY_MAX_CATEGORIES,
                                    monthly_dataset, monthly_model, weekly_dataset, weekly_model)
from shelfcast.plans.libsvm import libsvm_model
from shelfcast.plans.merchant_features import (ORDER_COLUMNS, VIEW_COLUMNS, merchant_features,
                                               merchant_stats)
from shelfcast.plans.product_features import joined_view_features, product_features
from shelfcast.plans.product_models import product_dataset, product_model, weekly_comparison
from shelfcast.plans.stock import (STOCK_MAX_CATEGORIES, indexed_stock_table, stock_classifier,
                                   stock_dataset, stock_model)
from shelfcast.session import materialize, measured, shared_dir
from shelfcast.sources.catalog import save_table
from shelfcast.sources.sinks import read_features, write_features
from shelfcast.sources.summaries import order_summary, view_summary
from shelfcast.sources.tables import read_libsvm, write_libsvm

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MERCHANT_SUFFIXED_MEANS = tuple(f"{c}1" for c in MERCHANT_VIEW_MEANS)
MERCHANT_ROUND = ("price", "scorefive", "scorefour", "scoreone", "scorethree", "scoretwo")
X1_KEY = ("productid", "year", "month", "week", "day")
NULL_SAFE_MEANS = ("scorefive", "scorefour", "scorethree", "scoretwo", "scoreone", "sellergrade1")
STOCK_CLASS_KEYS = ("productid", "sellerid", "channel", "year", "month", "week", "day")


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


# ---------------------------------------------------------------- shared inputs

def _orders(spark, d):
    return order_summary(spark, d)


def _views(spark, d):
    return view_summary(spark, d)


def _x1(spark, d, collapse=False):
    return product_features(_orders(spark, d), _views(spark, d), collapse=collapse)


def _x1_monthly(spark, d, collapse=False):
    return product_features(_orders(spark, d), _views(spark, d), with_fastseller=True, collapse=collapse)


def _x2(spark, d, reused=False, collapse=False):
    return merchant_features(_orders(spark, d), _views(spark, d), reused=reused, collapse=collapse)


def _saved(spark, df, keys):
    """Save to a new feature table and read it back: keys collapse, as on the jobs' real sink."""
    root = f"{shared_dir(spark).rstrip('/')}/features_{uuid.uuid4().hex}"
    write_features(df, root, keys)
    return read_features(spark, root)


def _x1_saved(spark, d):
    return _saved(spark, _x1(spark, d, collapse=True), PRODUCT_ORDER_KEYS)


def _x1_monthly_saved(spark, d):
    return _saved(spark, _x1_monthly(spark, d, collapse=True), PRODUCT_ORDER_KEYS)


def _x2_saved(spark, d):
    return _saved(spark, _x2(spark, d, collapse=True), MERCHANT_ORDER_KEYS)


def _filled(spark, d):
    return joined_view_features(_orders(spark, d), _views(spark, d))


# ---------------------------------------------------------------- scans, sources, sinks

@query("s1_order_summary")
def s1_order_summary(spark, d):
    return _orders(spark, d)


@query("s1_view_summary")
def s1_view_summary(spark, d):
    return _views(spark, d)


def _named(spark, df, bucket_by):
    """``df`` as a catalog table of a name of its own."""
    return save_table(df, f"features_{uuid.uuid4().hex}", bucket_by)


@query("s1_bucketed_rollup")
def s1_bucketed_rollup(spark, d):
    """A5 over the feature table saved in the catalog, bucketed by product: no exchange."""
    return quantize_columns(weekly_rollup(_named(spark, _x1(spark, d), ["productid"])), WEEKLY_MEANS)


@query("s1_bucketed_join")
def s1_bucketed_join(spark, d):
    """J1 over orders and view statistics saved in the catalog, both bucketed by product: no exchange."""
    orders = _named(spark, _orders(spark, d), ["productid"])
    return join_view_stats(orders, _named(spark, view_stats(_views(spark, d)), ["productid"]))


@query("s2_projected_view_scan")
def s2_projected_view_scan(spark, d):
    return _views(spark, d).select(*VIEW_COLUMNS)


UPSERT_FIRST_BELOW = 70      # key buckets (of 100) that the first batch holds
UPSERT_SECOND_FROM = 40      # and the second, whose stock values are changed
UPSERT_STOCK_CHANGE = 10.0


@query("s4_upsert_features")
def s4_upsert_features(spark, d):
    """Two batches that share some keys, the second with other values: its rows win, others stay."""
    root = f"{shared_dir(spark).rstrip('/')}/product_order_{uuid.uuid4().hex}"
    x1 = materialize(_x1(spark, d).withColumn("_bucket", key_bucket(X1_KEY, 100)), "upsert-source")
    first = x1.where(F.col("_bucket") < UPSERT_FIRST_BELOW).drop("_bucket")
    second = x1.where(F.col("_bucket") >= UPSERT_SECOND_FROM).drop("_bucket")
    write_features(first, root, PRODUCT_ORDER_KEYS)
    write_features(second.withColumn("stock", F.col("stock") + UPSERT_STOCK_CHANGE), root, PRODUCT_ORDER_KEYS)
    return read_features(spark, root).select(*PRODUCT_ORDER_CONTRACT)


# ---------------------------------------------------------------- aggregates, joins, expressions

@query("a1_view_stats")
def a1_view_stats(spark, d):
    return view_stats(_views(spark, d))


@query("j1_join_view_stats")
def j1_join_view_stats(spark, d):
    stats, size = measured(view_stats(_views(spark, d)), "view-stats")
    return join_view_stats(_orders(spark, d), stats, stats_bytes=size)


@query("p8_fill_numeric")
def p8_fill_numeric(spark, d):
    return fill_numeric(j1_join_view_stats(spark, d))


@query("p9_fill_string")
def p9_fill_string(spark, d):
    return fill_string(j1_join_view_stats(spark, d))


@query("f1_index_category")
def f1_index_category(spark, d):
    return index_category(_filled(spark, d), "brand", "brandindexed")


@query("p4_scores")
def p4_scores(spark, d):
    return with_scores(_filled(spark, d))


@query("p5_relative_price")
def p5_relative_price(spark, d):
    return with_relative_price(_filled(spark, d))


@query("p6_stock_flag")
def p6_stock_flag(spark, d):
    return with_stock_flag(_filled(spark, d))


def _feats(spark, d):
    # The orders are written once, un-fanned: the index fit, the counts and the result all stream them.
    filled = joined_view_features(materialize(_orders(spark, d).select(*ORDER_KEEP_COLUMNS), "order-summary"),
                                  _views(spark, d))
    feats = index_category(filled, "brand", "brandindexed").drop("attrs", "channel", "eventcount")
    return with_stock_flag(with_relative_price(with_scores(feats)))


@query("a3_brand_price_counts")
def a3_brand_price_counts(spark, d):
    return brand_price_counts(_feats(spark, d))


@query("j2_relative_brand")
def j2_relative_brand(spark, d):
    feats = _feats(spark, d)
    counts, size = measured(brand_price_counts(feats), "brand-counts")
    return with_relative_brand(feats, counts, counts_bytes=size)


@query("x1_product_features")
def x1_product_features(spark, d):
    return _x1(spark, d)


@query("x1_product_features_monthly")
def x1_product_features_monthly(spark, d):
    return _x1_monthly(spark, d)


@query("a8_row_count")
def a8_row_count(spark, d):
    return row_count(_x1(spark, d))


@query("l1_preview")
def l1_preview(spark, d):
    """Top 20 rows under a total order (the preview is a top-k report)."""
    return _x1(spark, d).orderBy(*[F.col(c).asc_nulls_first() for c in PRODUCT_ORDER_CONTRACT]).limit(20)


# ---------------------------------------------------------------- rollups

@query("a5_weekly_rollup")
def a5_weekly_rollup(spark, d):
    return quantize_columns(weekly_rollup(_x1(spark, d)), WEEKLY_MEANS)


@query("a5_weekly_rollup_saved")
def a5_weekly_rollup_saved(spark, d):
    """X1 → S4 → A5: the rollup as the weekly job runs it, over the saved table."""
    return quantize_columns(weekly_rollup(_x1_saved(spark, d)), WEEKLY_MEANS)


@query("a4_monthly_rollup_saved")
def a4_monthly_rollup_saved(spark, d):
    return quantize_columns(monthly_rollup(_x1_monthly_saved(spark, d)), MONTHLY_MEANS)


@query("p3_having")
def p3_having(spark, d):
    return quantize_columns(having(weekly_rollup(_x1(spark, d))), WEEKLY_MEANS)


@query("p12_having_count")
def p12_having_count(spark, d):
    return having_count(weekly_rollup(_x1(spark, d)), "label < 10")


@query("p7_cast_label")
def p7_cast_label(spark, d):
    weekly = having(weekly_rollup(_x1(spark, d)))
    return cast_label(weekly, "label").select("productid", "sellerid", "year", "month", "week", "label")


@query("p11_log_label")
def p11_log_label(spark, d):
    weekly = having(weekly_rollup(_x1(spark, d)))
    logged = exp_prediction(log_label(weekly), "loglabel", "expprediction")
    return quantize_columns(logged.select("productid", "sellerid", "year", "month", "week", "label",
                                       "loglabel", "expprediction"), ("loglabel", "expprediction"))


@query("a4_monthly_rollup")
def a4_monthly_rollup(spark, d):
    return quantize_columns(monthly_rollup(_x1_monthly(spark, d)), MONTHLY_MEANS)


# ---------------------------------------------------------------- merchant level

@query("a2_view_stats_by_merchant")
def a2_view_stats_by_merchant(spark, d):
    return quantize_columns(view_stats_by_merchant(_views(spark, d)), MERCHANT_SUFFIXED_MEANS)


@query("p2_suffix_columns")
def p2_suffix_columns(spark, d):
    return quantize_columns(merchant_stats(_views(spark, d)), MERCHANT_SUFFIXED_MEANS)


@query("a7_grouped_means")
def a7_grouped_means(spark, d):
    means = grouped_means(_views(spark, d), MERCHANT_VIEW_KEYS, MERCHANT_VIEW_MEANS)
    return means.select(*MERCHANT_VIEW_KEYS, *[quantize(F.col(f"`avg({c})`")).alias(f"avg({c})")
                                               for c in MERCHANT_VIEW_MEANS])


@query("j3_join_view_stats_by_merchant")
def j3_join_view_stats_by_merchant(spark, d):
    joined = join_view_stats_by_merchant(_orders(spark, d).select(*ORDER_COLUMNS),
                                         merchant_stats(_views(spark, d)))
    return quantize_columns(joined, MERCHANT_SUFFIXED_MEANS)


@query("x2_merchant_features")
def x2_merchant_features(spark, d):
    return quantize_columns(_x2(spark, d), MERCHANT_ROUND)


@query("j4_join_null_safe")
def j4_join_null_safe(spark, d):
    """Orders ⟕ view statistics per (merchant, product, day), null keys matching null keys.

    The right side is grouped by the six join keys (a null merchant forms its
    own group), so each order row meets at most one stats row: a null-safe
    lookup instead of every (order, view) pair of a key.
    """
    keys = ("merchantid", "productid", "year", "month", "week", "day")
    stats = view_stats(_views(spark, d), keys, count_col="channel").withColumnRenamed("sellergrade", "sellergrade1")
    stats, size = measured(stats, "day-stats")
    return quantize_columns(join_null_safe(_orders(spark, d), stats, keys, "left", size), NULL_SAFE_MEANS)


@query("j5_pair_join_counts")
def j5_pair_join_counts(spark, d):
    return pair_join_counts(_orders(spark, d), _views(spark, d), ("merchantid", "productid"))


@query("j5_pair_join_rows")
def j5_pair_join_rows(spark, d):
    return pair_join_rows(_orders(spark, d), _views(spark, d), ("merchantid", "productid"))


@query("p10_replace_blank")
def p10_replace_blank(spark, d):
    return quantize_columns(replace_blank(_x2(spark, d)), MERCHANT_ROUND)


@query("f2_index_categories")
def f2_index_categories(spark, d):
    return quantize_columns(indexed_stock_table(_x2(spark, d, reused=True)), MERCHANT_ROUND)


# ---------------------------------------------------------------- datasets (vectors as columns)

def _rounded_vector(df, names, means):
    expanded = vector_columns(df, "features", len(names), keep=("label",))
    return expanded.withColumns({f"f{i:02d}": quantize(f"f{i:02d}") for i, c in enumerate(names) if c in means})


@query("x5_stock_dataset")
def x5_stock_dataset(spark, d):
    return _rounded_vector(stock_dataset(_x2(spark, d, reused=True)), STOCK_FEATURES, MERCHANT_ROUND)


@query("x5_stock_dataset_saved")
def x5_stock_dataset_saved(spark, d):
    """X2 → S4 → X5's dataset: keys collapse on save, then the cleansing and the indexes."""
    return _rounded_vector(stock_dataset(_x2_saved(spark, d)), STOCK_FEATURES, MERCHANT_ROUND)


@query("f3_assemble_weekly")
def f3_assemble_weekly(spark, d):
    return _rounded_vector(weekly_dataset(_x1(spark, d)), WEEKLY_FEATURES, WEEKLY_MEANS)


@query("x4_monthly_dataset")
def x4_monthly_dataset(spark, d):
    return _rounded_vector(monthly_dataset(_x1_monthly(spark, d)), MONTHLY_FEATURES, MONTHLY_MEANS)


@query("f5_split")
def f5_split(spark, d):
    return (with_split(_x1(spark, d), X1_KEY, 0.7)
            .groupBy(*X1_KEY, "split").agg(F.count(F.lit(1)).alias("n")))


@query("f6_split_40_60")
def f6_split_40_60(spark, d):
    return (with_split(_x1(spark, d), X1_KEY, 0.4, seed=11)
            .groupBy(*X1_KEY, "split").agg(F.count(F.lit(1)).alias("n")))


def _random_parts(spark, d, weights, seed):
    """Rows and sums of each part of a seeded random split of the order summary."""
    parts = random_split(_orders(spark, d), weights, seed)
    counted = []
    for i, part in enumerate(parts):
        with persisted(part) as kept:
            rows = kept.agg(F.count(F.lit(1)).alias("n"), F.sum("productcount").alias("units"),
                            F.sum("eventcount").alias("events"), F.max("price").alias("max_price")).first()
        counted.append((i, rows["n"], rows["units"], rows["events"], rows["max_price"]))
    return spark.createDataFrame(counted, "part int, n long, units long, events long, max_price double")


@query("f5_random_split")
def f5_random_split(spark, d):
    return _random_parts(spark, d, (0.7, 0.3), 5)


@query("f6_random_split_40_60")
def f6_random_split_40_60(spark, d):
    return _random_parts(spark, d, (0.4, 0.6), 11)


# ---------------------------------------------------------------- learners on one feature (exact oracles)
#
# With the single feature ``relativeprice`` (4 distinct values) a regression
# tree separates every value, so tree, forest without bootstrap and a GBT
# (whose later trees fit zero residuals) all predict the train mean of the
# label per value — a closed form SQL can check exactly.

ONE_FEATURE_SEED = 7


def _one_feature(spark, d):
    """Model input, written once: fitted on its train part, and its test part scored."""
    x1 = _x1(spark, d).withColumn("label", F.col("productcount").cast("double"))
    data = with_split(x1, X1_KEY, 0.7).select(*X1_KEY, "relativeprice", "label", "split")
    return assemble(materialize(data, "one-feature"), ["relativeprice"], "features")


def _weighted(data, feature, keep=()):
    """Learner input of one feature: its distinct (feature, label) rows with their number, written once."""
    rows = materialize(weighted_rows(data, [feature, "label", *keep]), "weighted-rows")
    return assemble(rows, [feature], "features")


def _fit_train(data, feature, estimator):
    return fit(_weighted(data.where(F.col("split") == "train"), feature), [estimator])


def _fit_one_feature(spark, d, estimator):
    data = _one_feature(spark, d)
    model = _fit_train(data, "relativeprice", estimator)
    pred = model.transform(data.where(F.col("split") == "test"))
    return pred.select(*X1_KEY, "relativeprice", "label", quantize("prediction").alias("prediction"))


def _one_tree(label="label", features="features"):
    return tree_regressor(label, features, seed=ONE_FEATURE_SEED, weightCol="weight")


@query("m1_tree_regressor")
def m1_tree_regressor(spark, d):
    return _fit_one_feature(spark, d, _one_tree())


@query("m2_forest_regressor")
def m2_forest_regressor(spark, d):
    return _fit_one_feature(spark, d, forest_regressor("label", "features", numTrees=20, bootstrap=False,
                                                       seed=ONE_FEATURE_SEED, weightCol="weight"))


@query("m3_gbt_regressor")
def m3_gbt_regressor(spark, d):
    return _fit_one_feature(spark, d, gbt_regressor("label", "features", seed=ONE_FEATURE_SEED, weightCol="weight"))


def _tree_predictions(spark, d):
    data, model = _one_feature_tree(spark, d)
    return model.transform(data.where(F.col("split") == "test"))


@query("m6_pipeline")
def m6_pipeline(spark, d):
    """A fitted vector indexer and a tree as one pipeline."""
    data = _one_feature(spark, d)
    rows = _weighted(data, "relativeprice", ["split"])
    indexer = fit_vector_indexer(rows, "features", "indexedfeatures", MONTHLY_MAX_CATEGORIES)
    model = make_pipeline([indexer, _one_tree(features="indexedfeatures")]).fit(rows.where(F.col("split") == "train"))
    pred = model.transform(data.where(F.col("split") == "test"))
    return pred.select(*X1_KEY, "relativeprice", "label", quantize("prediction").alias("prediction"))


def _one_feature_tree(spark, d):
    data = _one_feature(spark, d)
    return data, _fit_train(data, "relativeprice", _one_tree())


@query("m9_score")
def m9_score(spark, d):
    data, model = _one_feature_tree(spark, d)
    pred = score(model, data.where(F.col("split") == "test"))
    return pred.select(*X1_KEY, "relativeprice", "label", quantize("prediction").alias("prediction"))


@query("m14_tree_report")
def m14_tree_report(spark, d):
    """Depth, nodes and the importance of each feature of the one-feature tree."""
    _, model = _one_feature_tree(spark, d)
    report = spark.createDataFrame(tree_report(model),
                                   "tree_id int, depth int, num_nodes int, weight double, structure string")
    importances = spark.createDataFrame([(0, *row) for row in feature_importances(model)],
                                        "tree_id int, feature int, importance double")
    return report.drop("structure").join(importances, "tree_id")


@query("m10_regression_metrics")
def m10_regression_metrics(spark, d):
    m = regression_metrics(_tree_predictions(spark, d), "label")
    return quantize_columns(m, ("rmse", "mse", "mae", "r2"))


@query("m12_nrmse")
def m12_nrmse(spark, d):
    return quantize_columns(nrmse(_tree_predictions(spark, d), "label"), ("nrmse",))


@query("a6_prediction_range")
def a6_prediction_range(spark, d):
    return quantize_columns(prediction_range(_tree_predictions(spark, d)), ("max_prediction", "min_prediction"))


@query("m4_linear_regression")
def m4_linear_regression(spark, d):
    data = _one_feature(spark, d)
    model = fit(data.where(F.col("split") == "train"), [linear_regressor("label", "features")])
    lr = last_model(model)
    coef = spark.createDataFrame([(float(lr.coefficients[0]), float(lr.intercept))],
                                 "coefficient double, intercept double")
    return quantize_columns(coef, ("coefficient", "intercept"))


@query("m8_cross_validate")
def m8_cross_validate(spark, d):
    x1 = _x1(spark, d).withColumn("label", F.col("productcount").cast("double"))
    folded = x1.withColumn("fold", key_bucket(X1_KEY, 4).cast("int"))
    tree = _one_tree()
    _, metrics = cross_validate(_weighted(folded, "relativeprice", ["fold"]), make_pipeline([tree]),
                                param_grid(tree, {"maxDepth": [4, 8, 10]}), "label", folds=4, fold_col="fold",
                                weight="weight")
    return quantize_columns(metrics, ("avg_metric",))


def _stock_classes(spark, d):
    used = {c: STOCK_INDEXED[c] for c in ("channel", "stock")}
    indexed = indexed_stock_table(_x2(spark, d, reused=True), used).withColumn("label", F.col("stockindexed"))
    data = with_split(indexed, STOCK_CLASS_KEYS, 0.7).select(*STOCK_CLASS_KEYS, "channelindexed", "label", "split")
    return assemble(materialize(data, "classes"), ["channelindexed"], "features")


def _classifier_predictions(spark, d):
    data = _stock_classes(spark, d)
    model = _fit_train(data, "channelindexed", tree_classifier("label", "features", seed=ONE_FEATURE_SEED,
                                                               weightCol="weight"))
    return model.transform(data.where(F.col("split") == "test"))


@query("m5_tree_classifier")
def m5_tree_classifier(spark, d):
    return _classifier_predictions(spark, d).select(*STOCK_CLASS_KEYS, "channelindexed", "label", "prediction")


@query("m13_classification_metrics")
def m13_classification_metrics(spark, d):
    return quantize_columns(classification_metrics(_classifier_predictions(spark, d), "label"),
                            ("accuracy", "test_error"))


@query("f4_index_vector")
def f4_index_vector(spark, d):
    data = weekly_dataset(_x1(spark, d))
    model = fit_vector_indexer(data, "features", "indexedfeatures", WEEKLY_MAX_CATEGORIES)
    return spark.createDataFrame(vector_category_report(model),
                                 "feature int, is_categorical boolean, num_categories int")


def _indexed_values(spark, d, max_categories):
    data = materialize(weekly_dataset(_x1(spark, d)), "weekly")
    model = fit_vector_indexer(data, "features", "indexedfeatures", max_categories)
    out = vector_columns(model.transform(data), "indexedfeatures", len(WEEKLY_FEATURES), keep=("label",))
    return quantize_columns(out, [f"f{i:02d}" for i in range(len(WEEKLY_FEATURES))])


@query("f4_indexed_values_4")
def f4_indexed_values_4(spark, d):
    """The indexed vectors at the stock job's limit: categorical values become ranks, zero first."""
    return _indexed_values(spark, d, STOCK_MAX_CATEGORIES)


@query("f4_indexed_values_20")
def f4_indexed_values_20(spark, d):
    return _indexed_values(spark, d, MONTHLY_MAX_CATEGORIES)


@query("s3_read_libsvm")
def s3_read_libsvm(spark, d):
    """Weekly dataset → LIBSVM text in the shared folder → read back with the LIBSVM source."""
    path = f"{shared_dir(spark).rstrip('/')}/weekly_libsvm_{uuid.uuid4().hex[:8]}"
    write_libsvm(weekly_dataset(_x1(spark, d)), path)
    back = read_libsvm(spark, path, num_features=len(WEEKLY_FEATURES))
    return _rounded_vector(back, WEEKLY_FEATURES, WEEKLY_MEANS)


# ---------------------------------------------------------------- full jobs (errors rows-only, holdout exact)

def _holdout(run):
    """What the job scored: rows of the test part and moments of its label."""
    return run.predictions.agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("sum_label"), F.sum(F.col("label") ** 2).alias("sum_label2"),
        F.min("label").alias("min_label"), F.max("label").alias("max_label"),
        F.count("prediction").alias("n_predicted"))


@query("x3_weekly_model")
def x3_weekly_model(spark, d):
    return weekly_model(_x1_saved(spark, d)).metrics


@query("x3_weekly_holdout")
def x3_weekly_holdout(spark, d):
    return _holdout(weekly_model(_x1_saved(spark, d)))


@query("x4_monthly_model")
def x4_monthly_model(spark, d):
    return monthly_model(_x1_monthly_saved(spark, d)).metrics


@query("x4_monthly_holdout")
def x4_monthly_holdout(spark, d):
    return _holdout(monthly_model(_x1_monthly_saved(spark, d)))


@query("x5_stock_model")
def x5_stock_model(spark, d):
    return stock_model(_x2_saved(spark, d)).metrics


@query("x5_stock_classifier")
def x5_stock_classifier(spark, d):
    return stock_classifier(_x2_saved(spark, d)).metrics


@query("x7_product_dataset")
def x7_product_dataset(spark, d):
    """The 15 inputs of the product-level model."""
    return _rounded_vector(product_dataset(_orders(spark, d), _views(spark, d)), PRODUCT_FEATURES, PRODUCT_FEATURES)


@query("x7_product_tree")
def x7_product_tree(spark, d):
    return product_model(_orders(spark, d), _views(spark, d)).metrics


@query("x7_product_forest")
def x7_product_forest(spark, d):
    return product_model(_orders(spark, d), _views(spark, d), forest=True).metrics


@query("x3_weekly_comparison")
def x3_weekly_comparison(spark, d):
    """Tree, boosted trees and linear model on the same test rows, one column each."""
    return weekly_comparison(_x1_saved(spark, d))


def _monthly_libsvm(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/monthly_libsvm_{uuid.uuid4().hex}"
    write_libsvm(monthly_dataset(_x1_monthly(spark, d)), path)
    return libsvm_model(spark, path, num_features=len(MONTHLY_FEATURES))


@query("x6_libsvm_model")
def x6_libsvm_model(spark, d):
    return _monthly_libsvm(spark, d).metrics


@query("p13_named_prediction")
def p13_named_prediction(spark, d):
    renamed = named_prediction(_tree_predictions(spark, d), "pdecisiontree")
    return quantize_columns(renamed, ("pdecisiontree",))


def _linear(spark, d):
    train = _one_feature(spark, d).where(F.col("split") == "train")
    return fit(train, [linear_regressor("label", "features")])


@query("m4_linear_summary")
def m4_linear_summary(spark, d):
    """Error and r2 of the one-feature linear fit on its training part."""
    s = linear_summary(_linear(spark, d))
    out = spark.createDataFrame([(float(s["rmse"]), float(s["r2"]))], "rmse double, r2 double")
    return quantize_columns(out, ("rmse", "r2"))


@query("m4_linear_residuals")
def m4_linear_residuals(spark, d):
    """Residuals of the training part, counted by value."""
    residuals = linear_summary(_linear(spark, d))["residuals"].select(quantize("residuals").alias("residual"))
    return residuals.groupBy("residual").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- model checks over full vectors (exact oracles)
#
# No SQL can refit a bagged forest, but what a fitted model says can be checked
# row by row: its node rows score like MLlib on every test row, add up, and (one
# tree) give in every leaf the mean label of the training rows that land there.

@query("x3_weekly_check")
def x3_weekly_check(spark, d):
    run = weekly_model(_x1_saved(spark, d))
    return model_check(spark, run.model, run.predictions, run.train)


@query("x4_monthly_check")
def x4_monthly_check(spark, d):
    run = monthly_model(_x1_monthly_saved(spark, d))
    return model_check(spark, run.model, run.predictions, run.train)


def _one_tree_check(check):
    """These splits hash doubles as text, which engines write differently: only both parts together are compared."""
    return check.select((F.col("n_test") + F.col("n_train")).alias("n_rows"),
                        (F.col("n_test") == F.col("n_equal")).alias("all_equal"),
                        close(F.col("sum_label"), F.col("sum_prediction")).alias("same_sum"),
                        *[c for c in check.columns if c.startswith("wrong_") or c == "trees"])


@query("x5_stock_check")
def x5_stock_check(spark, d):
    run = stock_model(_x2_saved(spark, d))
    return _one_tree_check(model_check(spark, run.model, run.predictions, run.model.transform(run.train), "features",
                                       exact_leaves=True))


@query("x6_libsvm_check")
def x6_libsvm_check(spark, d):
    run = _monthly_libsvm(spark, d)
    # The split hashes a vector's text, which no SQL can write: only both parts together are compared.
    checked = model_check(spark, run.model, run.predictions, run.train)
    return (checked.withColumn("all_equal", F.col("n_test") == F.col("n_equal"))
                   .withColumn("n_rows", F.col("n_test") + F.lit(run.train.count())).drop("n_test", "n_equal", "better"))


@query("x7_product_check")
def x7_product_check(spark, d):
    run = product_model(_orders(spark, d), _views(spark, d))
    return _one_tree_check(model_check(spark, run.model, run.predictions, run.model.transform(run.train),
                                       exact_leaves=True))


def _nodes(spark, model):
    """Node rows with the importance of their feature in the whole model."""
    nodes = materialize(node_table(spark, model), "nodes")
    return nodes.join(F.broadcast(node_importances(nodes)), "feature", "left")     # a row per feature


@query("x4_monthly_nodes")
def x4_monthly_nodes(spark, d):
    return _nodes(spark, monthly_model(_x1_monthly_saved(spark, d)).model)


@query("x5_stock_nodes")
def x5_stock_nodes(spark, d):
    return _nodes(spark, stock_model(_x2_saved(spark, d)).model)


@query("x6_libsvm_nodes")
def x6_libsvm_nodes(spark, d):
    return _nodes(spark, _monthly_libsvm(spark, d).model)


@query("m9_score_by_nodes")
def m9_score_by_nodes(spark, d):
    """The one-feature tree as a CASE expression: the same rows as its transform."""
    data, model = _one_feature_tree(spark, d)
    pred = score_by_nodes(data.where(F.col("split") == "test"), node_table(spark, model), "features", "prediction")
    return pred.select(*X1_KEY, "relativeprice", "label", quantize("prediction").alias("prediction"))


@query("m8_weekly_folds")
def m8_weekly_folds(spark, d):
    """Held-out rows of each of the 12 fold fits of the weekly job, whether node rows and MLlib give one error, and
    whether the depth of the refitted model has the least mean error."""
    run = weekly_model(_x1_saved(spark, d), keep_sub_models=True)
    errors = materialize(fold_errors(run.cv, run.train, WEEKLY_DEPTH_GRID, "_fold"), "fold-errors")
    chosen = last_model(run.model).getMaxDepth()
    means = errors.groupBy("grid_point").agg(F.avg("rmse").alias("mean_rmse"))
    least = means.orderBy("mean_rmse", "grid_point").first()["grid_point"]         # one row per depth
    depth = F.lit(list(WEEKLY_DEPTH_GRID))[F.col("grid_point")]
    told = spark.createDataFrame([(i, float(m)) for i, m in enumerate(run.cv.avgMetrics)], "grid_point int, told double")
    return errors.join(F.broadcast(means.join(told, "grid_point")), "grid_point").select(
        "fold", depth.alias("depth"), "n", close(F.col("rmse"), F.col("mllib_rmse")).alias("same_error"),
        close(F.col("mean_rmse"), F.col("told")).alias("same_mean"),
        F.lit(WEEKLY_DEPTH_GRID[least] == chosen).alias("chose_least"))


@query("m4_weekly_linear")
def m4_weekly_linear(spark, d):
    """Elastic net on the weekly job's ten features from the sums of one aggregate: one row per coefficient, with what
    one deviation of the feature adds, and whether the objective is as low as that of the job's own solver."""
    weekly = having(weekly_rollup(_x1(spark, d)))
    data = materialize(cast_label(weekly, "label"), "weekly-linear")
    train, _ = split(data, WEEKLY_KEYS, 0.7)
    sums = moments(train, WEEKLY_FEATURES)
    found = elastic_net(sums)
    told = last_model(fit(assemble(train, WEEKLY_FEATURES, "features"), [linear_regressor("label", "features")]))
    optimal = objective(sums, found.coefficients) <= objective(sums, told.coefficients.toArray()) + 1e-12
    effects = found.coefficients * deviations(sums)[:-1]
    rows = [(i, float(w), float(e), bool(optimal)) for i, (w, e) in enumerate(zip(found.coefficients, effects))]
    rows.append((len(rows), found.intercept, None, bool(optimal)))
    out = spark.createDataFrame(rows, "feature int, coefficient double, effect double, optimal boolean")
    return quantize_columns(out, ("coefficient", "effect"))
