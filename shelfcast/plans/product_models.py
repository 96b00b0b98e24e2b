"""Models beside the weekly, monthly and stock jobs: the product-level tree and forest, and a comparison.

    X1's filled rows ─ channel, fastseller and brand index (F2) ─ F3 15 inputs ─ F4 (20) ─ M1 or M2, 42 bins
    weekly dataset ─ F4 ─ one tree, boosted trees and a linear model on one split ─ P13 side by side

The product rows are orders ⟕ view statistics, an order once per view group of its product.  They are never
written or cached: the orders are written un-fanned, with the side of the split they fall on (its keys are the
orders'), the statistics with their indexes.  Labels are counted by sums of products of small counts, the vector
indexer sees every value of every feature on rows that cover both tables, and the tree or forest is
grown by ``joined_trees.fit_joined`` over all rows of the join, made block by block inside the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorIndexerModel
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.fixed import PRODUCT_FEATURES, WEEKLY_KEYS
from shelfcast.functions.columns import MISSING, with_stock_flag
from shelfcast.operators.aggregates import VIEW_SCORE_COLUMNS, view_stats
from shelfcast.operators.clean import STRING_SENTINEL, fill_numeric, fill_string
from shelfcast.operators.indexing import Dictionary, apply_dictionary, dictionary_of, with_nominal
from shelfcast.operators.joined_trees import (Bins, categorical_features, fit_joined, lookup_points, numbered_sets,
                                              order_points, split_points)
from shelfcast.operators.joins import ORDER_KEEP_COLUMNS, join_view_stats, lookup_join
from shelfcast.operators.learners import (check_bins, forest_regressor, gbt_regressor, linear_regressor,
                                          make_pipeline, tree_regressor)
from shelfcast.operators.metrics import regression_metrics
from shelfcast.operators.vectors import assemble, fit_vector_indexer, split, with_split
from shelfcast.plans.demand import WEEKLY_MAX_BINS, WEEKLY_MAX_CATEGORIES, ModelRun, weekly_dataset
from shelfcast.session import broadcast_limit, finer_reads, materialize, measured

PRODUCT_MAX_CATEGORIES = 20
PRODUCT_MAX_BINS = 42
PRODUCT_SPLIT_KEYS = ("productid", "sellerid", "year", "month", "week", "day", "disprice", "finalprice")
PRODUCT_INDEXED = {"channel": "channelindexed", "fastseller": "fastsellerindexed", "brand": "brandindexed"}
# Inputs that come from the orders and from the view statistics.
VIEW_LABELS = ("fastseller", "brand")
VIEW_FEATURES = ("fastsellerindexed", *VIEW_SCORE_COLUMNS, "sellergrade", "numberofviews", "brandindexed")
ORDER_FEATURES = tuple(c for c in PRODUCT_FEATURES if c not in VIEW_FEATURES)
ORDER_VALUES = ("productid", "channel", "disprice", "eventcount", "finalprice", "price", "productcount", "stock")


@dataclass
class ProductTables:
    """The two sides of the product rows: orders with their ``split``, view statistics with their indexes."""
    orders: DataFrame
    stats: DataFrame
    stats_bytes: int
    dictionary: Dictionary
    unmatched: dict[str, float]         # the view inputs of an order whose product was never viewed


def product_tables(orders: DataFrame, views: DataFrame) -> ProductTables:
    """A1, F5 and the fit of F2 for the product rows; the orders are written once."""
    keys = {k: f"_key_{k}" for k in PRODUCT_SPLIT_KEYS}
    keyed = orders.select(*ORDER_KEEP_COLUMNS).withColumns({out: F.col(k) for k, out in keys.items()})
    # The product itself stays as it is until the join; the split sees the filled keys.
    filled = fill_string(fill_numeric(keyed, subset=list(keys.values())), subset=[*keys.values(), "channel"])
    tagged = with_split(filled, list(keys.values()), 0.7)
    orders = materialize(tagged.select(*ORDER_VALUES, "split"), "order-summary")
    stats, stats_bytes = measured(view_stats(views, ("productid", "brand", "fastseller"))
                                  .fillna(STRING_SENTINEL, list(VIEW_LABELS)), "view-stats")

    # Rows of the fanned-out join per label, without making them.
    per_product = orders.groupBy("productid", "channel").agg(F.count(F.lit(1)).alias("_n"))
    groups = lookup_join(per_product, stats.select("productid", *VIEW_LABELS), ["productid"], "left",
                         right_bytes=stats_bytes).fillna(STRING_SENTINEL, list(VIEW_LABELS))
    counts = groups.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in PRODUCT_INDEXED])).alias("p"), "_n")
    dictionary = dictionary_of(counts.groupBy("p.column", "p.label").agg(F.sum("_n").alias("count")))
    dictionary = replace(dictionary, rows=measured(dictionary.rows, "labels")[0])      # read by every pass
    stats, stats_bytes = measured(apply_dictionary(stats, dictionary, {c: PRODUCT_INDEXED[c] for c in VIEW_LABELS}),
                                  "view-stats-indexed")
    known = {PRODUCT_INDEXED[c]: dictionary.index_of(c, STRING_SENTINEL) for c in VIEW_LABELS}
    unmatched = {c: MISSING for c in VIEW_FEATURES} | {c: float(v) for c, v in known.items() if v is not None}
    return ProductTables(orders, stats, stats_bytes, dictionary, unmatched)


def order_values(tables: ProductTables, orders: DataFrame) -> DataFrame:
    """P8, P6 and F2 on the orders alone: their inputs as doubles, and the label."""
    indexed = apply_dictionary(orders, tables.dictionary, {"channel": "channelindexed"})
    filled = with_stock_flag(fill_numeric(indexed, subset=[*ORDER_FEATURES, "productcount"]))
    return filled.withColumns({c: F.col(c).cast("double") for c in ORDER_FEATURES}
                              | {"label": F.col("productcount").cast("double")})


def filled_views(tables: ProductTables, rows: DataFrame) -> DataFrame:
    """P8, P9 on the view inputs, as doubles."""
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in tables.unmatched.items()})


def product_rows(tables: ProductTables, orders: DataFrame, stats: DataFrame) -> DataFrame:
    """The label and the 15 inputs per order row and view group, lazily."""
    joined = join_view_stats(order_values(tables, orders), stats, ("productid", "label", *ORDER_FEATURES), VIEW_FEATURES,
                             stats_bytes=tables.stats_bytes)
    return filled_views(tables, joined)


def product_vectors(tables: ProductTables, rows: DataFrame) -> DataFrame:
    """F3 → P7: (label, 15-input vector); the indexes are nominal."""
    for c, target in PRODUCT_INDEXED.items():
        rows = with_nominal(rows, target, tables.dictionary.n_labels.get(c, 0))
    return assemble(rows, PRODUCT_FEATURES, "features").select("label", "features")


def product_dataset(orders: DataFrame, views: DataFrame) -> DataFrame:
    """F2 → F3 → P7: (units as label, 15-input vector) per order row and view group."""
    tables = product_tables(orders, views)
    return product_vectors(tables, product_rows(tables, tables.orders, tables.stats))


def covering_rows(tables: ProductTables) -> DataFrame:
    """Rows of the join on which every input takes all the values it takes on all of them.

    Every order with one view group of its product, and every view group with one order of its product.
    """
    one = lambda df: df.groupBy("productid").agg(F.min(F.struct(
        *[c for c in df.columns if c != "productid"])).alias("_one")).select("productid", "_one.*")
    return (product_rows(tables, tables.orders, one(tables.stats))
            .unionByName(product_rows(tables, one(tables.orders), tables.stats)))


def fit_product(tables: ProductTables, indexer: VectorIndexerModel, train: DataFrame,
                learner: Estimator) -> DecisionTreeRegressionModel | RandomForestRegressionModel:
    """M1 or M2 on the train part of the product rows, indexed by ``indexer``."""
    spark, at = train.sparkSession, {c: i for i, c in enumerate(PRODUCT_FEATURES)}
    arity = categorical_features(indexer.transform(train).schema[indexer.getOutputCol()].metadata)
    maps = {int(f): {float(v): int(i) for v, i in m.items()} for f, m in dict(indexer.categoryMaps).items()}
    # A row's place in the written table is its own: what is drawn by it is drawn again alike.
    place = F.xxhash64(F.substring_index("_metadata.file_name", "-", 2), F.col("_metadata.row_index"))
    orders = order_values(tables, tables.orders.select("*", place.alias("_place")).where(F.col("split") == "train"))

    continuous = [c for c in PRODUCT_FEATURES if at[c] not in arity]
    fans = tables.stats.groupBy("productid").agg(F.count(F.lit(1)).alias("_fan"))
    fanned = lookup_join(orders.select("productid", *ORDER_FEATURES), fans, ["productid"], "left",
                         right_bytes=tables.stats_bytes).fillna(1, ["_fan"])
    points, weights = order_points(fanned, [c for c in ORDER_FEATURES if c in continuous], "_fan")
    per_product = orders.groupBy("productid").agg(F.count(F.lit(1)).alias("_n"))
    viewed = filled_views(tables, lookup_join(per_product, tables.stats.select("productid", *VIEW_FEATURES), ["productid"],
                                              "left", right_bytes=tables.stats_bytes))
    view_points = lookup_points(viewed, [c for c in VIEW_FEATURES if c in continuous], "_n")
    most = learner.getOrDefault("maxBins") - 1
    bins = [Bins(categories=maps.get(at[c]), arity=arity[at[c]]) if at[c] in arity else
            Bins(split_points(points[c], weights, most) if c in points else
                 split_points(view_points[c], [1.0] * len(view_points[c]), most)) for c in PRODUCT_FEATURES]

    coded = F.array(*[bins[at[c]].column(F.col(c)) for c in VIEW_FEATURES])
    sets = filled_views(tables, tables.stats).groupBy("productid").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct(*VIEW_LABELS, coded.alias("bins")))), lambda r: r["bins"])).alias("_bins"))
    sets, sets_bytes = measured(sets, "view-bins")                    # read by every pass
    nothing = spark.createDataFrame([tuple(tables.unmatched.values())], [*tables.unmatched]).select(
        coded.alias("b")).first()["b"]
    rows, numbered = orders.select("productid", "label", "_place", *ORDER_FEATURES), None
    if sets_bytes <= broadcast_limit(spark):        # orders name their view groups by a number
        known = [(r["productid"], r["_bins"]) for r in sets.where(F.col("productid").isNotNull()).orderBy("productid").collect()]
        numbered = numbered_sets([nothing, *[b for _, b in known]], len(VIEW_FEATURES))
        numbers = spark.createDataFrame([(p, i) for i, (p, _) in enumerate(known, 1)], "productid string, _set int")
        rows = lookup_join(rows, numbers, ["productid"], "left", right_bytes=sets_bytes).fillna(0, ["_set"])
    else:
        rows = lookup_join(rows, sets, ["productid"], "left", right_bytes=sets_bytes)
        rows = rows.withColumn("_bins", F.coalesce("_bins", F.lit(nothing).cast("array<smallint>")))
    return fit_joined(rows, {c: at[c] for c in ORDER_FEATURES}, [at[c] for c in VIEW_FEATURES], bins, learner, numbered)


def product_model(orders: DataFrame, views: DataFrame, forest: bool = False, seed: int = 7) -> ModelRun:
    """The product-level regression: vector indexer (20) and a tree, or a forest, with 42 bins."""
    tables = product_tables(orders, views)
    train, test = (product_vectors(tables, product_rows(tables, tables.orders.where(F.col("split") == part), tables.stats))
                   for part in ("train", "test"))
    check_bins(PRODUCT_MAX_BINS, PRODUCT_MAX_CATEGORIES)
    learner = forest_regressor if forest else tree_regressor
    with finer_reads(orders.sparkSession):
        indexer = fit_vector_indexer(product_vectors(tables, covering_rows(tables)), "features", "indexedfeatures",
                                     PRODUCT_MAX_CATEGORIES)
        fitted = fit_product(tables, indexer, train, learner("label", "indexedfeatures", maxBins=PRODUCT_MAX_BINS, seed=seed))
    model = make_pipeline([indexer, fitted]).fit(train)               # both are fitted: nothing is read here
    predictions = model.transform(test)
    return ModelRun(model, predictions, regression_metrics(predictions, "label"), train)


def weekly_comparison(po: DataFrame, seed: int = 7) -> DataFrame:
    """The test part of the weekly data with the prediction of a tree, boosted trees and a linear model."""
    data = materialize(weekly_dataset(po, keep_keys=True), "weekly-dataset")
    indexer = fit_vector_indexer(data, "features", "indexedfeatures", WEEKLY_MAX_CATEGORIES)
    train, test = split(data, WEEKLY_KEYS, 0.7)
    out = test
    for name, learner in (
            ("pdecisiontree", tree_regressor("label", "indexedfeatures", maxBins=WEEKLY_MAX_BINS, seed=seed)),
            ("pgbt", gbt_regressor("label", "indexedfeatures", maxBins=WEEKLY_MAX_BINS, seed=seed)),
            ("plinear", linear_regressor("label", "features"))):
        scored = make_pipeline([indexer, learner]).fit(train).transform(out)
        out = scored.withColumnRenamed("prediction", name).drop("indexedfeatures")
    return out.drop("features")
