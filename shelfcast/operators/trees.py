"""Learned trees as rows (M14) and as built-in expressions (M9).

``node_table`` turns a fitted tree or ensemble into a DataFrame with one row
per node, taken from what MLlib itself saves.  From these rows come

* ``tree_summary`` and ``node_importances`` — depth, nodes, leaves and the
  importance of every feature, as aggregates;
* ``score_by_nodes`` — the model as nested CASE expressions, one column per
  tree: scoring without MLlib and without Python, equal to ``transform``;
* ``node_faults`` — what must hold of any learned tree, counted where it does not.

The rows of a model are bounded by trees × 2^(depth + 1), so reading them on
the driver to compile the expressions is safe; the data is never collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.learners import last_model
from shelfcast.session import materialize, shared_dir

NODE_COLUMNS = ("tree", "weight", "node", "feature", "threshold", "categories", "left_child", "right_child", "gain",
                "impurity", "mass", "count", "prediction")
# Relative difference up to which two doubles count as equal (summation order).
CLOSE = 1e-9


def node_table(spark: SparkSession, model) -> DataFrame:
    """One row per node: ``feature``, ``threshold`` or left ``categories`` are null at leaves.

    ``weight`` is the tree's share of a prediction: 1 / trees in a forest, the
    tree's weight in a boosted model.  ``count`` are rows, ``mass`` their weights (a
    bootstrap counts a row several times).
    """
    m = last_model(model)
    path = f"{shared_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    m.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        n_trees = len(m.trees)
        boosted = list(m.treeWeights) if type(m).__name__.startswith("GBT") else [1.0 / n_trees] * n_trees
        weights = F.lit([float(w) for w in boosted]).cast("array<double>")
        nodes = saved.select(F.col("treeID").alias("tree"), weights[F.col("treeID")].alias("weight"), "nodeData.*")
    else:
        nodes = saved.select(F.lit(0).alias("tree"), F.lit(1.0).alias("weight"), "*")
    inner = F.col("leftChild") >= 0
    # From the saved sums: leaves that were closed at their parent's split carry no impurity of their own.
    stats = F.col("impurityStats")
    if hasattr(m, "numClasses"):
        mass = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        impurity = 1.0 - F.aggregate(stats, F.lit(0.0), lambda a, x: a + x * x) / (mass * mass)
    else:
        mass = stats[0]
        impurity = (stats[2] - stats[1] * stats[1] / mass) / mass
    categorical = inner & (F.col("split.numCategories") >= 0)
    return nodes.select(
        "tree", "weight", F.col("id").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner & ~categorical, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(categorical, F.col("split.leftCategoriesOrThreshold")).alias("categories"),
        F.when(inner, F.col("leftChild")).alias("left_child"), F.when(inner, F.col("rightChild")).alias("right_child"),
        F.when(inner, F.col("gain")).alias("gain"),
        F.greatest(impurity, F.lit(0.0)).alias("impurity"), mass.alias("mass"), F.col("rawCount").alias("count"), "prediction")


def _levels(nodes: DataFrame) -> dict[tuple[int, int], dict]:
    """The nodes by (tree, node): bounded by the model's size."""
    return {(r["tree"], r["node"]): r.asDict() for r in nodes.select(*NODE_COLUMNS).collect()}


def _double(x: float) -> str:
    return f"({float(x)!r}D)"


def tree_sql(nodes: dict[tuple[int, int], dict], tree: int, features: str, value: str = "prediction", at: int = 0) -> str:
    """CASE expression of one tree over the array column ``features``; ``value``: what a leaf gives."""
    n = nodes[tree, at]
    if n["left_child"] is None:
        return _double(n["prediction"]) if value == "prediction" else str(n[value])
    x = f"get({features}, {n['feature']})"
    goes_left = (f"{x} <= {_double(n['threshold'])}" if n["categories"] is None
                 else f"{x} IN ({', '.join(map(_double, n['categories']))})" if n["categories"] else "false")
    left = tree_sql(nodes, tree, features, value, n["left_child"])
    right = tree_sql(nodes, tree, features, value, n["right_child"])
    return f"CASE WHEN {goes_left} THEN {left} ELSE {right} END"


def score_by_nodes(df: DataFrame, nodes: DataFrame, features: str = "indexedfeatures", out: str = "node_prediction") -> DataFrame:
    """Add ``out``: the model's prediction from its node rows, by built-in expressions only.

    A forest's trees are summed in order and divided, as MLlib does, so the
    result is the same double; a boosted model is the weighted sum.
    """
    known = _levels(nodes)
    trees = sorted({t for t, _ in known})
    weights = [next(n["weight"] for (t, _), n in known.items() if t == tree) for tree in trees]
    values = [tree_sql(known, t, "x") for t in trees]
    if len({*weights}) == 1 and abs(weights[0] * len(trees) - 1.0) < 1e-12:
        total = f"({' + '.join(['0.0D', *values])}) / {_double(len(trees))}"
    else:
        total = " + ".join(["0.0D", *[f"{v} * {_double(w)}" for v, w in zip(values, weights)]])
    # Inside a lambda the trees are evaluated as they stand: as generated code a forest outgrows a method.
    return _scored(df, features, total, out)


def _scored(df: DataFrame, features: str, value: str, out: str) -> DataFrame:
    """Add ``out``: SQL ``value`` over ``x``, the array of ``features``."""
    return (df.withColumn("_features", vector_to_array(F.col(features)))
              .withColumn(out, F.expr(f"transform(array(_features), x -> {value})[0]")).drop("_features"))


def with_leaf(df: DataFrame, nodes: DataFrame, features: str = "indexedfeatures", tree: int = 0, out: str = "leaf") -> DataFrame:
    """Add ``out``: the node at which a row ends in ``tree``."""
    known = _levels(nodes.where(F.col("tree") == tree))
    return _scored(df, features, tree_sql(known, tree, "x", "node"), out)


def tree_summary(nodes: DataFrame) -> DataFrame:
    """(tree, num_nodes, leaves, count of the root)."""
    return nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("num_nodes"), F.count(F.when(F.col("left_child").isNull(), 1)).alias("leaves"),
        F.max(F.when(F.col("node") == 0, F.col("count"))).alias("count"))


def node_importances(nodes: DataFrame) -> DataFrame:
    """(feature, importance): gain times mass per feature, shared to 1 within each tree, then over all trees."""
    gains = nodes.where(F.col("feature").isNotNull()).groupBy("tree", "feature").agg(
        F.sum(F.col("gain") * F.col("mass")).alias("g"))
    totals = gains.groupBy("tree").agg(F.sum("g").alias("_tree_g"))
    shares = gains.join(totals, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("_tree_g")).alias("share"))
    whole = shares.agg(F.sum("share")).first()[0] or 1.0              # one scalar
    return shares.select("feature", (F.col("share") / F.lit(float(whole))).alias("importance"))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= CLOSE * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def node_faults(nodes: DataFrame) -> DataFrame:
    """One row: trees whose leaves are not inner nodes + 1, inner nodes whose children do not add up to them, and
    inner nodes whose gain is not the impurity that the split takes away."""
    child = lambda side: nodes.select(
        "tree", F.col("node").alias(f"{side}_child"), F.col("count").alias(f"{side}_count"),
        F.col("mass").alias(f"{side}_mass"), F.col("impurity").alias(f"{side}_impurity"))
    inner = (nodes.where(F.col("left_child").isNotNull())
                  .join(child("left"), ["tree", "left_child"], "left").join(child("right"), ["tree", "right_child"], "left"))
    share = lambda side: F.col(f"{side}_mass") / F.col("mass") * F.col(f"{side}_impurity")
    taken = F.col("impurity") - share("left") - share("right")
    splits = inner.agg(
        F.count(F.when(~F.coalesce(F.col("left_count") + F.col("right_count") == F.col("count"), F.lit(False)), 1))
         .alias("wrong_counts"),
        F.count(F.when(~F.coalesce(close(taken, F.col("gain")) & (F.col("gain") >= 0), F.lit(False)), 1))
         .alias("wrong_gains"))
    shape = tree_summary(nodes).agg(F.count(F.when(F.col("leaves") * 2 - 1 != F.col("num_nodes"), 1)).alias("wrong_trees"),
                                    F.count(F.lit(1)).alias("trees"))
    a, b = splits.first(), shape.first()                             # one row each
    return nodes.sparkSession.createDataFrame(
        [(b["trees"], b["wrong_trees"], a["wrong_counts"], a["wrong_gains"])],
        "trees long, wrong_trees long, wrong_counts long, wrong_gains long")


def model_check(spark: SparkSession, model, predictions: DataFrame, train: DataFrame, features: str = "indexedfeatures",
                exact_leaves: bool = False) -> DataFrame:
    """One row that says whether a fitted tree model is what its node rows claim.

    * ``n_test``, ``n_equal``: test rows, and those whose prediction by node
      expressions equals MLlib's;
    * ``trees`` and the faults of ``node_faults``;
    * ``wrong_importances``: features whose importance by node rows differs from MLlib's;
    * ``better``: the error is below that of the test label's mean;
    * with ``exact_leaves`` (one tree, no bootstrap): ``wrong_leaves`` (leaves
      whose rows or mean label over ``train`` differ from what they say),
      ``n_train`` and the sums of ``label`` and prediction over ``train``,
      which leaf means make equal.
    """
    nodes = materialize(node_table(spark, model), "nodes")
    scored = score_by_nodes(predictions, nodes, features)
    error = F.avg((F.col("prediction") - F.col("label")) ** 2)
    equal = scored.agg(F.count(F.lit(1)).alias("n_test"),
                       F.count(F.when(close(F.col("node_prediction"), F.col("prediction")), 1)).alias("n_equal"),
                       (error < F.var_pop("label")).alias("better"))
    own = last_model(model).featureImportances.toArray()
    told = spark.createDataFrame([(i, float(v)) for i, v in enumerate(own)], "feature int, told double")
    importances = told.join(node_importances(nodes), "feature", "left").agg(F.count(F.when(
        ~close(F.col("told"), F.coalesce("importance", F.lit(0.0))), 1)).alias("wrong_importances"))
    parts = [equal, node_faults(nodes), importances]
    if exact_leaves:
        landed = with_leaf(train, nodes, features).groupBy("leaf").agg(
            F.count(F.lit(1)).alias("rows"), F.avg("label").alias("mean"), F.sum("label").alias("sum_label"))
        ends = nodes.where(F.col("left_child").isNull()).select(F.col("node").alias("leaf"), "count", "prediction")
        right = (F.col("rows") == F.col("count")) & close(F.col("mean"), F.col("prediction"))
        parts.append(ends.join(landed, "leaf", "full").agg(
            F.count(F.when(~F.coalesce(right, F.lit(False)), 1)).alias("wrong_leaves"), F.sum("rows").alias("n_train"),
            F.sum("sum_label").alias("sum_label"), F.sum(F.col("rows") * F.col("prediction")).alias("sum_prediction")))
    row, fields = [], []
    for part in parts:                                               # each a global aggregate of one row
        row += list(part.first())
        fields += part.schema.fields
    from pyspark.sql.types import StructType
    return spark.createDataFrame([tuple(row)], StructType(fields))


def fold_errors(model, data: DataFrame, grid: Sequence[dict], fold_col: str, label: str = "label") -> DataFrame:
    """(fold, grid_point, n, rmse, mllib_rmse): held-out errors of a cross-validation kept with its sub-models.

    ``rmse`` comes from the node rows of the fold's model, ``mllib_rmse`` from
    its ``transform``; one pass per fold scores all grid points side by side.
    """
    spark, rows = data.sparkSession, []
    for fold, models in enumerate(model.subModels):
        part = data.where(F.col(fold_col) == fold)
        for point, sub in enumerate(models):
            part = sub.transform(part).withColumnRenamed("prediction", f"_mllib{point}")
            part = score_by_nodes(part, materialize(node_table(spark, sub), "fold-nodes"), "indexedfeatures",
                                  f"_nodes{point}").drop("indexedfeatures")
        error = lambda c: F.sqrt(F.avg((F.col(c) - F.col(label)) ** 2))
        found = part.agg(F.count(F.lit(1)).alias("n"), *[error(f"_{kind}{p}").alias(f"{kind}{p}")
                                                         for kind in ("nodes", "mllib") for p in range(len(grid))]).first()
        rows += [(fold, p, found["n"], found[f"nodes{p}"], found[f"mllib{p}"]) for p in range(len(grid))]
    return spark.createDataFrame(rows, "fold int, grid_point int, n long, rmse double, mllib_rmse double")
