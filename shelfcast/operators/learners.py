"""Learners, pipelines and tuning (M1-M9, M14), all MLlib.

MLlib trees train distributedly (per-level histogram aggregation on the
executors; only split statistics reach the driver), so these scale with
the cluster.  What the jobs control is how often the training input is
recomputed: callers checkpoint the assembled frame before repeated fits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed settings of the linear model (M4).
LINEAR_MAX_ITER = 10
LINEAR_REG = 0.3
LINEAR_ELASTIC_NET = 0.8


def tree_regressor(label: str = "label", features: str = "features", **params) -> DecisionTreeRegressor:
    """M1: decision tree (depth 5, 32 bins unless overridden)."""
    return DecisionTreeRegressor(labelCol=label, featuresCol=features, **params)


def forest_regressor(label: str = "label", features: str = "features", **params) -> RandomForestRegressor:
    """M2: random forest (20 trees, depth 5 unless overridden)."""
    return RandomForestRegressor(labelCol=label, featuresCol=features, **params)


def gbt_regressor(label: str = "label", features: str = "features", **params) -> GBTRegressor:
    """M3: gradient-boosted trees (maxIter 10 in the job)."""
    params.setdefault("maxIter", 10)
    return GBTRegressor(labelCol=label, featuresCol=features, **params)


def linear_regressor(label: str = "label", features: str = "features", **params) -> LinearRegression:
    """M4: elastic-net linear regression (maxIter 10, reg 0.3, mix 0.8).

    The solver is pinned to L-BFGS/OWLQN, the path elastic-net always took
    in the original jobs; "auto" would pick the normal-equation solver,
    which standardises with population instead of sample deviations.
    """
    params.setdefault("solver", "l-bfgs")
    params.setdefault("maxIter", LINEAR_MAX_ITER)
    params.setdefault("regParam", LINEAR_REG)
    params.setdefault("elasticNetParam", LINEAR_ELASTIC_NET)
    return LinearRegression(labelCol=label, featuresCol=features, **params)


def tree_classifier(label: str = "label", features: str = "features", **params) -> DecisionTreeClassifier:
    """M5: decision-tree classifier."""
    return DecisionTreeClassifier(labelCol=label, featuresCol=features, **params)


def check_bins(max_bins: int, max_categories: int) -> None:
    if max_bins < max_categories:
        raise ValueError(f"maxBins {max_bins} is below maxCategories {max_categories}")


def make_pipeline(stages: Sequence[Estimator | Transformer]) -> Pipeline:
    """M6: chain stages; pre-fitted transformers (e.g. a vector indexer model) pass through."""
    return Pipeline(stages=list(stages))


def fit(df: DataFrame, stages: Sequence[Estimator | Transformer]) -> PipelineModel:
    return make_pipeline(stages).fit(df)


def weighted_rows(df: DataFrame, columns: Sequence[str], out: str = "weight") -> DataFrame:
    """The distinct rows of ``columns`` and how often each stands in ``df`` (double).

    A learner that takes weights (``weightCol``) learns from them what it would from
    all rows, as long as it draws none: one counting pass, reduced map-side, takes
    the place of the passes and the cached copy of every fit.
    """
    return df.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias(out))


def param_grid(estimator: Estimator, values: Mapping[str, Sequence]) -> list[dict]:
    """M7: cartesian grid over named params of ``estimator``."""
    builder = ParamGridBuilder()
    for name, options in values.items():
        builder = builder.addGrid(estimator.getParam(name), list(options))
    return builder.build()


def cross_validate(df: DataFrame, pipeline: Pipeline, grid: list[dict], label: str = "label",
                   folds: int = 4, fold_col: str | None = None, metric: str = "rmse",
                   seed: int | None = None, parallelism: int = 1,
                   keep_sub_models: bool = False, weight: str | None = None) -> tuple[CrossValidatorModel, DataFrame]:
    """M8: k-fold CV; returns the refitted best model and one row per grid point.

    ``fold_col`` (ints in [0, folds)) makes fold membership a property of
    the data; ``parallelism`` fits grid points concurrently;
    ``keep_sub_models`` keeps every fold's models (``model.subModels[fold][point]``);
    ``weight`` names the rows' weights in the errors (the estimator names its own).
    """
    evaluator = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)
    if weight is not None:
        evaluator = evaluator.setWeightCol(weight)
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=evaluator,
                        numFolds=folds, parallelism=parallelism, collectSubModels=keep_sub_models)
    if fold_col is not None:
        cv = cv.setFoldCol(fold_col)
    if seed is not None:
        cv = cv.setSeed(seed)
    model = cv.fit(df)
    rows = []
    for i, (params, avg) in enumerate(zip(grid, model.avgMetrics)):
        for param, value in params.items():
            rows.append((i, param.name, float(value), float(avg)))
    metrics = df.sparkSession.createDataFrame(rows, "grid_point int, param string, value double, avg_metric double")
    return model, metrics


def score(model: Transformer, df: DataFrame) -> DataFrame:
    """M9: batch scoring (lazy)."""
    return model.transform(df)


def last_model(model) -> Transformer:
    """The fitted estimator at the end of a (CV-wrapped) pipeline model."""
    if isinstance(model, CrossValidatorModel):
        model = model.bestModel
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    return model


def tree_report(model) -> list[tuple[int, int, int, float, str]]:
    """(tree_id, depth, num_nodes, weight, structure) for a tree or ensemble model.

    ``structure`` is the learned tree as text (``toDebugString``); its size
    is bounded by the node count (≤ 2^(depth+1) − 1).
    """
    m = last_model(model)
    trees = getattr(m, "trees", None) or [m]
    weights = list(getattr(m, "treeWeights", [1.0] * len(trees)))
    return [(i, t.depth, t.numNodes, float(w), t.toDebugString) for i, (t, w) in enumerate(zip(trees, weights))]


def feature_importances(model) -> list[tuple[int, float]]:
    """(feature, importance) of a tree or ensemble model."""
    imp = last_model(model).featureImportances.toArray()
    return [(i, float(v)) for i, v in enumerate(imp)]


def linear_summary(model) -> dict:
    """M4: training summary — iterations, objective history, RMSE, r2, residuals (lazy frame)."""
    s = last_model(model).summary
    return {"iterations": s.totalIterations, "objective_history": list(s.objectiveHistory),
            "rmse": s.rootMeanSquaredError, "r2": s.r2, "residuals": s.residuals}
