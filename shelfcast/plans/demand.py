"""Weekly and monthly demand datasets and models.

Dataset steps are lazy DataFrame transforms (rollup → HAVING → assemble →
cast).  Model steps fit MLlib estimators; before any repeated fit (the
cross-validation grid runs 3 depths × 4 folds + 1 refit) the assembled
training frame is checkpointed, so each fit reads a small materialised
table instead of re-running the rollup over the feature table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.fixed import (LABEL_LIMIT, MONTHLY_FEATURES, MONTHLY_KEYS, WEEKLY_FEATURES, WEEKLY_KEYS)
from shelfcast.functions.columns import cast_label, key_bucket
from shelfcast.operators.learners import check_bins, cross_validate, forest_regressor, make_pipeline, param_grid
from shelfcast.operators.metrics import regression_metrics
from shelfcast.operators.rollups import having, monthly_rollup, weekly_rollup
from shelfcast.operators.vectors import assemble, fit_vector_indexer, split
from shelfcast.session import materialize

# Fixed model settings of the two jobs.
WEEKLY_MAX_CATEGORIES = 40
WEEKLY_MAX_BINS = 40          # ≥ max categories (a 40-category feature needs 40 bins)
WEEKLY_DEPTH_GRID = (4, 8, 10)
WEEKLY_FOLDS = 4
MONTHLY_MAX_CATEGORIES = 20


def weekly_dataset(po: DataFrame, keep_keys: bool = False) -> DataFrame:
    """A5 → P3 → F3 → P7: (label double, features) per product-seller-week."""
    rolled = having(weekly_rollup(po), f"label < {LABEL_LIMIT}")
    data = assemble(rolled, WEEKLY_FEATURES, "features")
    data = cast_label(data, "label")
    return data.select(*(WEEKLY_KEYS if keep_keys else ()), "label", "features")


def monthly_dataset(po_monthly: DataFrame, keep_keys: bool = False) -> DataFrame:
    """A4 → F3 → P7: (label = units double, features) per product-seller-month."""
    rolled = monthly_rollup(po_monthly)
    data = assemble(rolled, MONTHLY_FEATURES, "features")
    data = data.withColumn("label", F.col("productcount").cast("double"))
    return data.select(*(MONTHLY_KEYS if keep_keys else ()), "label", "features")


@dataclass
class ModelRun:
    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame
    train: DataFrame | None = None
    cv: CrossValidatorModel | None = None        # with its sub-models, where the job tunes


def weekly_model(po: DataFrame, seed: int = 7, leaky: bool = False, parallelism: int = 3,
                 keep_sub_models: bool = False) -> ModelRun:
    """Vector indexer (fit before the split, as the job does) + forest, tuned by 4-fold CV.

    ``leaky=True`` reproduces the original refit on *all* rows before
    """
    data = materialize(weekly_dataset(po, keep_keys=True))
    indexer = fit_vector_indexer(data, "features", "indexedfeatures", WEEKLY_MAX_CATEGORIES)
    # Folds are a property of the row key, like the split: the same rows meet however they are partitioned.
    data = data.withColumn("_fold", key_bucket(WEEKLY_KEYS, WEEKLY_FOLDS, seed).cast("int"))
    train, test = split(data, WEEKLY_KEYS, 0.7)
    check_bins(WEEKLY_MAX_BINS, WEEKLY_MAX_CATEGORIES)
    forest = forest_regressor("label", "indexedfeatures", maxBins=WEEKLY_MAX_BINS, seed=seed)
    pipeline = make_pipeline([indexer, forest])
    grid = param_grid(forest, {"maxDepth": list(WEEKLY_DEPTH_GRID)})
    fitted_on = data if leaky else train
    model, _ = cross_validate(fitted_on, pipeline, grid, "label", folds=WEEKLY_FOLDS, fold_col="_fold", seed=seed,
                              parallelism=parallelism, keep_sub_models=keep_sub_models)
    predictions = model.transform(test)
    return ModelRun(model, predictions, regression_metrics(predictions, "label"), fitted_on, model)


def monthly_model(po_monthly: DataFrame, seed: int = 7) -> ModelRun:
    """Vector indexer (maxCategories 20) + 20-tree forest; reports range-normalised RMSE."""
    data = materialize(monthly_dataset(po_monthly, keep_keys=True))
    indexer = fit_vector_indexer(data, "features", "indexedfeatures", MONTHLY_MAX_CATEGORIES)
    train, test = split(data, MONTHLY_KEYS, 0.7)
    forest = forest_regressor("label", "indexedfeatures", seed=seed)
    model = make_pipeline([indexer, forest]).fit(train)
    predictions = model.transform(test)
    return ModelRun(model, predictions, regression_metrics(predictions, "label", with_range=True), train)
