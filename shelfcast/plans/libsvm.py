"""Regression over a LIBSVM text source.

    S3 LIBSVM scan → F4 vector indexer (maxCategories 4, fit before the split)
    → F5 split → M2 forest → M9 score → M10 rmse, M14 structure

LIBSVM rows carry no key, so the deterministic split hashes the row's
content (label and non-zero entries); identical rows land on the same side.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.learners import forest_regressor, make_pipeline
from shelfcast.operators.metrics import regression_metrics
from shelfcast.operators.vectors import fit_vector_indexer, split
from shelfcast.plans.demand import ModelRun
from shelfcast.session import materialize
from shelfcast.sources.tables import read_libsvm

LIBSVM_MAX_CATEGORIES = 4


def libsvm_model(spark: SparkSession, path: str, num_features: int | None = None, seed: int = 7) -> ModelRun:
    data = read_libsvm(spark, path, num_features)
    # The vector's text lists its non-zero entries; the digest keeps the key short whatever their number.
    key = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("features").cast("string")))
    data = materialize(data.withColumn("_row", key))
    indexer = fit_vector_indexer(data, "features", "indexedfeatures", LIBSVM_MAX_CATEGORIES)
    train, test = split(data, ["_row"], 0.7)
    model = make_pipeline([indexer, forest_regressor("label", "indexedfeatures", seed=seed)]).fit(train)
    predictions = model.transform(test).drop("_row")
    return ModelRun(model, predictions, regression_metrics(predictions, "label"), train.drop("_row"))
