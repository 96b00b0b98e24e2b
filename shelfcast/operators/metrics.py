"""Model metrics (M10-M13, A6) as single-pass aggregates.

One ``agg`` computes every statistic, so a metric is one scan of the
predictions with partial aggregation — no per-metric job, no collect of
rows.  Definitions follow MLlib's evaluators: r2 = 1 − SSE/SST with
SST = n · population variance of the label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       with_range: bool = False) -> DataFrame:
    """M10/M11 (and M12/A6 with ``with_range``): one row of rmse, mse, mae, r2, n."""
    err = F.col(prediction) - F.col(label)
    stats = pred.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.var_pop(F.col(label)).alias("_var"),
        F.max(prediction).alias("max_prediction"),
        F.min(prediction).alias("min_prediction"),
    )
    out = [F.col("n"), F.sqrt("mse").alias("rmse"), F.col("mse"), F.col("mae"),
           (F.lit(1.0) - F.col("mse") / F.nullif(F.col("_var"), F.lit(0.0))).alias("r2")]
    if with_range:
        rng = F.nullif(F.col("max_prediction") - F.col("min_prediction"), F.lit(0.0))
        out += [F.col("max_prediction"), F.col("min_prediction"), (F.sqrt("mse") / rng).alias("nrmse")]
    return stats.select(*out)


def nrmse(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rmse / (max(prediction) − min(prediction)); null for constant predictions."""
    return regression_metrics(pred, label, prediction, with_range=True).select("nrmse")


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy (the old "precision" metric) and test error = 1 − accuracy."""
    hit = F.when(F.col(prediction) == F.col(label), F.lit(1.0)).otherwise(F.lit(0.0))
    return pred.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy")) \
               .withColumn("test_error", F.lit(1.0) - F.col("accuracy"))
