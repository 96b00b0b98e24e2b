"""Grouped statistics.

Every aggregate here is decomposable (count, sum, avg, min, max), so Spark
plans partial aggregation before the shuffle: a key that holds a third of
all rows leaves each map task as one partial row, never as a hot shuffle
partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.fixed import MERCHANT_VIEW_KEYS, MERCHANT_VIEW_MEANS

VIEW_SCORE_COLUMNS = ("scorefive", "scorefour", "scorethree", "scoretwo", "scoreone")


def view_stats(views: DataFrame, keys: Sequence[str] = ("productid", "brand"),
               count_col: str = "merchantid") -> DataFrame:
    """A1: per product (and brand): views counted by non-null merchant, mean scores, grade.

    A null brand forms its own group (SQL GROUP BY semantics).
    """
    return views.groupBy(*keys).agg(
        F.count(count_col).alias("numberofviews"),
        *[F.avg(c).alias(c) for c in VIEW_SCORE_COLUMNS],
        F.avg("sellergrade").alias("sellergrade"),
    )


def view_stats_by_merchant(views: DataFrame, keys: Sequence[str] = MERCHANT_VIEW_KEYS) -> DataFrame:
    """A2: per 6 keys: non-null channel count and 13 means, suffixed ``1``."""
    return views.groupBy(*keys).agg(
        F.count("channel").alias("numberofviews1"),
        *[F.avg(c).alias(f"{c}1") for c in MERCHANT_VIEW_MEANS],
    )


def brand_price_counts(df: DataFrame, keys: Sequence[str] = ("relativeprice", "brand"),
                       count_col: str = "productid", out: str = "relativebrand") -> DataFrame:
    """A3: rows per (price bucket, brand), counted on non-null ``count_col``."""
    return df.groupBy(*keys).agg(F.count(count_col).alias(out))


def grouped_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The bulk ``groupBy(keys).avg(cols)`` form; columns come out as ``avg(col)``."""
    return df.groupBy(*keys).avg(*columns)


def row_count(df: DataFrame, out: str = "n") -> DataFrame:
    """Row count as a one-row frame (stays lazy, unlike ``count()``)."""
    return df.agg(F.count(F.lit(1)).alias(out))


def prediction_range(pred: DataFrame, col: str = "prediction") -> DataFrame:
    """Global max and min of predictions in one aggregate pass."""
    return pred.agg(F.max(col).alias("max_prediction"), F.min(col).alias("min_prediction"))
