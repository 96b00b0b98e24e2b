"""Calendar rollups of the feature table.

Both rollups are decomposable aggregates keyed by product, seller and
calendar fields; partial aggregation runs before the shuffle, so output
size — not input size — drives the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.fixed import (LABEL_LIMIT, MONTHLY_KEYS, MONTHLY_MEANS, MONTHLY_SUMS, WEEKLY_KEYS, WEEKLY_MEANS,
                             WEEKLY_SUMS)


def _rollup(po: DataFrame, keys: Sequence[str], means: Sequence[str],
            sums: Sequence[tuple[str, str]]) -> DataFrame:
    return po.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in means],
                                 *[F.sum(c).alias(out) for c, out in sums])


def monthly_rollup(po: DataFrame) -> DataFrame:
    """A4: per (product, seller, year, month): summed views and units, 13 means."""
    return _rollup(po, MONTHLY_KEYS, MONTHLY_MEANS, MONTHLY_SUMS)


def weekly_rollup(po: DataFrame) -> DataFrame:
    """A5: per (product, seller, year, month, week): units → label, views summed, 9 means."""
    return _rollup(po, WEEKLY_KEYS, WEEKLY_MEANS, WEEKLY_SUMS)


def having(df: DataFrame, condition: str = f"label < {LABEL_LIMIT}") -> DataFrame:
    """Post-aggregate filter; null labels drop, negative sentinel sums stay."""
    return df.filter(condition)


def having_count(df: DataFrame, condition: str = "label < 10", out: str = "n") -> DataFrame:
    """Filter + count as a one-row table."""
    return df.filter(condition).agg(F.count(F.lit(1)).alias(out))
