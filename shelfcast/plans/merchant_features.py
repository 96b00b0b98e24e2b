"""The older-generation merchant-level feature table (unfilled).

    view summary ─ A2 (6-key means, partial + final agg) ─ P2 (suffix "1")
    order summary ⟕ on merchant, product, channel, seller (J3)
    → sink projection by name (S5)

The 6-key stats fan out over brand × fastseller per join key, as in the
original job.  Means the sink never reads (year1 … day1, disprice1 …) are
pruned by Catalyst before the aggregate runs.

A table that is saved by key (S4) keeps one row per key, the greatest.  The rows made
from one order row differ in their statistics only, so with ``collapse`` each
order meets the greatest statistics of its join key: the others cannot be kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelfcast.fixed import MERCHANT_ORDER_CONTRACT, MERCHANT_VIEW_KEYS, ORDER_SUMMARY, VIEW_SUMMARY
from shelfcast.operators.aggregates import view_stats_by_merchant
from shelfcast.operators.joins import MERCHANT_JOIN_KEYS, join_view_stats_by_merchant, suffix_columns
from shelfcast.session import materialize, measured
from shelfcast.sources.sinks import dedupe_latest, to_sink_schema
from shelfcast.sources.tables import require_columns

# What this generation of the job reads: all of the orders, and the views without the seller's grade.
ORDER_COLUMNS = tuple(name for name, _ in ORDER_SUMMARY)
VIEW_COLUMNS = tuple(name for name, _ in VIEW_SUMMARY if name != "sellergrade")


def merchant_stats(views: DataFrame) -> DataFrame:
    """A2 → P2: 6-key view statistics with suffixed keys."""
    return suffix_columns(view_stats_by_merchant(views.select(*VIEW_COLUMNS)), MERCHANT_VIEW_KEYS)


def greatest_stats(stats: DataFrame) -> DataFrame:
    """Of the statistics that meet the same orders, those that the sink puts highest."""
    payload = [source for _, source in MERCHANT_ORDER_CONTRACT if source in stats.columns]
    keys = [f"{k}1" for k in MERCHANT_JOIN_KEYS]
    return dedupe_latest(stats.select(*keys, *payload), keys)


def merchant_features(orders: DataFrame, views: DataFrame, measure: bool = True, reused: bool = False,
                      collapse: bool = False) -> DataFrame:
    """Orders ⟕ merchant-level view stats, reshaped to the sink contract.

    With ``measure`` the stats are written once and measured; J3 broadcasts
    them when within the broadcast limit.  A frame that is ``reused`` (streamed
    more than once) has its orders written first, un-fanned: each pass is then a
    scan with a lookup, and the fanned-out rows need not be written.  ``collapse``
    leaves out the rows that S4 cannot keep.
    """
    require_columns(orders, ORDER_SUMMARY, "order summary")
    require_columns(views, VIEW_SUMMARY, "view summary")
    stats, stats_bytes = merchant_stats(views), None
    if collapse:
        stats = greatest_stats(stats)
    if measure:
        stats, stats_bytes = measured(stats, "merchant-stats")
    orders = orders.select(*ORDER_COLUMNS)
    if reused:
        orders = materialize(orders, "order-summary")
    joined = join_view_stats_by_merchant(orders, stats, stats_bytes=stats_bytes)
    return to_sink_schema(joined, MERCHANT_ORDER_CONTRACT)
