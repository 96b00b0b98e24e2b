"""The product feature table (order summary ⟕ view statistics → features).

Plan shape (see ``explain("formatted")`` in tests/test_plans.py):

    scan events ─ partial agg ─ exchange ─ final agg (A1, one row per product/brand)
    scan lineitem ⋈ scan orders (sort-merge on the order key) → written once, un-fanned
    counts per (product, price bucket) of the orders ⟕ A1 → label counts (F1), A3
    A1 + brand index (the dictionary joins the small side)
    orders ⟕ A1 on productid (J1) → fills (P8, P9) → scores / bucket / stock flag (P4-P6)
        ⟕ counts per (price bucket, brand) (A3 → J2) → sink projection (S5)

The join of orders to view statistics fans out over a product's brands.  Its
rows are never written: everything counted over them (how often a brand label
occurs, rows per price bucket and brand) is the product of small counts, so the
only large intermediate is the order summary, and the result is one stream
over it with two lookups.

A table that is saved by key (S4) keeps one row per key, the greatest by brand index,
then by the orders' columns.  Orders of one key meet the same statistics, so with
``collapse`` the counts are taken over all orders as before, but only orders with their
key's greatest order columns meet the statistics, and of these only the ones with their
product's greatest brand index: no other row can be kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.fixed import (ORDER_SUMMARY, PRODUCT_ORDER_CONTRACT, PRODUCT_ORDER_KEYS, PRODUCT_ORDER_MONTHLY_EXTRA,
                             VIEW_SUMMARY)
from shelfcast.functions.columns import (PRICE_CUTS, price_bucket, with_relative_price, with_scores,
                                         with_stock_flag)
from shelfcast.operators.aggregates import view_stats
from shelfcast.operators.clean import STRING_SENTINEL, fill_numeric, fill_string
from shelfcast.operators.indexing import ROW_BYTES, apply_dictionary, dictionary_of
from shelfcast.operators.joins import (ORDER_KEEP_COLUMNS, VIEW_STAT_COLUMNS, join_view_stats,
                                       lookup_join, one_brand_per_product, with_relative_brand)
from shelfcast.session import materialize, measured
from shelfcast.sources.sinks import dedupe_latest, narrow_to_greatest, to_sink_schema
from shelfcast.sources.tables import require_columns


def joined_view_features(orders: DataFrame, views: DataFrame,
                         stats_keys: Sequence[str] = ("productid", "brand"),
                         salt_buckets: int | None = None, measure: bool = True,
                         one_brand: bool = False) -> DataFrame:
    """A1 → J1 → P8 → P9: order rows with their (filled) view statistics.

    With ``measure`` the view statistics (one row per product/brand group)
    are written once and measured, and J1 broadcasts them when they are
    within the broadcast limit — the order side then streams through the
    join without a shuffle, whatever its key skew.
    """
    stats = view_stats(views, stats_keys)
    if one_brand:
        stats = one_brand_per_product(stats)
    stats_bytes = None
    if measure:
        stats, stats_bytes = measured(stats, "view-stats")
    extra = [k for k in stats_keys if k not in ("productid", "brand")]
    joined = join_view_stats(orders, stats, ORDER_KEEP_COLUMNS, VIEW_STAT_COLUMNS + tuple(extra),
                             salt_buckets=salt_buckets, stats_bytes=stats_bytes)
    return fill_string(fill_numeric(joined))


def greatest_orders(orders: DataFrame) -> DataFrame:
    """One order per sink key, the one whose row the sink puts highest.

    The orders of a key meet the same statistics, and the other columns that the sink compares
    follow from these and from the order's price.  Missing values are filled as the rows are later; keys stay
    as they are, so that they join as before.
    """
    payload = [c for c in PRODUCT_ORDER_CONTRACT if c in orders.columns and c not in PRODUCT_ORDER_KEYS]
    filled = fill_string(fill_numeric(orders, subset=payload), subset=payload)
    narrowed = narrow_to_greatest(filled, PRODUCT_ORDER_KEYS, payload[:1])
    return dedupe_latest(narrowed.select(*PRODUCT_ORDER_KEYS, *payload), PRODUCT_ORDER_KEYS)


def product_features(orders: DataFrame, views: DataFrame, with_fastseller: bool = False,
                     salt_buckets: int | None = None, one_brand: bool = False, collapse: bool = False) -> DataFrame:
    """The ``product_order`` feature table.

    ``with_fastseller`` builds the variant the monthly job consumes
    index, and the five mean scores kept.  ``collapse`` leaves out the rows that S4 cannot keep.
    """
    require_columns(orders, ORDER_SUMMARY, "order summary")
    require_columns(views, VIEW_SUMMARY, "view summary")
    labels = ("brand", "fastseller") if with_fastseller else ("brand",)
    to_index = {c: f"{c}indexed" for c in labels}
    contract = PRODUCT_ORDER_CONTRACT + (PRODUCT_ORDER_MONTHLY_EXTRA if with_fastseller else ())
    kept = [c for c in ORDER_KEEP_COLUMNS if c in contract]
    orders = materialize(orders.select(*kept), "order-summary")
    stats = view_stats(views, ("productid", *labels))
    if one_brand:
        stats = one_brand_per_product(stats)
    stats, stats_bytes = measured(stats.fillna(STRING_SENTINEL, list(labels)), "view-stats")

    # Rows of the fanned-out join per (price bucket, labels), without making them.
    per_product = orders.groupBy("productid", price_bucket().alias("relativeprice")).agg(
        F.count(F.lit(1)).alias("_n"))
    groups = lookup_join(per_product, stats.select("productid", *labels), ["productid"], "left",
                         salt_buckets, stats_bytes).fillna(STRING_SENTINEL, list(labels))
    groups = materialize(groups.groupBy("relativeprice", *labels).agg(F.sum("_n").alias("_n")), "label-groups")
    counts = groups.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in labels])).alias("p"), "_n")
    dictionary = dictionary_of(counts.groupBy("p.column", "p.label").agg(F.sum("_n").alias("count")))
    brand_counts = groups.groupBy("relativeprice", "brand").agg(F.sum("_n").alias("relativebrand"))

    # The index joins the small side; orders without statistics get the fill label's index.
    stats = apply_dictionary(stats, dictionary, to_index)
    if collapse:
        stats = narrow_to_greatest(stats, ["productid"], ["brandindexed"])
        orders = materialize(greatest_orders(orders), "order-candidates")
    joined = join_view_stats(orders, stats, kept,
                             VIEW_STAT_COLUMNS + tuple(c for c in labels if c != "brand") + tuple(to_index.values()),
                             salt_buckets=salt_buckets, stats_bytes=stats_bytes)
    for c, target in to_index.items():
        index = dictionary.index_of(c, STRING_SENTINEL)
        if index is not None:
            joined = joined.fillna(index, [target])
    feats = with_stock_flag(with_relative_price(with_scores(fill_string(fill_numeric(joined)))))
    # One count per (price bucket, brand): at most (buckets) × (brand labels) rows.
    counts_bytes = (len(PRICE_CUTS) + 1) * (dictionary.bytes.get("brand", 0) + ROW_BYTES)
    with_brand_counts = with_relative_brand(feats, brand_counts, counts_bytes=counts_bytes)
    return to_sink_schema(with_brand_counts, contract)
