"""Joins of order rows to view statistics.

Strategy
--------
The right side of every lookup join here is a *grouped* frame (one row per
key group), so its size is bounded by the number of groups, not by the
number of view events.  Every lookup goes through :func:`lookup_join`, and
broadcast is an explicit, checked decision: callers pass the right side's
bytes (measured after materializing the small aggregate, or from a fitted
dictionary), and only sides within the session's broadcast limit are
broadcast — then the large left side is never shuffled.  Above the limit
the join is left to AQE (runtime broadcast from measured bytes, else
sort-merge with skewed partitions split).

Above the limit hot keys are found and salted, and only they
(:func:`hot_keys`): a mergeable frequent-items aggregate over the left keys
names every key with more than its share of one shuffle partition, an
exact count of these few says into how many salts each is dealt, and the right
side's rows of such a key are repeated once per salt.  All other rows join as
they are.  The salt is a pure function of the row, so a recomputed task after
an executor loss yields the same assignment; rows equal in every column share
a salt, unless they are the whole of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.fixed import MERCHANT_VIEW_KEYS
from shelfcast.session import broadcast_limit, measured

ORDER_KEEP_COLUMNS = ("productid", "year", "month", "week", "day", "attrs", "channel",
                      "disprice", "eventcount", "finalprice", "price", "productcount",
                      "sellerid", "stock")
MERCHANT_JOIN_KEYS = ("merchantid", "productid", "channel", "sellerid")
VIEW_STAT_COLUMNS = ("scorefive", "scorefour", "scorethree", "scoretwo", "scoreone",
                     "sellergrade", "numberofviews", "brand")


# A key is hot when it holds more than this part of an even shuffle partition's rows.
HOT_PART = 0.5
# Smallest share of the rows that the frequent-items aggregate looks for: it keeps 1 / share candidates.
LEAST_HOT_SHARE = 1e-4


def hot_keys(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame | None:
    """(``keys``, ``salts``): the hot keys of ``df`` and into how many parts each is dealt; ``None`` without any.

    The frequent-items aggregate misses no key above its share and is merged
    map-side; the candidates (at most ``1 / share``) are then counted exactly.
    Null keys count like any other: rows whose key is null must land somewhere, too.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, max(LEAST_HOT_SHARE, HOT_PART / partitions))
    named = df.select(F.struct(*[F.col(k) for k in keys]).alias("_key"))
    # One text per key: the aggregate compares whole values.
    text = named.select(F.to_json("_key", {"ignoreNullFields": "false"}).alias("_text"))
    candidates = text.freqItems(["_text"], share).first()[0]
    if not candidates:
        return None
    listed = spark.createDataFrame([(c,) for c in candidates], "_text string")
    counted = (named.withColumn("_text", F.to_json("_key", {"ignoreNullFields": "false"}))
                    .join(F.broadcast(listed), "_text").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")))
    found = counted.collect()                                       # 1 / share rows at most
    total = df.count()
    hot = [(r["_key"], -(-r["_n"] * partitions // total)) for r in found if r["_n"] > share * total]
    if not hot:
        return None
    schema = counted.select("_key", F.lit(1).cast("long").alias("salts")).schema
    return spark.createDataFrame(hot, schema).select(*[F.col(f"_key.{k}").alias(k) for k in keys], "salts")


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str | tuple[str, str]], how: str = "left",
                salt_buckets: int | None = None, right_bytes: int | None = None,
                null_safe: bool = False) -> DataFrame:
    """Equi-join a large ``left`` to a grouped ``right``; the right side's keys are dropped.

    ``on`` lists key names, or (left, right) pairs of names.  ``right_bytes``
    is the right side's measured (or upper-bound) size when the caller knows
    it: within the session's broadcast limit the right side is broadcast and
    the left side is never shuffled, so a hot key costs nothing.  Above it,
    hot keys of the left side are found and salted.  With an unknown size
    the join is left to AQE.  ``salt_buckets`` > 1 salts every key evenly
    instead.  ``null_safe`` lets null keys match.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    spark = left.sparkSession
    # Names of their own for the right keys: both sides may come from one frame.
    right = right.withColumnsRenamed({r: f"_on_{i}" for i, (_, r) in enumerate(pairs)})
    names = [(k, f"_on_{i}") for i, (k, _) in enumerate(pairs)]
    columns = left.columns
    drawn = F.xxhash64(*[F.col(c) for c in columns])
    if right_bytes is not None and right_bytes <= broadcast_limit(spark):
        right = F.broadcast(right)
    elif (salt_buckets or 0) > 1:
        left = left.withColumn("_salt", F.pmod(drawn, F.lit(salt_buckets)))
        right = right.withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
        names.append(("_salt", "_salted"))
    elif right_bytes is not None:
        hot = hot_keys(left, [k for k, _ in pairs])
        if hot is not None:
            # A few rows (1 / share at most): sent to both sides.
            hot = F.broadcast(hot.toDF(*[f"_hot_{i}" for i in range(len(pairs))], "_salts"))
            at = lambda side: reduce(lambda a, b: a & b, [
                F.col(n[side]).eqNullSafe(F.col(f"_hot_{i}")) for i, n in enumerate(names)])
            hidden = [f"_hot_{i}" for i in range(len(pairs))]
            left = left.join(hot, at(0), "left").withColumn(
                "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(drawn, F.col("_salts")))) \
                .drop("_salts", *hidden)
            right = right.join(hot, at(1), "left").withColumn("_salted", F.explode(F.sequence(
                F.lit(0).cast("long"), F.coalesce(F.col("_salts") - 1, F.lit(0).cast("long"))))).drop("_salts", *hidden)
            names.append(("_salt", "_salted"))
    equal = (lambda a, b: F.col(a).eqNullSafe(F.col(b))) if null_safe else (lambda a, b: F.col(a) == F.col(b))
    cond = reduce(lambda a, b: a & b, [equal(a, b) for a, b in names])
    joined = left.join(right, cond, how)
    return joined.select(*columns, *[c for c in right.columns if c not in {b for _, b in names}])


def join_view_stats(orders: DataFrame, stats: DataFrame,
                    order_columns: Sequence[str] = ORDER_KEEP_COLUMNS,
                    stat_columns: Sequence[str] = VIEW_STAT_COLUMNS,
                    salt_buckets: int | None = None, stats_bytes: int | None = None) -> DataFrame:
    """Orders ⟕ view stats on productid.

    The stats are grouped by product *and brand*, so a product viewed under
    several brands duplicates its orders once per brand (fan-out is the
    semantics; :func:`one_brand_per_product` removes it when unwanted).
    """
    left = orders.select(*order_columns)
    right = stats.select("productid", *[c for c in stat_columns if c != "productid"])
    joined = lookup_join(left, right, ["productid"], "left", salt_buckets, stats_bytes)
    return joined.select(*order_columns, *[c for c in stat_columns if c != "productid"])


def one_brand_per_product(stats: DataFrame) -> DataFrame:
    """Optional Q4 fix: keep one stats row per product (most views, then brand).

    An arg-max aggregate (partial + final) instead of a window, so a hot
    product is reduced map-side.
    """
    payload = [c for c in stats.columns if c != "productid"]
    best = stats.groupBy("productid").agg(
        F.max(F.struct(F.col("numberofviews").alias("_views"),
                       F.coalesce(F.col("brand"), F.lit("")).alias("_brand"),
                       *[F.col(c) for c in payload])).alias("_best"))
    return best.select("productid", *[F.col(f"_best.{c}").alias(c) for c in payload])


def with_relative_brand(df: DataFrame, counts: DataFrame,
                        keys: Sequence[str] = ("relativeprice", "brand"),
                        counts_bytes: int | None = None) -> DataFrame:
    """Attach the per-(price bucket, brand) count back to every row."""
    return lookup_join(df, counts, keys, "left", right_bytes=counts_bytes)


def suffix_columns(df: DataFrame, columns: Sequence[str], suffix: str = "1") -> DataFrame:
    """Rename join keys so both sides of a join stay addressable."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})


def join_view_stats_by_merchant(orders: DataFrame, stats: DataFrame,
                                keys: Sequence[str] = MERCHANT_JOIN_KEYS,
                                suffix: str = "1", stats_bytes: int | None = None,
                                salt_buckets: int | None = None) -> DataFrame:
    """Orders ⟕ suffixed merchant-level stats on 4 keys (nulls never match).

    The stats are grouped by 6 keys, so brand × fastseller combinations fan
    out.  The suffixed keys stay in the result (null where nothing matched).
    """
    kept = stats.withColumns({f"_key_{k}": F.col(f"{k}{suffix}") for k in keys})
    joined = lookup_join(orders, kept, [(k, f"_key_{k}") for k in keys], "left", salt_buckets, stats_bytes)
    return joined.select(*orders.columns, *stats.columns)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                   right_bytes: int | None = None) -> DataFrame:
    """Equi-join where null keys match each other (``<=>``).

    Returns all left columns plus the right side's non-key columns.
    """
    return lookup_join(left, right, keys, how, right_bytes=right_bytes, null_safe=True)


def pair_join_counts(left: DataFrame, right: DataFrame,
                     keys: Sequence[str] = ("merchantid", "productid")) -> DataFrame:
    """J5 (re-aimed): inner pair join on ``keys`` without materialising pairs.

    The keyed inner join of two multi-row sides followed by a projection of
    the key yields each key ``n_left · n_right`` times.  Emitting every pair
    is quadratic in a hot key, so each side is pre-aggregated to one row per
    key (map-side partial counts) and the multiplicity is returned as
    ``pairs``.  Null keys never match, as in the inner join.
    """
    lc = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
    rc = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr"))
    return lc.join(rc, list(keys), "inner").select(*keys, (F.col("_nl") * F.col("_nr")).alias("pairs"))


def pair_join_rows(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("merchantid", "productid"),
                   out: str = "partners") -> DataFrame:
    """J5 keeping the left rows: each left row that has partners, with how many.

    The pair join followed by a projection of the left side yields every left
    row once per partner; here it stands once, and ``out`` says how often it
    would.  The right side is counted per key first, so a hot key is one row
    of the join; over the broadcast limit its left rows are salted.
    """
    partners, size = measured(right.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
                                   .groupBy(*keys).agg(F.count(F.lit(1)).alias(out)), "partners")
    return lookup_join(left, partners, list(keys), "inner", right_bytes=size)


__all__ = ["lookup_join", "join_view_stats", "one_brand_per_product", "with_relative_brand",
           "suffix_columns", "join_view_stats_by_merchant", "join_null_safe", "pair_join_counts",
           "pair_join_rows", "hot_keys",
           "MERCHANT_VIEW_KEYS"]
