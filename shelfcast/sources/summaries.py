"""Order and view summaries derived from the driver tables.

The feature jobs consume two summary tables: ``product_order_summary``
(one row per order line) and ``product_view_summary`` (one row per view
event).  The driver ships TPC-H-like tables instead, so both are derived
here with the mapping fixed in FIXTURES.md §2; the DuckDB oracles use the
same expressions (``shelfcast.oracles``).

Scale: the order summary is ``lineitem ⋈ orders`` on the order key — a
large/large equi-join that Spark runs as a sort-merge join with both sides
hash-partitioned on the key (o_orderkey is unique, so the build side has
no hot key).  The view summary is a projection of ``events`` (no shuffle).
Only the columns each caller keeps are read, because everything is a lazy
``select`` that Catalyst prunes into the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.fixed import ORDER_SUMMARY, VIEW_SUMMARY
from shelfcast.sources.tables import read_table

# Fixed values of the mapping (FIXTURES.md §2): product/seller/merchant
# modulus, null/blank selectors and channel codes.
PRODUCT_MODULUS = 110          # P0..P109 on orders; views only reach P0..P99
ORDER_SELLER_MODULUS = 4
ORDER_MERCHANT_MODULUS = 2
ORDER_MERCHANT_NULL_EVERY = 5
ORDER_PRODUCT_BLANK_EVERY = 37
ORDER_SELLER_BLANK_EVERY = 31
ORDER_CHANNEL_BLANK_EVERY = 29
ATTRS_BLANK_EVERY = 7
ATTRS_NULL_EVERY = 11
PRICE_NULL_EVERY = 13
STOCK_NULL_EVERY = 17
RETURNFLAG_CHANNEL = {"R": "mobile_web", "A": "mobile"}   # anything else → "web"
USER_CHANNEL = {0: "mobile_web", 1: "mobile", 2: "web"}
VIEW_MERCHANT_NULL_EVERY = 19
VIEW_BRAND_NULL_EVERY = 97
VIEW_BRAND_BLANK_EVERY = 89
VIEW_FASTSELLER_BLANK_EVERY = 83
# View days are spread over the order calendar, so both tables meet on dates.
VIEW_FIRST_DAY = "1995-01-01"
VIEW_DAYS = 2400
VIEW_DAY_STEP = 37
BRAND_MODULUS = 25
FASTSELLER_EVERY = 5
SCORE_MODULI = {"scorefive": 11, "scorefour": 7, "scorethree": 5, "scoretwo": 3, "scoreone": 2}
SCORETWO_NULL_EVERY = 23
SELLERGRADE_MODULUS = 10

ORDER_COLUMNS = tuple(c for c, _ in ORDER_SUMMARY)
VIEW_COLUMNS = tuple(c for c, _ in VIEW_SUMMARY)


def _tag(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def _blank_every(n: int, value: Column, key: str = "l_orderkey") -> Column:
    return F.when(F.col(key) % n == 0, F.lit("")).otherwise(value)


def _calendar(ts: Column) -> list[Column]:
    return [F.year(ts).cast("int").alias("year"),
            F.month(ts).cast("int").alias("month"),
            F.weekofyear(ts).cast("int").alias("week"),
            F.dayofmonth(ts).cast("int").alias("day")]


def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``product_order_summary``: lineitem ⋈ orders, one row per order line."""
    li = read_table(spark, sf_dir, "lineitem")
    od = read_table(spark, sf_dir, "orders")
    joined = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    discounted = unit * (1 - F.col("l_discount"))
    channel = F.when(F.col("l_returnflag") == "R", F.lit(RETURNFLAG_CHANNEL["R"])) \
               .when(F.col("l_returnflag") == "A", F.lit(RETURNFLAG_CHANNEL["A"])) \
               .otherwise(F.lit("web"))
    return joined.select(
        _blank_every(ORDER_PRODUCT_BLANK_EVERY, _tag("P", F.col("l_partkey") % PRODUCT_MODULUS)).alias("productid"),
        _blank_every(ORDER_SELLER_BLANK_EVERY, _tag("S", F.col("l_suppkey") % ORDER_SELLER_MODULUS)).alias("sellerid"),
        F.when(F.col("l_orderkey") % ORDER_MERCHANT_NULL_EVERY != 0,
               _tag("M", F.col("l_suppkey") % ORDER_MERCHANT_MODULUS)).alias("merchantid"),
        *_calendar(F.col("o_orderdate")),
        F.when(F.col("l_orderkey") % ATTRS_BLANK_EVERY == 0, F.lit(""))
         .when(F.col("l_orderkey") % ATTRS_NULL_EVERY == 0, F.lit(None).cast("string"))
         .otherwise(F.col("o_orderpriority")).alias("attrs"),
        _blank_every(ORDER_CHANNEL_BLANK_EVERY, channel).alias("channel"),
        F.when(F.col("l_orderkey") % PRICE_NULL_EVERY == 0, F.lit(None).cast("double"))
         .otherwise(unit).alias("price"),
        discounted.alias("disprice"),
        (discounted * (1 + F.col("l_tax"))).alias("finalprice"),
        F.col("l_quantity").cast("bigint").alias("productcount"),
        F.col("l_linenumber").cast("int").alias("eventcount"),
        F.when(F.col("l_orderkey") % STOCK_NULL_EVERY == 0, F.lit(None).cast("int"))
         .otherwise(F.col("l_linenumber").cast("int")).alias("stock"),
    )


def view_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``product_view_summary``: one row per event, product from ``props.k``."""
    # Parse props once per row in its own projection: Catalyst does not
    # re-inline a non-cheap expression when collapsing projections, so the
    # product id, the brand and any inferred null filter all reuse it.
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", "value",
        F.get_json_object(F.col("props"), "$.k").cast("int").alias("_k"))
    k = F.col("_k")
    eid = F.col("event_id")
    uid = F.col("user_id")
    user_channel = F.pmod(uid, F.lit(3))
    scores = [
        (F.when(eid % SCORETWO_NULL_EVERY == 0, F.lit(None).cast("int"))
          .otherwise((eid % SCORE_MODULI[name]).cast("int")) if name == "scoretwo"
         else (eid % SCORE_MODULI[name]).cast("int")).alias(name)
        for name in ("scorefive", "scorefour", "scorethree", "scoretwo", "scoreone")
    ]
    return ev.select(
        _tag("P", k).alias("productid"),
        _tag("S", uid % ORDER_SELLER_MODULUS).alias("sellerid"),
        F.when(eid % VIEW_MERCHANT_NULL_EVERY == 0, F.lit(None).cast("string"))
         .otherwise(_tag("M", uid % ORDER_MERCHANT_MODULUS)).alias("merchantid"),
        *_calendar(F.date_add(F.lit(VIEW_FIRST_DAY).cast("date"), (eid * VIEW_DAY_STEP % VIEW_DAYS).cast("int"))),
        F.when(eid % VIEW_BRAND_NULL_EVERY == 0, F.lit(None).cast("string"))
         .otherwise(_blank_every(VIEW_BRAND_BLANK_EVERY, _tag("Brand#", k % BRAND_MODULUS), "event_id")).alias("brand"),
        F.when(user_channel == 0, F.lit(USER_CHANNEL[0]))
         .when(user_channel == 1, F.lit(USER_CHANNEL[1]))
         .otherwise(F.lit(USER_CHANNEL[2])).alias("channel"),
        _blank_every(VIEW_FASTSELLER_BLANK_EVERY,
                     F.when(eid % FASTSELLER_EVERY == 0, F.lit("yes")).otherwise(F.lit("no")),
                     "event_id").alias("fastseller"),
        F.col("value").alias("price"),
        F.col("value").alias("disprice"),
        F.lit(1).cast("int").alias("eventcount"),
        (eid % 4).cast("int").alias("productcount"),
        *scores,
        (uid % SELLERGRADE_MODULUS).cast("int").alias("sellergrade"),
    )
