"""Feature-job operators on the FIXTURES.md §3 inline frames."""

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from shelfcast.functions.columns import with_relative_price, with_scores, with_stock_flag
from shelfcast.operators.aggregates import brand_price_counts, view_stats
from shelfcast.operators.clean import fill_numeric, fill_string
from shelfcast.operators.indexing import index_category
from shelfcast.operators.joins import join_view_stats, one_brand_per_product
from shelfcast.operators.rollups import having, weekly_rollup
from shelfcast.plans.product_features import joined_view_features, product_features


def test_view_stats_counts_non_null_merchants_and_keeps_null_brand(tiny_views):
    rows = {(r.productid, r.brand): r for r in view_stats(tiny_views).collect()}
    assert set(rows) == {("P1", "A"), ("P1", "B"), ("P3", None)}
    a = rows[("P1", "A")]
    assert a.numberofviews == 1
    assert (a.scorefive, a.scorefour, a.scorethree, a.scoretwo, a.scoreone, a.sellergrade) == (6, 5, 4, 3, 2, 8)
    b = rows[("P1", "B")]
    assert (b.numberofviews, b.scorefive, b.sellergrade) == (1, 1, 5)
    n = rows[("P3", None)]
    assert (n.numberofviews, n.scorefive, n.scoretwo, n.sellergrade) == (1, 2, None, 4)


def test_join_fans_out_per_brand(tiny_orders, tiny_views):
    joined = join_view_stats(tiny_orders, view_stats(tiny_views))
    counts = {r.productid: r["count"] for r in joined.groupBy("productid").count().collect()}
    assert joined.count() == 6
    assert counts == {"P1": 4, "P2": 1, "P3": 1}


def test_salted_join_equals_plain_join(tiny_orders, tiny_views):
    stats = view_stats(tiny_views)
    plain = join_view_stats(tiny_orders, stats)
    salted = join_view_stats(tiny_orders, stats, salt_buckets=4)
    assert sorted(plain.collect()) == sorted(salted.collect())


def test_fills_scores_bucket_and_flag(tiny_orders, tiny_views):
    filled = joined_view_features(tiny_orders, tiny_views)
    derived = with_stock_flag(with_relative_price(with_scores(filled)))
    got = sorted((r.productid, r.brand, r.scores, r.relativeprice, r.stock, r.price)
                 for r in derived.collect())
    assert got == sorted([
        ("P1", "A", 70.0, 3.0, 1.0, 3500.0), ("P1", "B", 15.0, 3.0, 1.0, 3500.0),
        ("P1", "A", 70.0, 2.0, 0.0, 3000.0), ("P1", "B", 15.0, 2.0, 0.0, 3000.0),
        ("P2", "NULL", -14985.0, 0.0, 0.0, -999.0), ("P3", "NULL", -1972.0, 1.0, 1.0, 2000.0)])


def test_fill_numeric_keeps_int_type_and_fill_string_keeps_blank(spark):
    df = spark.createDataFrame([(None, None, ""), (3, 1.5, "a")], "i int, d double, s string")
    out = fill_string(fill_numeric(df))
    assert dict(out.dtypes)["i"] == "int"
    assert sorted(out.collect()) == sorted([(-999, -999.0, ""), (3, 1.5, "a")])


def test_brand_index_ties_alphabetical_and_matches_string_indexer(tiny_orders, tiny_views):
    filled = joined_view_features(tiny_orders, tiny_views)
    ours = {r.brand: r.brandindexed for r in index_category(filled, "brand", "brandindexed")
            .select("brand", "brandindexed").distinct().collect()}
    assert ours == {"A": 0.0, "B": 1.0, "NULL": 2.0}
    ref = StringIndexer(inputCol="brand", outputCol="bi").fit(filled).transform(filled)
    assert {r.brand: r.bi for r in ref.select("brand", "bi").distinct().collect()} == ours


def test_index_matches_string_indexer_on_skewed_numeric_column(spark):
    # A numeric column is ranked by its string form; one label holds a third of the rows.
    rows = [(i % 7 if i % 3 else 100,) for i in range(600)]
    df = spark.createDataFrame(rows, "v int")
    ours = {r.v: r.vi for r in index_category(df, "v", "vi").select("v", "vi").distinct().collect()}
    ref = StringIndexer(inputCol="v", outputCol="vi").fit(df).transform(df)
    assert {r.v: r.vi for r in ref.select("v", "vi").distinct().collect()} == ours


def test_brand_price_counts_six_groups(tiny_orders, tiny_views):
    feats = with_stock_flag(with_relative_price(with_scores(joined_view_features(tiny_orders, tiny_views))))
    got = sorted((r.relativeprice, r.brand, r.relativebrand) for r in brand_price_counts(feats).collect())
    assert got == sorted([(3.0, "A", 1), (3.0, "B", 1), (2.0, "A", 1), (2.0, "B", 1),
                          (0.0, "NULL", 1), (1.0, "NULL", 1)])


def test_product_features_contract_and_weekly_having(tiny_orders, tiny_views):
    po = product_features(tiny_orders, tiny_views)
    assert po.columns == ["productid", "year", "month", "week", "day", "brandindexed", "disprice",
                          "finalprice", "numberofviews", "price", "productcount", "relativebrand",
                          "relativeprice", "scores", "sellergrade", "sellerid", "stock"]
    weekly = {r.productid: r for r in having(weekly_rollup(po)).collect()}
    assert set(weekly) == {"P1", "P3"}                  # P2 (label 25) is dropped
    assert (weekly["P1"].label, weekly["P1"].numberofviews) == (10, 4)
    assert (weekly["P3"].label, weekly["P3"].numberofviews) == (19, 1)


def test_one_brand_per_product_removes_fan_out(tiny_orders, tiny_views):
    stats = one_brand_per_product(view_stats(tiny_views))
    assert join_view_stats(tiny_orders, stats).count() == 4
    assert stats.where(F.col("productid") == "P1").count() == 1
