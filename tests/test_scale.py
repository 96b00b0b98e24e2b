"""Scale behaviour: size-checked broadcasts, hot keys, metadata through materialization."""

from pyspark.sql import functions as F

from shelfcast.operators.indexing import index_categories
from shelfcast.operators.joins import lookup_join
from shelfcast.operators.vectors import assemble
from shelfcast.session import broadcast_limit, materialize, measured


def _plan(df) -> str:
    df.collect()   # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def _hot_frames(spark):
    # One key holds a third of the left rows.
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string")))
         .alias("key"), F.col("id"))
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return left, right


def test_measured_lookup_is_broadcast_below_limit(spark):
    left, right = _hot_frames(spark)
    right, size = measured(right, "hot-stats")
    assert 98 * 8 < size < broadcast_limit(spark)
    plan = _plan(lookup_join(left, right, ["key"], "left", right_bytes=size))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lookup_over_limit_is_not_broadcast_and_results_agree(spark):
    left, right = _hot_frames(spark)
    right, size = measured(right, "hot-stats")
    small = sorted(lookup_join(left, right, ["key"], "left", right_bytes=size).collect())
    spark.conf.set("shelfcast.broadcast.maxBytes", "10")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        big = lookup_join(left, right, ["key"], "left", right_bytes=size)
        # Only the few hot keys are broadcast, to both sides.
        plan = _plan(big)
        assert "SortMergeJoin" in plan and all("_hot_" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
        salted = lookup_join(left, right, ["key"], "left", salt_buckets=8, right_bytes=size)
        assert sorted(big.collect()) == small
        assert sorted(salted.collect()) == small
    finally:
        spark.conf.unset("shelfcast.broadcast.maxBytes")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(64 * 1024 * 1024))


def test_nominal_metadata_survives_materialize(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0)], "c string, x double")
    indexed = materialize(index_categories(df, {"c": "ci"}, nominal=True), "meta")
    meta = indexed.schema["ci"].metadata["ml_attr"]
    assert meta["type"] == "nominal" and meta["num_vals"] == 2
    vec = materialize(assemble(indexed, ["ci", "x"], "features"), "vec")
    attrs = vec.schema["features"].metadata["ml_attr"]["attrs"]
    assert [a["name"] for a in attrs["nominal"]] == ["ci"]


def _hot_orders_and_views(spark):
    from tests.conftest import ORDER_SCHEMA, VIEW_SCHEMA
    orders = spark.range(1200).select(
        F.when(F.col("id") % 3 == 0, F.lit("P0")).otherwise(F.concat(F.lit("P"), (F.col("id") % 40).cast("string")))
         .alias("productid"),
        F.concat(F.lit("S"), (F.col("id") % 4).cast("string")).alias("sellerid"), F.lit("M1").alias("merchantid"),
        F.lit(2016), (F.col("id") % 12 + 1).cast("int"), (F.col("id") % 52 + 1).cast("int"),
        (F.col("id") % 28 + 1).cast("int"), F.lit("x"), F.lit("web"), (F.col("id") * 7 % 4000).cast("double"),
        (F.col("id") % 500).cast("double"), (F.col("id") % 600).cast("double"), (F.col("id") % 9 + 1),
        F.lit(1), (F.col("id") % 7).cast("int")).toDF(*[f.split()[0] for f in ORDER_SCHEMA.split(", ")])
    views = spark.range(900).select(
        F.concat(F.lit("P"), (F.col("id") % 40).cast("string")), F.lit("S1"), F.lit("M1"), F.lit(2016), F.lit(1),
        F.lit(1), F.lit(1), F.concat(F.lit("B"), (F.col("id") % 3).cast("string")), F.lit("web"), F.lit("no"),
        F.lit(1.0), F.lit(1.0), F.lit(1), F.lit(1), (F.col("id") % 11).cast("int"), (F.col("id") % 7).cast("int"),
        (F.col("id") % 5).cast("int"), (F.col("id") % 3).cast("int"), (F.col("id") % 2).cast("int"),
        (F.col("id") % 10).cast("int")).toDF(*[f.split()[0] for f in VIEW_SCHEMA.split(", ")])
    return orders, views


def _over_limit(spark):
    """Settings under which no lookup may be broadcast, so that hot keys must be salted."""
    spark.conf.set("shelfcast.broadcast.maxBytes", "0")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")


def _reset(spark):
    spark.conf.unset("shelfcast.broadcast.maxBytes")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(64 * 1024 * 1024))


def _logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_every_large_lookup_is_salted_over_the_limit(spark):
    """Joins of the order rows in X1, X2 (J3) and the indexed stock table (F2) all carry a salt."""
    from shelfcast.operators.indexing import fit_dictionary, apply_dictionary
    from shelfcast.plans.merchant_features import merchant_features
    from shelfcast.plans.product_features import product_features
    orders, views = _hot_orders_and_views(spark)
    _over_limit(spark)
    try:
        for df, lookups in ((product_features(orders, views), 3), (merchant_features(orders, views), 1),
                            (apply_dictionary(orders, fit_dictionary(orders, ["channel", "year"]),
                                              {"channel": "ci", "year": "yi"}), 2)):
            conditions = [line for line in _logical(df).splitlines() if "Join LeftOuter" in line and "strategy=broadcast" not in line]
            assert len(conditions) == lookups
            assert all("_salt" in line for line in conditions)
    finally:
        _reset(spark)


def test_feature_plan_writes_nothing_fanned_out_and_indexes_the_small_side(spark, monkeypatch):
    from shelfcast.plans import product_features as plan
    import shelfcast.session as session
    orders, views = _hot_orders_and_views(spark)
    written = {}
    write = session._write

    def counted(df, name):
        path = write(df, name)
        written[name] = df.sparkSession.read.parquet(path).count()
        return path
    monkeypatch.setattr(session, "_write", counted)
    df = plan.product_features(orders, views)
    assert max(written.values()) == written["order-summary"] == 1200
    assert df.count() == 3600
    # One join to the statistics, one to the counts; the dictionary joined the statistics before.
    joins = [line for line in _logical(df).splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 2 + 1 and sum("_label" in line for line in joins) == 1


def test_feature_job_with_hot_product_same_on_broadcast_and_salted_paths(spark):
    from shelfcast.plans.product_features import product_features
    orders, views = _hot_orders_and_views(spark)
    broadcast_path = sorted(product_features(orders, views).collect())
    _over_limit(spark)
    try:
        salted_path = sorted(product_features(orders, views).collect())
    finally:
        _reset(spark)
    assert len(broadcast_path) == 1200 * 3     # every product has three brands
    assert salted_path == broadcast_path


def test_one_brand_option_removes_fan_out(spark):
    from shelfcast.plans.product_features import product_features
    orders, views = _hot_orders_and_views(spark)
    assert product_features(orders, views, one_brand=True).count() == 1200


def test_hot_keys_are_found_without_false_ones(spark):
    from shelfcast.operators.joins import hot_keys
    n = 20_000
    frame = spark.range(n).select(
        F.when(F.col("id") % 10 < 3, F.lit("hot")).when(F.col("id") % 10 == 3, F.lit(None))
         .otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("a"), (F.col("id") % 2).alias("b"), "id")
    found = {(r["a"], r["b"]): r["salts"] for r in hot_keys(frame, ["a", "b"], 8).collect()}
    # ids that end in 0 to 2 and 3: ("hot", 0) has a fifth of the rows, ("hot", 1) and (null, 1) a tenth each.
    assert found == {("hot", 0): 2, ("hot", 1): 1, (None, 1): 1}
    assert hot_keys(frame, ["id"], 8) is None
    assert hot_keys(frame.limit(0), ["a"], 8) is None


def test_only_hot_keys_are_salted_and_no_task_is_large(spark):
    """30 % of the rows on one key, the right side over the limit, no session conf: even tasks, equal results."""
    left = spark.range(40_000).select(
        F.when(F.col("id") % 10 < 3, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 3001).cast("string")))
         .alias("key"), F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.lit("x")).alias("other"), "id")
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    right, size = measured(right, "hot-stats")
    wanted = sorted(lookup_join(left, right, ["key"], "left", right_bytes=size).collect(), key=repr)
    _over_limit(spark)
    skew = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = lookup_join(left, right, ["key"], "left", right_bytes=size)
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(
            F.count(F.lit(1)).alias("n")).collect()]
        assert "SortMergeJoin" in _plan(joined)
        assert sorted(joined.collect(), key=repr) == wanted
        # An even share is 5000 of 40000 rows; unsalted, one task would hold 12000 and its share of the rest.
        assert max(sizes) < 11_000
        nulls = lookup_join(left, left.groupBy("other").agg(F.count(F.lit(1)).alias("n")), ["other"], "left",
                            right_bytes=size, null_safe=True)
        assert nulls.where("n is null").count() == 0 and nulls.count() == 40_000
    finally:
        _reset(spark)
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", skew)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_pair_join_rows_counts_what_the_pair_join_yields(spark):
    from shelfcast.operators.joins import pair_join_counts, pair_join_rows
    left = spark.createDataFrame([("m", "p", 1), ("m", "p", 1), ("m", None, 2), ("x", "p", 3), ("m", "q", 4)],
                                 "merchantid string, productid string, v int")
    right = spark.createDataFrame([("m", "p", 9), ("m", "p", 8), ("m", None, 7), ("m", "q", 6), ("z", "p", 5)],
                                  "merchantid string, productid string, w int")
    rows = pair_join_rows(left, right)
    assert sorted(map(tuple, rows.collect())) == [("m", "p", 1, 2), ("m", "p", 1, 2), ("m", "q", 4, 1)]
    pairs = left.join(right, ["merchantid", "productid"]).count()
    assert rows.agg(F.sum("partners")).first()[0] == pairs == pair_join_counts(left, right).agg(F.sum("pairs")).first()[0]


def test_bucketed_tables_need_no_exchange(spark):
    import uuid
    from shelfcast.operators.joins import join_view_stats
    from shelfcast.operators.aggregates import view_stats
    from shelfcast.sources.catalog import drop_table, read_named, save_table
    orders, views = _hot_orders_and_views(spark)
    stats = view_stats(views)
    names = [f"t_{uuid.uuid4().hex}" for _ in range(2)]
    saved, right = save_table(orders, names[0], ["productid"], 4), save_table(stats, names[1], ["productid"], 4)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_view_stats(saved, right)
        assert "Exchange" not in _plan(joined) and "SortMergeJoin" in _plan(joined)
        assert sorted(joined.collect(), key=repr) == sorted(join_view_stats(orders, stats).collect(), key=repr)
        rolled = saved.groupBy("productid", "year", "month").agg(F.sum("productcount").alias("n"))
        assert "Exchange" not in _plan(rolled)
        assert sorted(rolled.collect()) == sorted(orders.groupBy("productid", "year", "month").agg(
            F.sum("productcount").alias("n")).collect())
        assert read_named(spark, names[0], ["productid", "price"]).columns == ["productid", "price"]
    finally:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(64 * 1024 * 1024))
        for name in names:
            drop_table(spark, name)
    assert not spark.catalog.tableExists(names[0])


def test_random_split_does_not_depend_on_the_partitioning(spark):
    from shelfcast.operators.vectors import persisted, random_split
    rows = [(i % 50, None if i % 9 == 0 else f"v{i % 13}", float(i % 5)) for i in range(900)]      # many equal rows
    frame = spark.createDataFrame(rows, "a int, b string, c double")
    parts = [sorted(map(tuple, p.collect()), key=repr) for p in random_split(frame, [0.4, 0.6], seed=11)]
    again = [sorted(map(tuple, p.collect()), key=repr) for p in random_split(frame.repartition(7), [2, 3], seed=11)]
    assert parts == again
    assert sorted(parts[0] + parts[1], key=repr) == sorted(rows, key=repr)
    assert 0.33 < len(parts[0]) / 900 < 0.47
    assert set(parts[0]) & set(parts[1])                              # equal rows are drawn one by one
    other = random_split(frame, [0.4, 0.6], seed=12)[0]
    assert sorted(map(tuple, other.collect()), key=repr) != parts[0]
    with persisted(frame) as kept:
        assert kept.storageLevel.useMemory and kept.count() == 900
    assert not frame.storageLevel.useMemory
    assert sum(p.count() for p in random_split(frame.limit(0), [0.5, 0.5], seed=1)) == 0
