"""Generic operators: ranking, cleansing, joins, sink, split, metrics, learners, LIBSVM."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfcast.functions.ranking import global_rank
from shelfcast.operators.clean import replace_blank
from shelfcast.operators.joins import join_null_safe, pair_join_counts
from shelfcast.operators.learners import forest_regressor, param_grid
from shelfcast.operators.metrics import classification_metrics, regression_metrics
from shelfcast.operators.vectors import split, with_split
from shelfcast.session import shared_dir
from shelfcast.sources.sinks import dedupe_latest, read_features, write_features
from shelfcast.sources.tables import read_libsvm


def test_global_rank_equals_row_number(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 50), f"k{i:04d}") for i in range(2000)]
    df = spark.createDataFrame(rows, "c int, k string").repartition(7)
    ours = {r.k: r.rank for r in global_rank(df, [F.col("c").desc(), F.col("k")]).collect()}
    w = Window.orderBy(F.col("c").desc(), F.col("k"))
    ref = {r.k: float(r.rn - 1) for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert ours == ref


def test_replace_blank_leaves_nulls(spark):
    df = spark.createDataFrame([("", None, ""), ("a", "", None)], "brand string, channel string, productid string")
    got = sorted(replace_blank(df).collect(), key=str)
    assert got == sorted([("NULL", None, "-999"), ("a", "NULL", None)], key=str)


def test_null_safe_join_matches_nulls(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    got = sorted(join_null_safe(left, right, ["k"]).collect(), key=str)
    assert got == sorted([(None, 1, 10), ("a", 2, 20)], key=str)
    plain = left.join(right, "k", "left").collect()
    assert sorted(r.y for r in plain if r.y is not None) == [20]


def test_pair_join_counts_equals_brute_force(spark):
    rnd = random.Random(5)
    left = spark.createDataFrame([(rnd.choice("ab"), rnd.choice("xyz")) for _ in range(200)], "m string, p string")
    right = spark.createDataFrame([(rnd.choice(["a", "b", None]), rnd.choice("xy")) for _ in range(150)],
                                  "m string, p string")
    brute = left.join(right, ["m", "p"]).groupBy("m", "p").count()
    ours = pair_join_counts(left, right, ("m", "p"))
    assert sorted(brute.collect()) == sorted(ours.collect())


def test_upsert_new_batch_wins_and_rerun_is_idempotent(spark):
    root = f"{shared_dir(spark)}/upsert_test_{random.randrange(10**9)}"
    first = spark.createDataFrame([("P1", 2016, 1.0), ("P1", 2016, 2.0), ("P2", 2017, 5.0)],
                                  "productid string, year int, v double")
    assert write_features(first, root, ["productid", "year"], ["year"]) == 2
    assert sorted(read_features(spark, root).select("productid", "year", "v").collect()) == \
        sorted([("P1", 2016, 2.0), ("P2", 2017, 5.0)])
    second = spark.createDataFrame([("P1", 2016, 0.5), ("P3", 2016, 1.0)], "productid string, year int, v double")
    write_features(second, root, ["productid", "year"], ["year"])
    write_features(second, root, ["productid", "year"], ["year"])
    # 2017 was not touched by the second batch and is left as it was.
    assert sorted(read_features(spark, root).select("productid", "year", "v").collect()) == \
        sorted([("P1", 2016, 0.5), ("P3", 2016, 1.0), ("P2", 2017, 5.0)])


def test_dedupe_latest_is_argmax_per_key(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "c")], "key string, b int, v string")
    assert sorted(dedupe_latest(df, ["key"], "b").collect()) == sorted([("j", "c"), ("k", "b")])


def test_split_is_deterministic_and_close_to_fraction(spark):
    df = spark.range(5000).withColumn("k", F.col("id").cast("string"))
    train, test = split(df, ["k"], 0.7)
    n_train = train.count()
    assert 3300 < n_train < 3700 and n_train + test.count() == 5000
    again = with_split(df.repartition(3), ["k"], 0.7).where("split = 'train'")
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in train.collect())


def test_regression_metrics_fixture_values(spark):
    pred = spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (4.0, 3.0)], "label double, prediction double")
    m = regression_metrics(pred, with_range=True).first()
    assert abs(m.rmse - 0.8660254) < 1e-7 and abs(m.mae - 0.8333333) < 1e-7
    assert abs(m.r2 - 0.5178571) < 1e-7 and abs(m.nrmse - 0.8660254) < 1e-7


def test_nrmse_is_null_for_constant_predictions(spark):
    pred = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    assert regression_metrics(pred, with_range=True).first().nrmse is None


def test_classification_metrics(spark):
    pred = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (2.0, 2.0)], "label double, prediction double")
    m = classification_metrics(pred).first()
    assert m.accuracy == 0.75 and m.test_error == 0.25


def test_param_grid_depths():
    rf = forest_regressor()
    grid = param_grid(rf, {"maxDepth": [4, 8, 10]})
    assert [list(g.values())[0] for g in grid] == [4, 8, 10]


def test_libsvm_source_reads_one_based_indices(spark, tmp_path):
    path = tmp_path / "sample.txt"
    path.write_text("24.0 1:0.00632 2:18 4:0\n21.6 1:0.02731 3:7.07\n")
    rows = read_libsvm(spark, str(path), num_features=4).collect()
    assert [r.label for r in rows] == [24.0, 21.6]
    assert rows[0].features.toArray().tolist() == [0.00632, 18.0, 0.0, 0.0]
    assert rows[1].features.toArray().tolist() == [0.02731, 0.0, 7.07, 0.0]


def test_missing_inputs_give_null_if_asked_for(spark):
    import pytest
    from shelfcast.functions.columns import with_relative_price, with_scores, with_stock_flag
    rows = [(1, 1, 1, 1, 1, 1500.0, 5), (-999, 1, 1, 1, 1, -999.0, -999), (1, 1, None, 1, 1, None, None)]
    df = spark.createDataFrame(rows, "scorefive int, scorefour int, scorethree int, scoretwo int, scoreone int, "
                                     "price double, stock int")
    out = with_stock_flag(with_relative_price(with_scores(df, missing="null"), missing="null"), missing="null")
    assert [(r.scores, r.relativeprice, r.stock) for r in out.collect()] == [(15, 1.0, 1.0)] + [(None, None, None)] * 2
    kept = with_stock_flag(with_relative_price(with_scores(df)))
    assert [(r.scores, r.relativeprice, r.stock) for r in kept.collect()][1] == (-999 * 5 + 10, 0.0, 0.0)
    with pytest.raises(ValueError):
        with_scores(df, missing="drop")
