"""The keyed upsert on awkward partitions, failures, and re-runs."""

import glob
import os
import uuid

import pytest
from pyspark.sql import functions as F

from shelfcast.session import shared_dir
from shelfcast.sources.sinks import read_features, write_features

SCHEMA = "k string, p string, v double"


@pytest.fixture
def root(spark):
    return f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"


def _write(spark, root, rows, schema=SCHEMA):
    return write_features(spark.createDataFrame(rows, schema), root, ["k", "p"], ["p"])


def _files(root, p):
    return sorted(glob.glob(f"{root.removeprefix('file:')}/_p_p={p}/*.parquet"))


def _read(spark, root):
    return sorted(map(tuple, read_features(spark, root).collect()), key=repr)


def test_null_partition_keeps_its_rows(spark, root):
    _write(spark, root, [("A", None, 1.0), ("B", "2016", 2.0)])
    assert _write(spark, root, [("C", None, 3.0)]) == 2
    assert _read(spark, root) == sorted([("A", None, 1.0), ("B", "2016", 2.0), ("C", None, 3.0)], key=repr)


def test_number_like_and_blank_partitions_come_back_as_written(spark, root):
    rows = [("A", "007", 1.0), ("A", "7", 2.0), ("A", "", 3.0), ("A", None, 4.0)]
    _write(spark, root, rows)
    _write(spark, root, [("A", "007", 9.0), ("A", "", 8.0)])
    assert _read(spark, root) == sorted([("A", "007", 9.0), ("A", "7", 2.0), ("A", "", 8.0), ("A", None, 4.0)], key=repr)


def test_new_batch_wins_and_untouched_partitions_stay_as_files(spark, root):
    _write(spark, root, [("A", "x", 9.0), ("B", "x", 1.0), ("Z", "y", 5.0)])
    before = _files(root, "y")
    assert _write(spark, root, [("A", "x", 2.0), ("C", "x", 3.0)]) == 3
    assert _read(spark, root) == [("A", "x", 2.0), ("B", "x", 1.0), ("C", "x", 3.0), ("Z", "y", 5.0)]
    assert _files(root, "y") == before
    _write(spark, root, [("A", "x", 2.0), ("C", "x", 3.0)])           # a re-run changes nothing
    assert _read(spark, root) == [("A", "x", 2.0), ("B", "x", 1.0), ("C", "x", 3.0), ("Z", "y", 5.0)]


def test_unreadable_file_raises_and_nothing_is_lost(spark, root):
    _write(spark, root, [("A", "x", 1.0), ("Z", "y", 5.0)])
    path = _files(root, "y")[0]
    whole = open(path, "rb").read()
    os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
    with open(path, "wb") as f:
        f.write(b"not parquet")
    with pytest.raises(Exception):
        read_features(spark, root).collect()
    with pytest.raises(Exception):
        _write(spark, root, [("B", "y", 2.0)])
    with open(path, "wb") as f:
        f.write(whole)
    assert _read(spark, root) == [("A", "x", 1.0), ("Z", "y", 5.0)]


def test_failing_batch_leaves_the_table_as_it_was(spark, root):
    _write(spark, root, [("A", "x", 1.0), ("Z", "y", 5.0)])
    before = _files(root, "x") + _files(root, "y")
    batch = spark.createDataFrame([("B", "x", 2.0), ("C", "y", 0.0)], SCHEMA).withColumn(
        "v", F.when(F.col("k") == "C", F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        write_features(batch, root, ["k", "p"], ["p"])
    assert _files(root, "x") + _files(root, "y") == before
    assert _read(spark, root) == [("A", "x", 1.0), ("Z", "y", 5.0)]


def test_empty_batches(spark, root):
    assert _write(spark, root, []) == 0
    assert read_features(spark, root) is None
    _write(spark, root, [("A", "x", 1.0)])
    assert _write(spark, root, []) == 0
    assert _read(spark, root) == [("A", "x", 1.0)]


def test_missing_table_reads_as_none(spark, root):
    assert read_features(spark, root) is None
