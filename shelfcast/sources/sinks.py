"""Feature-table sink: reshaping (S5) and keyed upsert.

The original target is a key-value table where a save upserts: rows that
share the primary key collapse and the last writer wins.  On parquet that
becomes a partitioned table whose partition columns are part of the key,
so every key lives in exactly one partition:

    <root>/_p_year=…/_p_month=…/part-*.parquet

An upsert reads the partitions its batch touches, keeps one row per key
(new batch first, then a stated total order over the other columns), writes
the merged rows to the shared folder and from there replaces the touched
partitions by Spark's dynamic partition overwrite; other partitions keep their
files.  Whatever fails before that last copy leaves the table as it was; if
the copy itself is cut off, the merged rows are repeated by running the same
batch again (upserting it twice changes nothing).  One upsert at a time, as
with any overwrite.

The semi join on partition values is null-safe, and the real key columns stay
inside the files (the folder names are only an address), so null, blank or
number-like partition values come back as they were written.  Cost is
proportional to the touched partitions.  The arg-max (``max(struct(...))``)
is aggregated map-side, so a hot key never piles its rows into one task; as
structs have no fixed size Spark runs it as a sort aggregate, i.e. each map
partition is sorted by key first.  So ``narrow_to_greatest`` first drops, by
hash-aggregated maxima of the leading numbers, the rows that cannot win.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfcast.fixed import (MERCHANT_ORDER_CONTRACT, MERCHANT_ORDER_KEYS, PRODUCT_ORDER_CONTRACT,
                             PRODUCT_ORDER_KEYS, PRODUCT_ORDER_MONTHLY_EXTRA)
from shelfcast.session import broadcast_limit, has_folders, materialize, measured, scratch_folder

ADDRESS = "_p_"          # prefix of the folder-name copies of the partition columns


def to_sink_schema(df: DataFrame, contract: Sequence[str | tuple[str, str]]) -> DataFrame:
    """Rename and order columns to the sink contract — by name, never by position.

    Entries are either a column name or ``(sink_name, source_column)``;
    sink names are lower-cased.
    """
    cols = []
    for item in contract:
        sink, source = (item, item) if isinstance(item, str) else item
        cols.append(F.col(source).alias(sink.lower()))
    return df.select(*cols)


def dedupe_latest(df: DataFrame, keys: Sequence[str], batch_col: str | None = None) -> DataFrame:
    """One row per key: highest ``batch_col`` first, then the greatest remaining columns
    in their listed order (nulls lowest)."""
    payload = [c for c in df.columns if c not in keys and c != batch_col]
    ordered = ([F.col(batch_col)] if batch_col else []) + [F.col(c) for c in payload]
    best = df.groupBy(*keys).agg(F.max(F.struct(*ordered)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload])


# Leading payload columns by whose maxima a batch is narrowed, and the memory of one value of a broadcast row.
NARROWED = 2
VALUE_BYTES = 32


def narrow_to_greatest(df: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The rows that hold the greatest leading ``payload`` values of their key: all that an arg-max can choose.

    The maximum of a number is hash-aggregated map-side without sorting, so a batch
    with many rows per key shrinks by streaming instead of by the arg-max's sort
    (and its spill).  Only numbers are maximised, and only maxima that take at
    most the broadcast limit (rows counted) are used; else the rows stay as they are.
    """
    numbers = ("double", "float", "long", "int", "short", "byte", "bigint", "smallint", "tinyint")
    types, best, done = dict(df.dtypes), None, []
    for c in payload[:NARROWED]:
        if types[c] not in numbers:
            break
        left = df if best is None else _greatest(df, best, [*keys, *done])
        found = materialize(left.groupBy(*keys).agg(*[F.max(x).alias(x) for x in (*done, c)]), "sink-maxima")
        if found.count() * (len(keys) + len(done) + 1) * VALUE_BYTES > broadcast_limit(df.sparkSession):
            break
        best, done = found, [*done, c]
    return df if best is None else _greatest(df, best, [*keys, *done])


def _greatest(df: DataFrame, best: DataFrame, columns: Sequence[str]) -> DataFrame:
    named = best.toDF(*[f"_best_{c}" for c in best.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_best_{c}")) for c in columns])
    return df.join(F.broadcast(named), same, "left_semi")


def _address(partition_by: Sequence[str]) -> list:
    # Spark stores null and the empty string under the same folder name.
    return [F.nullif(F.col(c).cast("string"), F.lit("")).alias(f"{ADDRESS}{c}") for c in partition_by]


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]):
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def _table(spark: SparkSession, root: str) -> DataFrame | None:
    """The table with its address columns, folder names read as the strings they are; ``None`` without rows."""
    if not has_folders(spark, root, ADDRESS):
        return None
    schema = StructType([StructField(f.name, StringType()) if f.name.startswith(ADDRESS) else f
                         for f in spark.read.parquet(root).schema])
    return spark.read.schema(schema).parquet(root)


def read_features(spark: SparkSession, root: str) -> DataFrame | None:
    """Read the feature table; ``None`` when nothing was written yet.  Any other failure raises."""
    table = _table(spark, root)
    return None if table is None else table.drop(*[c for c in table.columns if c.startswith(ADDRESS)])


def write_features(df: DataFrame, root: str, keys: Sequence[str],
                   partition_by: Sequence[str] = ("year", "month")) -> int:
    """Upsert ``df`` into the partitioned table at ``root``; returns rows written."""
    missing = [c for c in partition_by if c not in keys]
    if missing:
        raise ValueError(f"partition columns {missing} must be part of the key")
    spark = df.sparkSession
    address = [f"{ADDRESS}{c}" for c in partition_by]
    with scratch_folder(spark):
        table = _table(spark, root)
        payload = [c for c in df.columns if c not in keys]
        df = narrow_to_greatest(df, keys, payload)
        batch = df.withColumn("_batch", F.lit(1))
        if table is not None:
            # One row per key, for its partitions and for its rows.
            new = materialize(dedupe_latest(df, keys).select(*df.columns), "upsert-batch")
            # One row per touched partition folder: measured, and broadcast it prunes the scan of the table.
            touched, size = measured(new.select(*_address(partition_by)).distinct(), "sink-partitions")
            small = F.broadcast(touched) if size <= broadcast_limit(spark) else touched
            old = table.join(small, _same(table, touched, address), "left_semi").select(*df.columns)
            batch = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
        merged = dedupe_latest(batch, keys, "_batch").select(*df.columns, *_address(partition_by))
        if table is not None:
            merged = materialize(merged, "upsert-merged")    # a table cannot be read while it is replaced
        # REBALANCE clusters rows by partition value (few files per partition
        # folder) while AQE splits a hot partition over several tasks and
        # coalesces small ones.
        (merged.hint("rebalance", *address).write.mode("overwrite")
               .option("partitionOverwriteMode", "dynamic").partitionBy(*address).parquet(root))
        return merged.count() if table is not None else (read_features(spark, root) or df.limit(0)).count()


__all__ = ["MERCHANT_ORDER_CONTRACT", "MERCHANT_ORDER_KEYS", "PRODUCT_ORDER_CONTRACT", "PRODUCT_ORDER_KEYS",
           "PRODUCT_ORDER_MONTHLY_EXTRA", "dedupe_latest", "read_features", "to_sink_schema", "write_features"]
