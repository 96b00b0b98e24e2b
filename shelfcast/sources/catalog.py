"""S1 as named tables: session-catalog tables bucketed by the join and rollup key.

A table that several jobs join or roll up by one key is saved once with its
rows hashed into buckets of that key (``bucketBy``) and sorted within them.
Jobs that group by the key (or by more columns that include it), or join two
tables of equally many buckets on it, then need no exchange: the shuffle was
paid at save time.  The files lie in the shared folder; the catalog holds
the table's name, schema and bucketing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import shared_dir


def save_table(df: DataFrame, name: str, bucket_by: Sequence[str], buckets: int | None = None,
               sort_by: Sequence[str] | None = None) -> DataFrame:
    """Save ``df`` as the catalog table ``name``, bucketed by ``bucket_by``, and return it as read back.

    Rows are dealt by the bucket key before they are written, so a bucket is
    one file per task that holds rows of it.  A hot key makes a large bucket;
    tables whose key is hot are better left to the salted lookup.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}"
    (df.repartition(buckets, *[F.col(c) for c in bucket_by])
       .write.mode("overwrite").option("path", path)
       .bucketBy(buckets, *bucket_by).sortBy(*(sort_by or bucket_by)).saveAsTable(name))
    return read_named(spark, name)


def read_named(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan of a catalog table, with ``columns`` pruned into the scan."""
    table = spark.table(name)
    return table.select(*columns) if columns else table


def drop_table(spark: SparkSession, name: str) -> None:
    """Forget the table; its files belong to the shared folder."""
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
