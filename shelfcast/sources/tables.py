"""Table scans (S1, S2) and the LIBSVM source (S3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Scan one parquet table, optionally projected.

    The projection is a plain ``select`` so Catalyst prunes it into the
    parquet ``ReadSchema``; later filters become ``PushedFilters``.
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns is not None:
        df = df.select(*columns)
    return df


def require_columns(df: DataFrame, contract: Sequence[tuple[str, str]], what: str) -> None:
    """Raise unless ``df`` has every (column, type) of ``contract``; further columns may follow."""
    found = dict(df.dtypes)
    wrong = [f"{name} {kind} (found {found.get(name, 'nothing')})" for name, kind in contract
             if found.get(name) != kind]
    if wrong:
        raise ValueError(f"{what} lacks columns: {', '.join(wrong)}")


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """S3: LIBSVM text (``label idx:value ...``, 1-based indices) → (label, features).

    Pass ``num_features`` on large inputs: without it Spark runs an extra
    pass over the whole file to find the largest index.
    """
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", str(num_features))
    return reader.load(path)


def write_libsvm(df: DataFrame, path: str, label: str = "label",
                 features: str = "features") -> str:
    """Write a (label, vector) frame as LIBSVM text, one file per partition."""
    (df.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features"))
       .write.mode("overwrite").format("libsvm").save(path))
    return path
