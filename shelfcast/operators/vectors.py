"""Feature vectors and splits.

* ``assemble`` — ``VectorAssembler``; nulls raise, so the jobs fill first.
* ``index_vector`` — ``VectorIndexer``: features with ≤ N distinct values
  become categorical.  Its fit aggregates per-partition value sets capped
  at N+1 per feature, so what reaches the driver is bounded by
  features × N, not by rows.
* ``random_split`` — seeded split by row instead of by key: rows are ranked
  under a total order and the draw is a hash of seed and rank, so equal rows
  fall apart and the result is the same after any ``repartition``.
* ``split`` — deterministic train/test split from an md5 bucket of the row
  key: independent of partitioning, so recomputing a lost partition puts
  every row on the same side again (``randomSplit`` is only reproducible
  for an identical partitioning).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler, VectorIndexer, VectorIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.columns import key_bucket
from shelfcast.functions.ranking import global_rank


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    """columns → one dense/sparse vector column (ML attributes carried along)."""
    return VectorAssembler(inputCols=list(columns), outputCol=out,
                           handleInvalid=handle_invalid).transform(df)


def vector_columns(df: DataFrame, col: str, n: int, prefix: str = "f",
                   keep: Sequence[str] = ()) -> DataFrame:
    """Expand a vector into scalar columns ``f00 .. f{n-1}`` (for SQL comparison)."""
    arr = vector_to_array(F.col(col))
    return df.select(*keep, *[arr[i].alias(f"{prefix}{i:02d}") for i in range(n)])


def fit_vector_indexer(df: DataFrame, col: str = "features", out: str = "indexedfeatures",
                       max_categories: int = 20, handle_invalid: str = "error") -> VectorIndexerModel:
    """fit the categorical-feature detector (≤ ``max_categories`` distinct → categorical)."""
    return VectorIndexer(inputCol=col, outputCol=out, maxCategories=max_categories,
                         handleInvalid=handle_invalid).fit(df)


def vector_category_report(model: VectorIndexerModel) -> list[tuple[int, bool, int]]:
    """(feature, is_categorical, number of categories) for every feature of a fitted indexer."""
    maps = model.categoryMaps
    return [(i, i in maps, len(maps.get(i, {}))) for i in range(model.numFeatures)]


def with_split(df: DataFrame, keys: Sequence[str], train: float = 0.7, seed: int | None = None,
               out: str = "split") -> DataFrame:
    """tag rows ``train`` / ``test`` by md5 bucket of ``keys`` (and ``seed``)."""
    bucket = key_bucket(keys, 100, seed)
    return df.withColumn(out, F.when(bucket < F.lit(int(round(train * 100))), F.lit("train"))
                              .otherwise(F.lit("test")))


def split(df: DataFrame, keys: Sequence[str], train: float = 0.7,
          seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) frames; ``train`` is the fraction in percent buckets."""
    tagged = with_split(df, keys, train, seed, "_split")
    return (tagged.where(F.col("_split") == "train").drop("_split"),
            tagged.where(F.col("_split") == "test").drop("_split"))


# Draws per unit of weight in a random split.
DRAWS = 1_000_000


def random_split(df: DataFrame, weights: Sequence[float], seed: int, order: Sequence[str] | None = None) -> list[DataFrame]:
    """F5/F6, second form: one frame per weight, rows drawn one by one.

    ``order`` (default: all columns) must order the rows totally but for equal
    ones; which of several equal rows falls where makes no difference.  The
    ranked frame is written once, so all parts read the same ranks.
    """
    columns = df.columns
    # Nulls first, as any other value.
    ranked = global_rank(df, [F.col(c).asc_nulls_first() for c in (order or columns)], "_rank")
    drawn = ranked.withColumn("_rank", F.col("_rank").cast("long"))
    drawn = drawn.withColumn("_draw", key_bucket(["_rank"], DRAWS, seed))
    total, low, parts = sum(weights), 0, []
    for i, w in enumerate(weights):
        high = DRAWS if i == len(weights) - 1 else round(DRAWS * sum(weights[:i + 1]) / total)
        parts.append(drawn.where((F.col("_draw") >= low) & (F.col("_draw") < high)).select(*columns))
        low = high
    return parts


@contextmanager
def persisted(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` kept in memory (or on disk) for the repeated scans inside, given back at the end.

    A lost executor costs the recomputation of its blocks; what must survive
    without recomputation is written with ``materialize`` instead.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
