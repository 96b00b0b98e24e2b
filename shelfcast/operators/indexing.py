"""Category indexing (F1, F2, L2): label → 0-based rank by descending frequency.

Same result as ``StringIndexer(stringOrderType="frequencyDesc")`` (ties in
alphabetical order of the label's string form, numeric inputs ranked as
strings), but built as Spark jobs instead of a driver-side label array:

* label counts for *all* indexed columns come from one pass: each row is
  exploded into (column, label) pairs and counted with a partial
  aggregate, so a hot label is reduced map-side.  The count table (one row
  per distinct label) is checkpointed — this is the "fit";
* ranks come from :func:`shelfcast.functions.ranking.global_rank` over the
  count table (no single-task window, no collect of labels);
* the dictionary is joined back per column; it has one row per distinct
  label, measured by the fit, and is broadcast only when its bytes are
  within the session's broadcast limit (else a regular or salted join).

With ``nominal=True`` the output columns carry ML nominal-attribute
metadata (``num_vals``), so tree learners treat them as categorical.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.ranking import global_rank
from shelfcast.operators.joins import lookup_join
from shelfcast.session import materialize


# Bytes of a dictionary row in memory beside its label.
ROW_BYTES = 64


@dataclass
class Dictionary:
    """A fit: (column, label, count, index) rows, and per column the labels and the bytes they take."""
    rows: DataFrame
    n_labels: dict[str, int]
    bytes: dict[str, int]

    def index_of(self, column: str, label: str) -> float | None:
        row = self.rows.where((F.col("column") == column) & (F.col("label") == label)).select("index").first()
        return None if row is None else row["index"]


def label_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, label, count) of the non-null labels: one pass, counted map-side."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label"))
        for c in columns]))
    return (df.select(pairs.alias("p")).select("p.column", "p.label").where(F.col("label").isNotNull())
              .groupBy("column", "label").agg(F.count(F.lit(1)).alias("count")))


def dictionary_of(counts: DataFrame) -> Dictionary:
    """Rank the labels of each column by (column, label, count) rows."""
    # Written once by the ranking: the sort samples its input and then reads it.
    counts = materialize(counts, "label-counts")
    ranked = global_rank(counts, [F.col("column"), F.col("count").desc(), F.col("label")], "_g")
    # One row per indexed column.
    sizes = {r["column"]: r for r in counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("label")).alias("bytes")).collect()}
    first, offsets = 0, []
    for c in sorted(sizes):             # the rank orders columns the same way
        offsets.append((c, first))
        first += sizes[c]["n"]
    # The ranked table is written; subtracting a column's offset (one row per
    # column) needs no further copy of it.
    starts = counts.sparkSession.createDataFrame(offsets, "column string, _first long")
    rows = (ranked.join(F.broadcast(starts), "column")
                  .select("column", "label", "count", (F.col("_g") - F.col("_first")).alias("index")))
    return Dictionary(rows, {c: int(r["n"]) for c, r in sizes.items()},
                      {c: int(r["bytes"]) + ROW_BYTES * int(r["n"]) for c, r in sizes.items()})


def fit_dictionary(df: DataFrame, columns: Iterable[str]) -> Dictionary:
    """Fit: labels of every input column ranked by frequency."""
    return dictionary_of(label_counts(df, columns))


def apply_dictionary(df: DataFrame, dictionary: Dictionary, columns: Mapping[str, str],
                     nominal: bool = False) -> DataFrame:
    """Transform: attach ``columns[c]`` for each input column (null label → null index).

    Every lookup is a size-checked :func:`lookup_join`: small dictionaries
    are broadcast, so the data side is never shuffled by a low-cardinality
    key; larger ones can be salted.
    """
    out = df
    for c, target in columns.items():
        lookup = (dictionary.rows.where(F.col("column") == c)
                            .select(F.col("label"), F.col("index").alias(target)))
        keyed = out.withColumn("_label", F.col(c).cast("string"))
        out = lookup_join(keyed, lookup, [("_label", "label")], "left",
                          right_bytes=dictionary.bytes.get(c, 0)).drop("_label")
        if nominal:
            out = with_nominal(out, target, dictionary.n_labels.get(c, 0))
    return out


def with_nominal(df: DataFrame, column: str, n_labels: int) -> DataFrame:
    """Attach nominal-attribute metadata, so tree learners treat ``column`` as categorical."""
    meta = {"ml_attr": {"type": "nominal", "num_vals": int(n_labels), "name": column}}
    return df.withColumn(column, F.col(column).alias(column, metadata=meta))


def index_categories(df: DataFrame, columns: Mapping[str, str], nominal: bool = False) -> DataFrame:
    """add ``columns[c]`` = frequency rank of ``c`` for every input column."""
    return apply_dictionary(df, fit_dictionary(df, columns), columns, nominal)


def index_category(df: DataFrame, col: str, out: str, nominal: bool = False) -> DataFrame:
    """single-column form of :func:`index_categories`."""
    return index_categories(df, {col: out}, nominal=nominal)
