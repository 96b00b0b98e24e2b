"""Corpus pipeline: five stages from raw documents to a weighted training mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes what a stage returns as Parquet in the shared folder and gives the
reread table to the next, so a lost executor costs one stage's tasks at most.

1. ``quality_rules``: failing lines go, and documents that the rules reject.
2. ``line_dedup``: later copies of repeated line runs go, and documents of
   which nothing is left.
3. ``near_dedup``: of documents linked by operator 8's two-word shingles
   (similarity of 0.8 or more) the one with the smallest id stays.  Five-word
   shingles would find few of the near copies that change a word here and there.
4. ``decontamination``: documents that hold a benchmark passage go.
5. ``source_mix``: documents the mix takes, with how often (``copies``).

All but the last return the columns of ``documents``; ``n_chars`` follows the
text.  A stage applies its decisions behind ``_once``, so that a filter on a computed
verdict does not run the rules a second time.

Cases: null text is rejected by the quality rules; rows without an id
are never near copies; rows that repeat an id with another text are documents of
their own (behind all others in the order of ids), and of rows equal in id and
text the one with the least language, source and length stays in stage 3; an
empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.ranking import global_rank
from shelfcast.llm import decontam, line_runs, mixing, near_dup, quality
from shelfcast.llm.common import near, read
from shelfcast.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Bytes of an id in a lookup that may be broadcast.
ID_BYTES = 24


def _documents(docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``documents`` with another text."""
    return docs.select(*[F.col(text).alias("text") if c == "text" else
                         F.length(text).cast("long").alias("n_chars") if c == "n_chars" else F.col(c)
                         for c in COLUMNS])


def _once(found: DataFrame, verdict: Column) -> DataFrame:
    """Rows of ``found`` whose ``verdict`` holds.

    Catalyst pushes a filter below a projection and then computes what both use
    twice; it leaves a projection with a drawn column as it is.
    """
    return found.select("*", F.rand(0).alias("_drawn")).where(verdict & (F.col("_drawn") >= 0)).drop("_drawn")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = quality.with_quality(docs.select(*COLUMNS)).select(*COLUMNS, "cleaned", "kept")
    return _documents(_once(found, F.col("kept")), "cleaned")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_runs.without_repeated_runs(docs.select(*COLUMNS))
    left = F.expr("deduped.n_removed = 0 or deduped.n_removed < deduped.n_lines")
    return _documents(_once(found, left), "deduped.text")


def _nodes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``node``: the id, or a number behind all ids for each text of an id that stands twice."""
    # Ids that repeat, none as a rule.
    again = materialize(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
                            .where("n > 1").select("doc_id"), "near-repeated")
    again = near(again, F.lit(ID_BYTES))
    once = docs.join(again, "doc_id", "left_anti").withColumn("node", F.col("doc_id"))
    texts = docs.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(
        F.min(F.struct("lang", "source", "n_chars")).alias("rest")).select("doc_id", "text", "rest.*")
    last = docs.agg(F.max("doc_id")).first()[0] or 0
    ranked = global_rank(texts, [F.col("doc_id"), F.col("text").asc_nulls_first()], "node")
    return once.unionByName(ranked.withColumn("node", F.col("node").cast("long") + F.lit(last + 1)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    nodes = _nodes(docs.select(*COLUMNS))
    found = near_dup.with_components(nodes.select(F.col("node").alias("doc_id"), "text"), near_dup.QUERY_SHINGLE)
    copies = materialize(found.where(~F.col("kept")).select(F.col("doc_id").alias("node")).distinct(), "near-copies")
    return nodes.join(near(copies, F.lit(ID_BYTES)), "node", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.with_contamination(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))
    return _once(found, F.size("hits.spans") == 0).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.with_size(docs.select(*COLUMNS)), ["doc_id", "text"]).where("copies > 0")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

# Suffix ranks, sketches and the knapsack have no SQL form: tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
