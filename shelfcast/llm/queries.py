"""Registered queries of the training-data operators, one ``opN_<name>`` each.

Every query reads its whole table and returns a full result; the DuckDB twins
of those that SQL can express are in :mod:`shelfcast.llm.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import (alignment, decontam, licenses, line_runs, mixing, near_dup, negatives, pii, quality,
                           secret_scan, suffix_dedup, tokens, url_filter)
from shelfcast.llm.common import read
from shelfcast.session import materialize

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_size(read(spark, sf_dir, "documents"))
    slim = materialize(docs.select("doc_id", "source", "size", F.xxhash64("text").alias("_text")), "mix-sizes")
    return mixing.mix(slim, ["doc_id", "_text"]).drop("_text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.with_token_counts(docs, public_tokenizers.path(tokens.MODEL)).drop("text")


def _spans(spans, base_only: bool = False):
    """kind:start:end of each span, comma-joined, in the array's order."""
    if base_only:
        spans = F.filter(spans, lambda s: s["base"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count("secrets", k) for k in secret_scan.KINDS],
                        F.sha2(_spans("secrets", True), 256).alias("base_sha256"), _spans("secrets").alias("spans"))


def op4_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.with_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("hits.n_words").alias("n_words"), decontam.n_hit().alias("n_hit"),
                        F.size("hits.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
                        (F.size("hits.spans") > 0).alias("contaminated"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (quality.with_quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.without_repeated_runs(docs).select(
        "doc_id", F.col("deduped.n_lines").alias("n_lines"), F.col("deduped.n_removed").alias("n_removed"),
        F.col("deduped.words_removed").alias("words_removed"),
        F.sha2(F.coalesce("deduped.text", F.lit("")), 256).alias("kept_sha256"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.with_licenses(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.with_components(read(spark, sf_dir, "documents").select("doc_id", "text"),
                                    near_dup.QUERY_SHINGLE)


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.without_repeats(docs).select(
        "doc_id", F.col("deduped.n_bytes").alias("n_bytes"), F.col("deduped.n_removed").alias("n_removed"),
        F.col("deduped.n_spans").alias("n_spans"), F.sha2("deduped.kept", 256).alias("kept_sha256"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *[_count("pii", k) for k in pii.KINDS],
                        F.sha2(_spans("pii", True), 256).alias("base_sha256"), _spans("pii").alias("spans"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(spark, read(spark, sf_dir, "documents")).documents()


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(read(spark, sf_dir, "embeddings"), label=negatives.op12_label())


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "score")


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scan": op3_secret_scan,
    "op4_benchmark_hits": op4_benchmark_hits,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_repeated_bytes": op9_repeated_bytes,
    "op10_personal_data": op10_personal_data,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_url_filter": op13_url_filter,
}
