"""Operator 1 — mixing sources to target weights (subset-sum budget fitting).

Every source gets a target in words: the weights share the words of the
whole corpus, no target exceeds ``max_repeat`` times its source, and the
excess is shared again by weight until no target is above its cap.  A
source whose target is at least its size is taken whole ``q`` times; the
rest of its budget is met by documents chosen through their lengths:

1. documents are counted by exact length (one combinable aggregate);
2. each length takes its proportional share of the budget, rounded down;
3. of what is left, the longest lengths first take all but ``FIT_SPAN`` words, and
   these are fitted by a bounded knapsack over the lengths (subset sums as a bit
   set): nothing comes nearer to the budget among the ways to fill the last
   ``FIT_SPAN`` words.  A few documents that are each longer than that may leave
   a gap that another choice of them would close;
4. within a length, the documents with the smallest seeded hash are taken.

Scale: only (source, length) counts meet in one task per source, never
documents.  Ranks inside a length are taken inside hash buckets, so a
length that holds a third of all rows is dealt over ``RANK_BUCKETS`` groups.
The driver sees two scalars per resharing step.

Cases: null text has size 0 and takes nothing; null is a source of its own,
last in order; an empty table gives an empty result; equal rows are separate
documents (ties are broken by the whole sort key, equal rows are
interchangeable); other columns are carried through, and must not be called
``size``, ``source_size``, ``target``, ``copies`` or ``taken`` (those are replaced).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.ranking import global_rank
from shelfcast.llm.common import WORD
from shelfcast.session import materialize

# Contract values.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 20240229
# Groups that one (source, length) is dealt over when its documents are ranked.
RANK_BUCKETS = 256
# Words left to the knapsack after the proportional and the largest-first steps.
FIT_SPAN = 1 << 16

OUTPUTS = ("size", "source_size", "target", "copies", "taken")


def with_size(docs: DataFrame) -> DataFrame:
    """Add ``size``: number of words; null text has none."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) → the same with ``target`` (double), by capped sharing.

    A source is capped when its share of what the uncapped ones divide
    exceeds its cap; capping raises the others' share, so the step repeats
    until no source is newly capped.  Each step is one aggregate.
    """
    ranked = global_rank(totals, [F.col("source").isNull(), F.col("source")], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.col("_rank").cast("long"), F.lit(len(weights))) + 1).cast("int"))
    table = materialize(ranked.select("source", "source_size", weight.cast("decimal(20,0)").alias("_w"),
                                      (F.col("source_size") * max_repeat).cast("decimal(20,0)").alias("_cap")),
                        "mix-sources")
    total, open_weight = table.agg(F.sum("source_size"), F.sum("_w")).first()
    rest, n_capped = total or 0, 0
    while True:
        # share = rest * w / open_weight, compared with the cap in exact integers
        over = F.col("_w") * F.lit(int(rest)) > F.col("_cap") * F.lit(int(open_weight or 0))
        capped, weight_left, n = table.agg(F.sum(F.when(over, F.col("_cap")).otherwise(0)),
                                           F.sum(F.when(over, 0).otherwise(F.col("_w"))),
                                           F.count_if(over)).first()
        if not n or n == n_capped:
            break
        rest, open_weight, n_capped = total - int(capped), int(weight_left), n
    share = F.col("_w").cast("double") * F.lit(float(rest)) / F.lit(float(open_weight or 1))
    return table.select("source", "source_size",
                        F.when(over, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, span: int = FIT_SPAN) -> np.ndarray:
    """Documents to take of each length so that their words come nearest below ``budget``.

    ``counts`` bounds each length.  Longest lengths first bring the budget
    down to ``span``; the rest is a bounded knapsack: bit *s* of an integer
    tells whether *s* words can be reached, each length enters in chunks of
    1, 2, 4, … documents, and the chunk that first reached a sum is kept
    for the way back.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    left = int(budget)
    order = [i for i in np.argsort(-lengths, kind="stable") if lengths[i] > 0]
    for i in order:
        n = min(int(counts[i]), max(0, (left - span) // int(lengths[i])))
        take[i] += n
        left -= n * int(lengths[i])
    reach, mask = 1, (1 << (left + 1)) - 1
    first = np.full(left + 1, -1, dtype=np.int64)
    chunks: list[tuple[int, int]] = []
    for i in order:
        if reach >> left & 1:
            break
        length, free, size = int(lengths[i]), min(int(counts[i] - take[i]), left // int(lengths[i])), 1
        while free > 0:
            m = min(size, free)
            free, size = free - m, size * 2
            new = (reach << (length * m)) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8),
                                     bitorder="little")
                first[np.flatnonzero(bits)] = len(chunks)
                chunks.append((i, m))
                reach |= new
    at = reach.bit_length() - 1
    while at > 0:
        i, m = chunks[first[at]]
        take[i] += m
        at -= m * int(lengths[i])
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", kind="stable", ignore_index=True)
    base = rows["base"].to_numpy(np.int64)
    sizes = rows["size"].to_numpy(np.int64)
    left = int(rows["budget"].iloc[0]) - int((base * sizes).sum())
    extra = fit_lengths(sizes, rows["n"].to_numpy(np.int64) - base, left)
    return rows.assign(take=base + extra)[["source", "size", "take"]]


def mix(docs: DataFrame, order: Sequence[str], weights: Sequence[int] = WEIGHTS,
        max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """Add ``source_size``, ``target``, ``copies`` and ``taken`` to every row of ``docs``.

    ``docs`` has ``source`` and ``size``; ``order`` names the columns that
    identify a document in the seeded order (reruns agree as long as they
    tell documents apart).  ``docs`` is read three times: pass a frame that
    is cheap to read (a written table, narrow where possible).
    """
    docs = docs.drop(*[c for c in OUTPUTS if c != "size"])
    columns = docs.columns
    ticket = F.xxhash64(F.lit(seed), *[F.col(c) for c in order])
    docs = docs.withColumn("_ticket", ticket).withColumn("_bucket", F.pmod(F.col("_ticket"), F.lit(RANK_BUCKETS)))
    counts = materialize(docs.groupBy("source", "size", "_bucket").agg(F.count(F.lit(1)).alias("n")), "mix-counts")

    targets = materialize(source_targets(
        counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
        weights, max_repeat), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    plan = (targets.withColumn("whole", F.least(whole, F.lit(max_repeat)).cast("long"))
                   .withColumn("budget", F.when(F.col("whole") >= max_repeat, 0).otherwise(
                       F.floor("target") - F.col("whole") * F.col("source_size")).cast("long")))

    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n")).withColumnRenamed("source", "_s")
    base = F.when(F.col("source_size") > 0,
                  F.floor(F.col("n").cast("decimal(19,0)") * F.col("budget") / F.col("source_size"))).otherwise(0)
    fitted = (lengths.join(plan, F.col("_s").eqNullSafe(F.col("source")))
                     .select("source", "size", "n", "budget", F.least(base, F.col("n")).cast("long").alias("base"))
                     .groupBy("source").applyInPandas(_fit_source, "source string, size long, take long"))

    # Buckets of a length are filled in order; only the last one is split by rank.
    before = Window.partitionBy("source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = (counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
                   .withColumnRenamed("source", "_s").withColumnRenamed("size", "_z"))
    quota = (quota.join(fitted, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_z") == F.col("size")))
                  .select("_s", "_z", F.col("_bucket").alias("_b"),
                          F.least(F.greatest(F.col("take") - F.col("_before"), F.lit(0)), F.col("n")).alias("_quota")))
    quota = quota.join(plan.withColumnRenamed("source", "_p"), F.col("_s").eqNullSafe(F.col("_p"))).drop("_p", "budget")

    rank = Window.partitionBy("source", "size", "_bucket").orderBy("_ticket", *order)
    return (docs.join(quota, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
                      & (F.col("_bucket") == F.col("_b")))
                .withColumn("copies", F.col("whole") + (F.row_number().over(rank) <= F.col("_quota")).cast("long"))
                .select(*columns, "source_size", "target", "copies",
                        (F.col("size") * F.col("copies")).alias("taken")))
