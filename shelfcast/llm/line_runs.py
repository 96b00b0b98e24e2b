"""Operator 6 — line dedup: repeated line runs by distributed prefix doubling.

A run of lines with at least ``MIN_WORDS`` words that also starts at an earlier
position (document after document by doc_id, nulls last; copies may overlap) is
deleted with all its lines; first copies stay.

1. *Prefix doubling.*  A line that occurs twice gets its rank among all
   such lines; the rank of the 2ᵏ⁺¹ lines from a position is that of the pair
   (rank of the first 2ᵏ, rank of the next 2ᵏ) among all repeated pairs, sorted
   over all tasks.  Positions without a copy at one depth drop out of the next.
   The ranks are the suffix array of the repeated suffixes, as deep as needed.
2. *Common-prefix intervals.*  Suffixes that share a prefix of n lines stand
   together in that order; two overlapping 2ᵏ ranks, at its start and at its
   end, name such an interval for any n.  Of an interval whose prefix has
   ``MIN_WORDS`` words every suffix but the one that starts first is a later copy.
3. *Cuts.*  Intervals need no depth beyond the least that has the words: a
   window is shortest if it has them and loses them without its first or without
   its last line.  Every line of a maximal repeated run lies in a shortest
   window of that run (the one that starts there if enough words follow, else
   the one that ends there, else the one from the run's first line), and a window
   inside a repeated run repeats as well.  So the lines of the shortest windows
   with an earlier copy are exactly those of all maximal repeated runs,
   whatever their lengths and wherever their parts occur first.  Each line has a
   word, so ``log2(MIN_WORDS)`` doublings reach every one of them.

Scale: ranks and first copies are aggregates that combine before the shuffle,
so a line or passage that a third of all documents share is one row of them;
rank tables are written, and broadcast only if measured small, else joined by
a shuffle whose large keys adaptive execution splits; windows run inside one
document.  Nothing but partition sizes reaches the driver.

Cases: null and empty text have no lines and stay as they are; lines without a
word are neither counted nor deleted; rows that are equal in id and text count
as one document and get the same result; other columns are carried through,
whatever their names (but ``deduped``, which is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shelfcast.functions.ranking import global_rank
from shelfcast.llm.common import near, text_or_empty
from shelfcast.session import materialize

# Words that a repeated run must have to be deleted.
MIN_WORDS = 8

LINES = "array<struct<line:int,words:int,h1:long,h2:long>>"
WINDOWS = "array<struct<from:int,to:int,first_rank:long,last_rank:long>>"
# Bytes that a rank and its key take in a task.
RANK_BYTES = 32


def lines_with_words(text: str) -> list[tuple[int, bytes, int]]:
    """(line number, line without outer white space, words) of the lines that have words."""
    out = []
    for at, line in enumerate(text.encode().split(b"\n")):
        n = len(line.split())
        if n:
            out.append((at, line.strip(), n))
    return out


def shortest_windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """[from, to] of the windows with the words that lack them without the first or without the last line."""
    out, lo, n = set(), 0, 0
    for at, w in enumerate(words):                           # the latest start for each end
        n += w
        while n - words[lo] >= min_words and lo < at:
            n -= words[lo]
            lo += 1
        if n >= min_words:
            out.add((lo, at))
    hi, n = len(words) - 1, 0
    for at in range(len(words) - 1, -1, -1):                 # the earliest end for each start
        n += words[at]
        while n - words[hi] >= min_words and hi > at:
            n -= words[hi]
            hi -= 1
        if n >= min_words:
            out.add((at, hi))
    return sorted(out)


def _lines(text: Column) -> Column:
    """Per line with words: its ordinal, words and 128-bit id."""
    @pandas_udf(LINES)
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = []
            for text in texts:
                row = []
                for k, (_, line, n) in enumerate(lines_with_words(text)):
                    h = xxhash.xxh128_intdigest(line)
                    row.append({"line": k, "words": n, "h1": (h >> 64) - 2 ** 63, "h2": h % 2 ** 64 - 2 ** 63})
                rows.append(row)
            yield pd.Series(rows, dtype=object)
    return make(text)


def _windows(ranks: Column, min_words: int) -> Column:
    """Shortest windows over (level, line, words, rank) of one document, each named by its two overlapping ranks."""
    @pandas_udf(WINDOWS)
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for documents in batches:
            rows = []
            for entries in documents:
                rank = {(e["level"], e["line"]): e["rank"] for e in entries}
                words = {e["line"]: e["words"] for e in entries if e["level"] == 0}
                row, run = [], []
                for line in [*sorted(words), None]:
                    if run and line != run[-1] + 1:           # repeated lines one after the other
                        for lo, hi in shortest_windows([words[x] for x in run], min_words):
                            level = (hi - lo + 1).bit_length() - 1
                            first = rank.get((level, run[lo]))
                            last = rank.get((level, run[hi] - (1 << level) + 1))
                            if first is not None and last is not None:
                                row.append({"from": run[lo], "to": run[hi], "first_rank": first, "last_rank": last})
                        run = []
                    run.append(line)
                rows.append(row)
            yield pd.Series(rows, dtype=object)
    return make(ranks)


def _cut(text: Column, runs: Column) -> Column:
    """The text without the lines of ``runs`` ([from, to] ordinals), and the counts."""
    @pandas_udf("struct<text:string,n_lines:long,n_removed:long,words_removed:long>")
    def make(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in batches:
            rows = []
            for text, row in zip(texts, spans):
                lines = lines_with_words(text)
                gone = {k for s in (row if row is not None else ()) for k in range(s["from"], s["to"] + 1)}
                kept = text
                if gone:
                    drop = {lines[k][0] for k in gone}
                    kept = "\n".join(x for at, x in enumerate(text.split("\n")) if at not in drop)
                rows.append((kept, len(lines), len(gone), sum(lines[k][2] for k in gone)))
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_removed", "words_removed"])
    return make(text, runs)


def _ranked(positions: DataFrame, key: list[str], name: str) -> DataFrame:
    """(``key``, place) of the keys that stand at two positions or more, in their sorted order."""
    repeated = materialize(positions.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), name)
    ranked = global_rank(repeated, [F.col(k) for k in key], "place")
    return materialize(ranked.select(*key, F.col("place").cast("long").alias("place")), name)


def suffix_ranks(lines: DataFrame, depth: int) -> list[DataFrame]:
    """Prefix doubling over (doc_id, th, line, words, h1, h2): per level k the positions whose 2ᵏ lines occur elsewhere
    as well, (doc_id, th, line, words, rank), as long as 2ᵏ is at most ``depth``."""
    where = ["doc_id", "th", "line", "words"]
    names = _ranked(lines, ["h1", "h2"], "line-ranks")
    levels = [materialize(lines.join(near(names, F.lit(RANK_BYTES)), ["h1", "h2"])
                          .select(*where, F.col("place").alias("rank")), "line-level")]
    while 2 ** len(levels) <= depth:
        step = 2 ** (len(levels) - 1)
        # The frame holds the one position that many lines on, if it is still there.
        ahead = Window.partitionBy("doc_id", "th").orderBy("line").rangeBetween(step, step)
        pairs = materialize(levels[-1].withColumn("next", F.first("rank").over(ahead)).where("next is not null"),
                            "line-pairs")
        names = _ranked(pairs, ["rank", "next"], "line-ranks")
        levels.append(materialize(pairs.join(near(names, F.lit(RANK_BYTES)), ["rank", "next"])
                                       .select(*where, F.col("place").alias("rank")), "line-level"))
    return levels


def repeated_runs(windows: DataFrame) -> DataFrame:
    """(doc_id, th, runs) of the documents that lose lines; ``windows`` has a row per window."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "from")
    name = ["lines", "first_rank", "last_rank"]
    # Written first: a join with the aggregate itself would share its partitioning, and a window that
    # many documents have could then not be split over tasks.
    repeated = materialize(windows.groupBy(*name).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                                  .where("n > 1").drop("n"), "line-windows-repeated")
    later = windows.join(repeated, name).where(place != F.col("first"))
    return later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("from", "to")).alias("runs"))


def without_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` plus ``deduped``: text (null stays null), n_lines, n_removed, words_removed."""
    th = F.xxhash64(text_or_empty())
    lines = materialize(docs.select("doc_id", th.alias("th"), F.explode(_lines(text_or_empty())).alias("line"))
                            .select("doc_id", "th", "line.*"), "lines")
    levels = suffix_ranks(lines, min_words)
    entries = levels[0].withColumn("level", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        entries = entries.unionByName(level.withColumn("level", F.lit(k)))
    held = entries.groupBy("doc_id", "th").agg(F.collect_list(F.struct("level", "line", "words", "rank")).alias("ranks"))
    windows = materialize(
        held.select("doc_id", "th", F.explode(_windows(F.col("ranks"), min_words)).alias("window"))
            .select("doc_id", "th", "window.*").withColumn("lines", F.col("to") - F.col("from") + 1), "line-windows")
    runs = materialize(repeated_runs(windows), "line-cuts")
    # The whole row as one column: none of its names can clash.
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "deduped"]).alias("row"), th.alias("key"))
    joined = whole.join(runs, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("th")), "left")
    cut = _cut(F.coalesce(F.col("row.text"), F.lit("")), F.col("runs"))
    return (joined.select("row", cut.alias("deduped"))
                  .withColumn("deduped", F.col("deduped").withField(
                      "text", F.when(F.col("row.text").isNotNull(), F.col("deduped.text"))))
                  .select("row.*", "deduped"))
