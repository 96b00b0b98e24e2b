"""Operator 13 — URL filter: host and path rules, then a character language-model ratio.

A rule names a host and the start of a path; it fits that host, all its
subdomains and every path that begins so, and the longest fitting rule
decides.  Urls that no rule fits are judged by two smoothed variable-order
Markov models over characters, one of accepted and one of rejected urls (those
that the rules allow and block): the mean log-likelihood difference per
character must reach a calibrated threshold.

* Symbols: ``ALPHABET`` after folding A-Z, one symbol for any other byte, a
  start and an end.  Witten-Bell smoothing: a context of ``ORDER`` characters
  gives weight to the next shorter one by the number of its different
  followers, an unseen context gives it all, so the order that is used varies
  with what has been seen.
* Counts come from *all* urls that a rule fits: each task sums its own, the
  sums meet by cell.  There are ``len(symbols) ** (ORDER + 1)`` cells (4.9
  million, 20 MB as one float each), a proven bound for what is collected and
  shipped; nothing of a single url reaches the driver.
* The threshold is calibrated on hosts that the fitted counts have not seen
  (one host of ``HELD_OUT``, by hash): a histogram of their scores per class
  gives the threshold of the least balanced error (with one imagined miss and
  hit a class, so that few urls move it little), ties the nearest to 0.  The
  final models count the held-out hosts as well.

Documents are never shuffled, so a hot host costs what its rows cost.

Cases: null urls and urls without ``://`` have an empty host and path and fit
no rule; a null or empty url has score 0; without accepted or rejected urls
both models are alike or uniform, scores lean accordingly and the threshold
is 0 at the start; equal rows get equal verdicts; an empty table gives an
empty result; other columns are carried through, and must not be called
``host``, ``path``, ``rule``, ``score`` or ``verdict`` (those are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Contract rules: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%"
START, END, OTHER = 0, 1, 2
SYMBOLS = 3 + len(ALPHABET)
ORDER = 3
# One host of so many is held out for the threshold.
HELD_OUT = 5
# Scores are counted in steps of 1 / STEPS up to ± LIMIT.
STEPS, LIMIT = 64, 16
# Sparse counts that a task holds before it sums them up.
HOLD = 1 << 21

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CODES = np.full(256, OTHER, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = 3 + _i


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (host and path of the deciding rule) and its ``verdict``, both null if none fits."""
    # (?s) lets . and $ pass line ends; the first :// counts, everything behind it may hold another.
    part = lambda n: F.regexp_extract(F.coalesce(F.col(url), F.lit("")),
                                      r"(?s)^.*?://([^/?#]*)([^?#]*)", n)
    pages = pages.withColumns({"host": F.translate(part(1), _UPPER, _LOWER), "path": part(2)})
    rule = verdict = None
    for name, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = (((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path))
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, name) if verdict is None else verdict.when(fits, name)
    nothing = F.lit(None).cast("string")
    return pages.withColumns({"rule": nothing if rule is None else rule,
                              "verdict": nothing if verdict is None else verdict})


def cells_of(urls: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells (context and next symbol as one number) of the urls, concatenated, and where each url starts.

    A url of n bytes has n + 1 cells: the end is a symbol, too.
    """
    raw = [u.encode("utf-8", "surrogatepass") for u in urls]
    lengths = np.array([len(r) for r in raw], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER + 1)])
    codes = np.zeros(starts[-1], np.int64)
    within = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(within[-1]) + np.repeat(starts[:-1] + ORDER - within[:-1], lengths)
    codes[at] = _CODES[np.frombuffer(b"".join(raw), np.uint8)]
    codes[starts[1:] - 1] = END
    cells = np.zeros(max(len(codes) - ORDER, 0), np.int64)
    for k in range(ORDER + 1):
        cells = cells * SYMBOLS + codes[k:len(codes) - ORDER + k]
    # Cells that begin in the last ORDER symbols of a url would reach into the next one.
    own = np.concatenate([[0], np.cumsum(lengths + 1)])
    pick = np.arange(own[-1]) + np.repeat(starts[:-1] - own[:-1], lengths + 1)
    return cells[pick], own


def log_probabilities(cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Witten-Bell log P(symbol | context) of every cell, from sparse counts of the full order."""
    full = np.zeros(SYMBOLS ** (ORDER + 1))
    np.add.at(full, cells, counts)
    lower = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(ORDER + 1):
        seen = full.reshape(-1, SYMBOLS ** (k + 1)).sum(0).reshape(-1, SYMBOLS)
        total, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
        shorter = np.tile(lower.reshape(-1, SYMBOLS), (len(seen) // max(1, len(lower) // SYMBOLS), 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            lower = np.where(total > 0, (seen + kinds * shorter) / (total + kinds), shorter).reshape(-1)
    return np.log(lower)


def ratio_of(counts: pd.DataFrame) -> np.ndarray:
    """log P(accepted) - log P(rejected) of every cell, from rows (accepted, cell, n)."""
    parts = [log_probabilities(part["cell"].to_numpy(np.int64), part["n"].to_numpy(float))
             for part in (counts[counts["accepted"]], counts[~counts["accepted"]])]
    return (parts[0] - parts[1]).astype(np.float32)


def scores_of(urls: Sequence[str], ratio: np.ndarray) -> np.ndarray:
    """Mean log-likelihood difference per symbol; 0 for an empty url."""
    if not len(urls):
        return np.zeros(0)
    cells, own = cells_of(urls)
    sums = np.add.reduceat(ratio[cells].astype(float), own[:-1])
    n = np.diff(own)
    return np.where(n > 1, sums / n, 0.0)


def _url(url: str) -> Column:
    return F.coalesce(F.col(url), F.lit(""))


def url_counts(labelled: DataFrame, url: str = "url") -> DataFrame:
    """(accepted, held_out, cell, n) over all rows of a frame with ``verdict`` and ``host``."""
    rows = labelled.select((F.col("verdict") == "allow").alias("accepted"), held_out().alias("held_out"),
                           _url(url).alias("url"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        summed, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        span = SYMBOLS ** (ORDER + 1)

        def settle():
            keys = np.concatenate([summed, *held])
            weights = np.concatenate([n, np.ones(len(keys) - len(n), np.int64)])
            found, place = np.unique(keys, return_inverse=True)
            return found, np.bincount(place, weights, len(found)).astype(np.int64)

        for rows in batches:
            cells, own = cells_of(rows["url"].tolist())
            kind = rows["accepted"].to_numpy(np.int64) * 2 + rows["held_out"].to_numpy(np.int64)
            held.append(np.repeat(kind, np.diff(own)) * span + cells)
            if sum(map(len, held)) > HOLD:
                summed, n = settle()
                held = []
        summed, n = settle()
        kind = summed // span
        yield pd.DataFrame({"accepted": kind >= 2, "held_out": kind % 2 == 1, "cell": summed % span, "n": n})

    return (rows.mapInPandas(count, "accepted boolean, held_out boolean, cell long, n long")
                .groupBy("accepted", "held_out", "cell").agg(F.sum("n").alias("n")))


def held_out() -> Column:
    return F.pmod(F.xxhash64("host"), F.lit(HELD_OUT)) == 0


def url_score(frame: DataFrame, ratio: np.ndarray, url: str = "url") -> Column:
    shipped = frame.sparkSession.sparkContext.broadcast(ratio)

    @pandas_udf("double")
    def score(urls: pd.Series) -> pd.Series:
        return pd.Series(scores_of(urls.tolist(), shipped.value))
    return score(_url(url))


def best_threshold(histogram: list[tuple[bool, int, int]]) -> float:
    """Threshold of the least balanced error over (accepted, step, n); a url passes from its threshold on."""
    size = 2 * LIMIT * STEPS + 1
    counts = np.zeros((2, size))
    for accepted, step, n in histogram:
        counts[int(accepted), step + LIMIT * STEPS] += n
    totals = counts.sum(1) + 2
    missed = (np.concatenate([[0], np.cumsum(counts[1])[:-1]]) + 1) / totals[1]
    passed = (counts[0][::-1].cumsum()[::-1] + 1) / totals[0]
    error = missed + passed
    steps = np.arange(size) - LIMIT * STEPS
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(min(steps[best], key=lambda s: (abs(s), s))) / STEPS


def fit(labelled: DataFrame, url: str = "url") -> tuple[np.ndarray, float, float]:
    """(cell ratios, threshold, balanced error on held-out hosts) from rows with ``verdict`` and ``host``."""
    counts = url_counts(labelled, url).toPandas()
    first = ratio_of(counts[~counts["held_out"]])
    step = F.floor(F.greatest(F.least(F.col("score"), F.lit(float(LIMIT))), F.lit(-float(LIMIT))) * STEPS)
    unseen = labelled.where(held_out())
    histogram = [tuple(r) for r in unseen.select((F.col("verdict") == "allow").alias("accepted"),
                                                 url_score(unseen, first, url).alias("score"))
                 .groupBy("accepted", step.cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()]
    threshold = best_threshold(histogram)
    wrong, total = {True: 0, False: 0}, {True: 0, False: 0}
    for accepted, at, n in histogram:
        total[accepted] += n
        wrong[accepted] += n * ((at / STEPS >= threshold) != accepted)
    error = sum(wrong[c] / max(1, total[c]) for c in (True, False)) / 2
    return ratio_of(counts.groupby(["accepted", "cell"], as_index=False)["n"].sum()), threshold, error


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``score`` (mean log-likelihood difference) and ``verdict`` (allow or block)."""
    ruled = with_rule(pages, rules, url)
    ratio, threshold, _ = fit(ruled.where(F.col("verdict").isNotNull()).select(url, "host", "verdict"), url)
    scored = ruled.withColumn("score", url_score(pages, ratio, url))
    judged = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.withColumn("verdict", F.coalesce("verdict", judged))
