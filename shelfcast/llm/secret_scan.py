"""Operator 3 — secret scans: a character convolutional network over every candidate.

One pass over the texts extracts candidates: the base findings (assigned
values, access keys, hex runs) and every other token of at least 8 characters
that has a digit, follows an assignment mark or has the entropy of a key.
Each becomes one or more windows: up to ``VALUE`` characters of the token
between ``CONTEXT`` characters on both sides (a longer token has a window
for each stretch, so it is seen whole).  A small network in numpy
(embedding, convolution, max pooling, logistic output) is trained on
labelled findings: base findings are positive, tokens that are plainly an
address, a number, a path or a word of prose are negative, the rest is unlabelled.
``SEEDS`` invented examples a class (drawn from a fixed seed) are always among
them, so a small table has a network as a large one has.  Whole documents are held
out (one of ``HELD_OUT``, by hash): scores are calibrated on them (Platt scaling),
the threshold is the largest that keeps ``MIN_RECALL`` of their positives, and
``CharNet.report`` tells the recall and the false alarms on them.  Every
candidate is scored; base findings always stay.

Nothing is sampled: the network is trained on every distinct labelled window that is
not held out.  These are dealt by hash into shards of some ``SHARD`` rows; in each of
``ROUNDS`` rounds every shard trains the shared network on all of its rows, and the
parameters are averaged (local gradient descent).  Calibration, threshold and report
take the counts of every held-out window by label and logit; logits are multiples of
``GRID`` between ``-LIMIT`` and ``LIMIT``, so these counts lose nothing and are bounded.
The network (a few kilobytes) is shipped to tasks.
Texts are read once: candidates are written to the shared folder first.

Cases: null text counts as empty (no span, digest of the empty string); a table
without labelled rows is judged by what the invented examples teach; equal rows
get equal spans; key columns are carried through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shelfcast.llm.common import text_or_empty
from shelfcast.session import materialize

# Contract patterns and limits (fixed values).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_VALUE, MIN_ACCESS = 8, 16

# Candidates of the method and the network (parameters).
TOKEN = re.compile(r"[A-Za-z0-9+/_.=@!$&~#%^*?-]{8,}")
# What stands before an assigned value, within so many characters, or inside a token that holds its name.
MARK = re.compile(r"[:=]\s{0,3}[\"']?(?:(?:basic|bearer)\s)?$", re.IGNORECASE)
MARK_CHARS = 12
ASSIGNED = re.compile(r"=[^=]{8}")
PLAIN = re.compile(r"[A-Za-z][a-z]+(?:[-/][A-Za-z][a-z]*)*[.!?]*")
SHOUTED = re.compile(r"[A-Z]+(?:[-/.][A-Z]+)*[.!?]*")
MIN_ENTROPY = 3.2            # bits a character
CONTEXT, VALUE = 16, 40
SHARD, ROUNDS = 16384, 2     # rows that a task trains on, and rounds over all rows
GRID, LIMIT = 2.0 ** -10, 32.0
SEEDS = 200                  # invented examples a class
HELD_OUT = 4                 # one document of so many is held out
MIN_RECALL = 0.95
FILTERS, WIDTH, EMBED, STEPS, BATCH, SEED = 16, 5, 8, 400, 64, 7

FOUND = "array<struct<kind:string,start:long,end:long,label:int,windows:array<string>>>"


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; matches that fail a limit are dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def windows_of(text: str, start: int, end: int) -> list[str]:
    """Fixed-width views of a token: left context, a stretch of the token, right context."""
    out = []
    for at in range(start, end, VALUE):
        stop = min(at + VALUE, end)
        left = text[max(0, at - CONTEXT):at].rjust(CONTEXT, "\0")
        out.append(left + text[at:stop].ljust(VALUE, "\0") + text[stop:stop + CONTEXT].ljust(CONTEXT, "\0"))
    return out


def benign(token: str) -> bool:
    """Tokens that are plainly an address, a number, a path or a word."""
    return ("@" in token or not re.search("[A-Za-z]", token) or token.count("/") > 2 or bool(PLAIN.fullmatch(token) or SHOUTED.fullmatch(token))
            or bool(re.search(r"\.(com|org|net|html?|php|pdf)\b", token)))


def entropy(token: str) -> float:
    """Bits a character."""
    return sum(n * math.log2(len(token) / n) for n in Counter(token).values()) / len(token)


def value_like(text: str, start: int, end: int) -> bool:
    """Tokens that have a digit, are assigned, or are as mixed as a key."""
    token = text[start:end]
    return bool(re.search("[0-9]", token) or ASSIGNED.search(token) or MARK.search(text[max(0, start - MARK_CHARS):start])
                or (entropy(token) >= MIN_ENTROPY and not PLAIN.fullmatch(token)))


def candidates(text: str) -> list[tuple[str, int, int, int, list[str]]]:
    """(kind, start, end, label, windows); label 1 base, 0 benign, -1 unknown."""
    base = base_findings(text)
    out = [(k, s, e, 1, windows_of(text, s, e)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    i = 0
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if (i < len(taken) and taken[i][0] < e) or not value_like(text, s, e):
            continue
        out.append(("cnn", s, e, 0 if benign(m.group()) else -1, windows_of(text, s, e)))
    return out


def encode(windows: Sequence[str]) -> np.ndarray:
    points = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(points, 127).astype(np.int64).reshape(len(windows), 2 * CONTEXT + VALUE)


def seed_examples(n: int = SEEDS) -> list[tuple[str, int]]:
    """(window, label) of invented secrets and plain tokens in plain sentences, the same on every run."""
    rng = np.random.default_rng(SEED)
    draw = lambda letters, size: "".join(rng.choice(list(letters), size))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = lower + lower.upper() + digits
    word = lambda: draw(lower, rng.integers(3, 9))
    secrets = (lambda: draw(digits + "abcdef", rng.integers(32, 65)), lambda: "AKIA" + draw(lower.upper() + digits, 16),
               lambda: draw(mixed + "+/", rng.integers(16, 48)), lambda: draw(mixed, rng.integers(10, 24)))
    plain = (lambda: f"{word()}.{word()}@{word()}.com", lambda: draw(digits, rng.integers(8, 16)),
             lambda: f"/{word()}/{word()}/{word()}/{word()}{rng.integers(0, 99)}.html", lambda: draw(lower, rng.integers(8, 14)),
             lambda: f"www.{word()}{rng.integers(0, 99)}.org/{word()}")
    before = (lambda: word() + " ", lambda: "key: ", lambda: "password=", lambda: "token = ", lambda: f"{word()}, ")
    out = []
    for label, kinds in ((1, secrets), (0, plain)):
        for k in range(n):
            lead = f"{word()} {word()} " + before[k % len(before) if label else k % 2 * 4]()
            token = kinds[k % len(kinds)]()
            out += [(w, label) for w in windows_of(f"{lead}{token} {word()} {word()}.", len(lead), len(lead) + len(token))]
    return out


class CharNet:
    """Embedding → convolution → ReLU → max pooling → logistic output, all in numpy."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.p = {"E": rng.normal(0, 0.3, (128, EMBED)),
                  "K": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
                  "c": np.zeros(FILTERS), "w": rng.normal(0, 0.2, FILTERS), "b": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.0
        self.report: dict[str, float] = {}

    def _forward(self, x: np.ndarray):
        emb = self.p["E"][x]                                                    # rows, length, EMBED
        steps = x.shape[1] - WIDTH + 1
        cols = np.concatenate([emb[:, k:k + steps] for k in range(WIDTH)], axis=2)
        act = np.maximum(cols @ self.p["K"] + self.p["c"], 0)
        at = act.argmax(axis=1)
        pooled = np.take_along_axis(act, at[:, None, :], 1)[:, 0]
        return cols, at, pooled, pooled @ self.p["w"] + self.p["b"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i:i + 512])[3] for i in range(0, len(x), 512)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return np.clip(np.round(z / GRID) * GRID, -LIMIT, LIMIT) + 0.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = np.asarray(flat[at:at + v.size], float).reshape(v.shape)
            at += v.size

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = SEED, steps: int = STEPS,
              share: float | None = None) -> None:
        """At least ``steps`` batches, and every row at least once; ``share``: that of the positives (that of ``y``)."""
        rng = np.random.default_rng(seed)
        share = y.mean() if share is None else share
        steps = max(steps, -(-len(x) // BATCH))
        passes = -(-steps * BATCH // len(x))
        order = np.concatenate([rng.permutation(len(x)) for _ in range(passes)])
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        for step in range(1, steps + 1):
            rows = order[(step - 1) * BATCH:step * BATCH]
            xb = x[rows].copy()
            hide = rng.random(len(rows)) < 0.5                # half of the rows without context: the token must do
            xb[hide, :CONTEXT] = xb[hide, -CONTEXT:] = 0
            cols, at, pooled, z = self._forward(xb)
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            dpool = dz[:, None] * self.p["w"] * (pooled > 0)
            picked = np.take_along_axis(cols, at[:, :, None], 1)                # rows, FILTERS, WIDTH*EMBED
            g = {"w": pooled.T @ dz, "b": np.array([dz.sum()]), "c": dpool.sum(0),
                 "K": np.einsum("rfd,rf->df", picked, dpool), "E": np.zeros_like(self.p["E"])}
            dcols = dpool[:, :, None] * self.p["K"].T[None]
            for k in range(WIDTH):
                chars = np.take_along_axis(xb, at + k, 1)
                np.add.at(g["E"], chars, dcols[:, :, k * EMBED:(k + 1) * EMBED])
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                self.p[k] = self.p[k] - 0.01 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = MIN_RECALL) -> None:
        """``calibrate_counts`` on held-out rows."""
        self.calibrate_counts(self.logits(x), y, np.ones(len(x)), recall)

    def calibrate_counts(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float = MIN_RECALL) -> None:
        """Platt scaling on ``n`` held-out rows of logit ``z`` and label ``y``, then the largest threshold with the
        asked recall, and the report."""
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            a -= 0.05 * (np.average((p - y) * z, weights=n) + 1e-3 * (a - 1))
            b -= 0.05 * np.average(p - y, weights=n)
        self.scale, self.shift = max(a, 1e-3), b
        p, positive = self.calibrated(z), y == 1
        order = np.argsort(p[positive], kind="stable")
        reached = np.cumsum(n[positive][order])
        self.threshold = float(p[positive][order][np.searchsorted(reached, int((1 - recall) * reached[-1]), side="right")])
        called = np.where(p >= self.threshold, n, 0)
        self.report = {"held_out": float(n.sum()), "recall": float(called[positive].sum() / n[positive].sum()),
                       "false_alarms": float(called[~positive].sum() / max(n[~positive].sum(), 1))}


def scan(text: Column) -> Column:
    """Array of candidates of ``text``."""
    @pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "label", "windows")
        for texts in batches:
            yield pd.Series([[dict(zip(names, c)) for c in candidates(t)] for t in texts], dtype=object)
    return found(text)


def labelled_windows(found: DataFrame) -> DataFrame:
    """(label, w, held): every distinct labelled window.

    A window that stands in several documents belongs to the one of the least hash.
    """
    documents = found.withColumn("_doc", F.xxhash64(*found.columns))
    return (documents.select("_doc", F.explode("found").alias("c")).where("c.label >= 0")
                     .select("_doc", "c.label", F.explode("c.windows").alias("w"))
                     .groupBy("label", "w").agg((F.pmod(F.min("_doc"), F.lit(HELD_OUT)) == 0).alias("held")))


def train_round(net: CharNet, rows: DataFrame, seeds: tuple[np.ndarray, np.ndarray], share: float, seed: int) -> np.ndarray:
    """The mean parameters of ``net`` after each shard of ``rows`` (shard, w, label) has trained it on all of its rows.

    Sums are of decimals, so that they do not depend on the order in which tasks end.
    """
    def work(part: pd.DataFrame) -> pd.DataFrame:
        windows, labels = zip(*sorted(zip(part["w"], part["label"])))       # in an order of their own
        own = CharNet()
        own.load(net.flat())
        own.train(np.concatenate([encode(windows), seeds[0]]), np.concatenate([labels, seeds[1]]), seed,
                  -(-STEPS // ROUNDS), share)
        return pd.DataFrame({"at": np.arange(len(own.flat())), "value": own.flat()})

    trained = rows.groupBy("shard").applyInPandas(work, "at long, value double")
    sums = trained.groupBy("at").agg(F.sum(F.col("value").cast("decimal(30,15)")).alias("value"),
                                     F.count(F.lit(1)).alias("n")).collect()        # one row per parameter
    return np.array([float(r["value"]) / r["n"] for r in sorted(sums, key=lambda r: r["at"])])


def held_out_counts(net: CharNet, rows: DataFrame) -> pd.DataFrame:
    """(label, z, n): how many of ``rows`` have a label and a logit; at most 2 labels × 2 LIMIT / GRID rows."""
    @pandas_udf("double")
    def logit(windows: pd.Series) -> pd.Series:
        return pd.Series(net.logits(encode(windows.tolist())))
    counted = rows.select("label", logit("w").alias("z")).groupBy("label", "z").agg(F.count(F.lit(1)).alias("n"))
    return counted.toPandas().sort_values(["label", "z"])


def fit_network(found: DataFrame) -> CharNet:
    """Train on every labelled window that is not held out, calibrate on every one that is; with the invented examples."""
    rows = materialize(labelled_windows(found), "secret-windows")
    seeds = seed_examples()
    x, y = encode([w for w, _ in seeds]), np.array([label for _, label in seeds], float)
    held = np.arange(len(seeds)) % HELD_OUT == 0
    sizes = {r["label"]: r["n"] for r in rows.where(~F.col("held")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    shards = max(1, -(-n // SHARD))
    # The invented examples belong to every shard.
    share = (sizes.get(1, 0) / shards + y[~held].sum()) / (n / shards + (~held).sum())
    train = rows.where(~F.col("held")).select(F.pmod(F.xxhash64("w"), F.lit(shards)).alias("shard"), "w", "label")
    net = CharNet()
    if n:
        for k in range(ROUNDS):
            net.load(train_round(net, train, (x[~held], y[~held]), share, SEED + k))
    else:
        net.train(x[~held], y[~held])
    counts = held_out_counts(net, rows.where("held"))
    net.calibrate_counts(*[np.concatenate([counts[c].to_numpy(float), more]) for c, more in (
        ("z", net.logits(x[held])), ("label", y[held]), ("n", np.ones(held.sum())))])
    return net


def find_secrets(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document: ``keys`` and ``secrets``, an array of (kind, start, end, base, score)."""
    found = materialize(docs.select(*keys, scan(text_or_empty(text)).alias("found")), "secret-candidates")
    net = fit_network(found)

    @pandas_udf("array<struct<kind:string,start:long,end:long,base:boolean,score:double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            flat = [w for row in rows for c in row for w in c["windows"]]
            scores = iter(net.probabilities(encode(flat)) if flat else ())
            out = []
            for row in rows:
                kept = []
                for c in row:
                    score = max((next(scores) for _ in c["windows"]), default=0.0)
                    base = c["label"] == 1
                    if base or score >= net.threshold:
                        kept.append({"kind": c["kind"], "start": c["start"], "end": c["end"],
                                     "base": base, "score": float(score)})
                out.append(sorted(kept, key=lambda s: (s["start"], (*KINDS, "cnn").index(s["kind"]))))
            yield pd.Series(out, dtype=object)

    return found.select(*keys, judge(F.col("found")).alias("secrets"))
