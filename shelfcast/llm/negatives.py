"""Operator 12 — hard-negative mining with a GNAT-style multiway hyperplane tree.

Anchors take the best rows of their own label as positives and, for every
positive, the best rows of other labels whose score stands in a window below
it.  Scores are integer inner products, so the search is one for the largest
inner product inside a window.

* Metric: rows are lifted to the sphere of the largest norm ``M`` (one more
  component makes all norms equal) and anchors have none there, so an inner
  product is an angle: ``score = |anchor| M cos(angle)`` and a window of
  scores is an annulus of angles around the anchor.
* Tree: every node has up to ``WAYS`` split points, spread apart, taken from a
  sample of at most ``SAMPLE`` rows (by hash; the only step on a sample).  A row
  goes to its nearest split point, i.e. the cells are cut by hyperplanes.
  Each split point keeps the range of its angles to each sibling subtree,
  aggregated over *all* rows.
* Search: a sibling whose range misses the annulus seen from any split point
  is eliminated, with its whole subtree; in the leaves that stay every row is
  compared exactly.  So the result equals brute force; where vectors have no
  structure little is eliminated, and the exact leaves do the work.
* Three visits: positives (bounded below by the fifth-best of the anchor's own
  leaf), then negatives.  Leaves are stored as chunks of ``CHUNK`` rows, dealt
  evenly: a vector that a third of the rows share fills many chunks, not one
  task.  Anchors travel in blocks of ``BLOCK`` in the order of their leaves; a
  chunk goes only to blocks with an anchor that its leaf may serve.  A task
  holds one block of anchors, their best five so far, and one chunk.

Scale: chunks × anchor blocks is the work that elimination leaves of
n²/100 pairs; what is shuffled back are five rows per anchor, positive and group.
The driver sees the sample, ``M`` and the ranges (bounded by the tree).

Cases: rows without an id, label or vector, or with a null or non-finite
component, take no part; floor(scale · x) must fit 31 bits (a larger one
raises) and scores 56 bits; vectors of different lengths count as padded by
0; an empty vector is all 0; rows that repeat an id are separate rows (an
anchor's copy may be its positive) and a repeated anchor repeats its result;
ties go to the smaller id; no partner gives no rows; an empty table gives an
empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import near, sample_by_hash
from shelfcast.session import materialize

# Contract values.
SCALE = 256
ANCHOR_EVERY = 100
TOP = 5
LEAST, MOST = 80, 100              # percent of the positive's score
# The tree.
SAMPLE = 8192
WAYS = 16
LEAF_SAMPLE = 64                   # a node with fewer sampled rows is a leaf
CHUNK = 2048                       # rows of a leaf compared at once
BLOCK = 1024                       # anchors that travel together
GROUP = 32                         # chunks per task of a visit
# Angles of equal rows differ by up to the root of the float error.
SLACK = 1e-6
LARGEST = 2 ** 31 - 1

ROW = "row long, id long, label int, vec array<int>"


def matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows of int64, shorter ones padded by 0."""
    lengths = np.fromiter((len(v) for v in vectors), np.int64, len(vectors))
    out = np.zeros((len(vectors), width), np.int64)
    if len(vectors):
        flat = np.concatenate([np.asarray(v, np.int64) for v in vectors]) if lengths.sum() else np.zeros(0, np.int64)
        out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2 ** 53:                                    # exact in doubles, and much faster
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class Tree:
    """Split points of all nodes, what their cells lead to, and the ranges of their angles."""

    def __init__(self, sample: np.ndarray, norm: float, ways: int = WAYS, leaf_sample: int = LEAF_SAMPLE) -> None:
        self.norm = norm                                   # M
        self.width = sample.shape[1]
        self.points: list[np.ndarray] = []                 # of a node: its split points, lifted to the unit sphere
        self.below: list[list[int]] = []                   # of a node's cells: a node, or -1 - leaf
        self.leaves = 0
        self.least: list[np.ndarray] = []
        self.most: list[np.ndarray] = []
        lifted = np.unique(self.lift(sample), axis=0) if len(sample) else self.lift(sample)
        self._grow(lifted, ways, leaf_sample)
        for points in self.points:
            self.least.append(np.full((len(points),) * 2, np.inf))
            self.most.append(np.full((len(points),) * 2, -np.inf))

    def lift(self, rows: np.ndarray) -> np.ndarray:
        unit = rows / (self.norm or 1.0)
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit ** 2).sum(1, keepdims=True)))
        return np.hstack([unit, rest])

    def _grow(self, rows: np.ndarray, ways: int, leaf_sample: int) -> int:
        """Add the node of ``rows``; returns its number, or -1 - leaf."""
        if len(rows) <= max(leaf_sample, ways) or not self.norm:
            self.leaves += 1
            return -self.leaves
        node = len(self.points)
        # Spread apart: each next point is the row farthest from the points so far.
        picked = [0]
        closest = rows @ rows[0]
        while len(picked) < ways:
            picked.append(int(np.argmin(closest)))
            closest = np.maximum(closest, rows @ rows[picked[-1]])
        points = rows[picked]
        self.points.append(points)
        self.below.append([])
        cell = np.argmax(rows @ points.T, axis=1)
        parts = [rows[cell == j] for j in range(ways)]
        # Rows that float angles cannot tell apart stay in one leaf.
        below = [self._grow(part, ways, leaf_sample if len(part) < len(rows) else len(rows)) for part in parts]
        self.below[node] = below
        return node

    def angles(self, lifted: np.ndarray, node: int) -> np.ndarray:
        return np.arccos(np.clip(lifted @ self.points[node].T, -1.0, 1.0))

    def route(self, rows: np.ndarray, seen=None) -> np.ndarray:
        """Leaf of every row; ``seen(node, cells, angles)`` is told what each node saw."""
        leaf = np.zeros(len(rows), np.int64)
        if not self.points:
            return leaf
        lifted = self.lift(rows)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            node, which = waiting.pop()
            if not len(which):
                continue
            angles = self.angles(lifted[which], node)
            cells = np.argmin(angles, axis=1)
            if seen is not None:
                seen(node, cells, angles)
            for j, below in enumerate(self.below[node]):
                if below < 0:
                    leaf[which[cells == j]] = -1 - below
                else:
                    waiting.append((below, which[cells == j]))
        return leaf

    def survivors(self, anchors: np.ndarray, near_: np.ndarray, far: np.ndarray) -> np.ndarray:
        """anchors × leaves: may the leaf hold a row with an angle in [near, far] of the anchor?"""
        stay = np.ones((len(anchors), max(1, self.leaves)), bool)
        lengths = np.sqrt((anchors.astype(float) ** 2).sum(1, keepdims=True))
        unit = np.hstack([anchors / np.where(lengths > 0, lengths, 1.0), np.zeros((len(anchors), 1))])
        reach = [(0, np.arange(len(anchors)))] if self.points else []
        if self.points:
            stay[:] = False
        while reach:
            node, which = reach.pop()
            angles = self.angles(unit[which], node)                           # anchors × points
            a, b = near_[which, None, None] - SLACK, far[which, None, None] + SLACK
            at = angles[:, :, None]
            least, most = self.least[node][None], self.most[node][None]      # of point i and cell j
            gone = ((most < at - b) | (least > at + b) | (most < a - at)).any(1)
            gone &= (lengths[which] > 0)                                     # an anchor of 0 has no angles
            gone |= ~np.isfinite(self.least[node][0])[None]                  # a cell without rows
            for j, below in enumerate(self.below[node]):
                on = which[~gone[:, j]]
                if not len(on):
                    continue
                if below < 0:
                    stay[on, -1 - below] = True
                else:
                    reach.append((below, on))
        return stay

    def annulus(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Angles of the nearest and farthest rows whose scores are within [low, high]."""
        full = np.sqrt((anchors.astype(float) ** 2).sum(1)) * self.norm
        full = np.where(full > 0, full, 1.0)
        return (np.arccos(np.clip(high / full, -1.0, 1.0)), np.arccos(np.clip(low / full, -1.0, 1.0)))


def participants(vectors: DataFrame, row_id: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(row, id, label, vec): the rows that take part, their components as integers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    value = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = vectors.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("int").alias("label"),
                            value.alias("value")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("value").isNotNull()
        & F.coalesce(F.forall("value", finite), F.lit(False)))
    # ANSI casts raise on a component that does not fit.
    return usable.select(F.monotonically_increasing_id().alias("row"), "id", "label",
                         F.transform("value", lambda x: F.floor(x * scale).cast("int")).alias("vec"))


def fit_tree(rows: DataFrame, sample: int = SAMPLE, ways: int = WAYS, leaf_sample: int = LEAF_SAMPLE) -> Tree:
    """Split points from a bounded sample; ranges are filled by ``with_ranges``."""
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    top, width = rows.agg(F.max(squares), F.max(F.size("vec"))).first()
    taken = sample_by_hash(rows.select("id", "vec"), ["id", "vec"], sample).toPandas()
    return Tree(matrix(taken["vec"].tolist(), int(width or 0)), float(np.sqrt(top or 0.0)), ways, leaf_sample)


def with_leaf(rows: DataFrame, tree: Tree) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield part.assign(leaf=shipped.value.route(matrix(part["vec"].tolist(), shipped.value.width)))
    return rows.mapInPandas(place, ROW + ", leaf long")


def with_ranges(tree: Tree, rows: DataFrame) -> Tree:
    """The tree with the ranges of the angles between its split points and all ``rows``."""
    shipped = rows.sparkSession.sparkContext.broadcast(tree)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shipped.value
        least = [np.full((len(p),) * 2, np.inf) for p in tree.points]
        most = [np.full((len(p),) * 2, -np.inf) for p in tree.points]

        def seen(node, cells, angles):
            np.minimum.at(least[node].T, cells, angles)
            np.maximum.at(most[node].T, cells, angles)
        for part in batches:
            tree.route(matrix(part["vec"].tolist(), tree.width), seen)
        for node in range(len(tree.points)):
            i, j = np.nonzero(np.isfinite(least[node]))
            yield pd.DataFrame({"node": node, "i": i, "j": j, "least": least[node][i, j], "most": most[node][i, j]})

    if tree.points:
        found = (rows.select("vec").mapInPandas(measure, "node int, i int, j int, least double, most double")
                     .groupBy("node", "i", "j").agg(F.min("least").alias("least"), F.max("most").alias("most")))
        for r in found.toPandas().itertuples():
            tree.least[r.node][r.i, r.j], tree.most[r.node][r.i, r.j] = r.least, r.most
    return tree


def chunked(placed: DataFrame, width: int, chunk: int = CHUNK) -> DataFrame:
    """Rows of each leaf packed in chunks: (leaf, chunk, n, ids, labels, rows, vecs), ids ascending within a chunk."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def out(part: pd.DataFrame) -> dict:
            part = part.sort_values(["id", "row"], kind="stable")
            return {"leaf": int(part["leaf"].iloc[0]), "chunk": int(part["row"].iloc[0]), "n": len(part),
                    **{k: part[k].to_numpy(np.int64).tobytes() for k in ("id", "label", "row")},
                    "vec": matrix(part["vec"].tolist(), width).astype(np.int32).tobytes()}

        def ready(part: pd.DataFrame, last: bool):
            """Full chunks of sorted rows, and what is left."""
            leaf = part["leaf"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            rows, kept = [], cuts[-1]
            for a, b in zip(cuts, cuts[1:]):
                for s in range(a, b, chunk):
                    if s + chunk <= b or b < len(leaf) or last:
                        rows.append(out(part.iloc[s:min(s + chunk, b)]))
                    else:
                        kept = min(kept, s)
            return rows, part.iloc[kept:]

        for part in batches:
            held.append(part)
            if sum(map(len, held)) >= chunk:
                rows, rest = ready(pd.concat(held), False)
                held = [rest] if len(rest) else []
                if rows:
                    yield pd.DataFrame(rows)
        if held:
            rows, _ = ready(pd.concat(held), True)
            yield pd.DataFrame(rows)

    # Ranges of (leaf, row): a leaf of any size is dealt over many tasks.
    dealt = placed.repartitionByRange("leaf", "row").sortWithinPartitions("leaf", "row")
    return dealt.mapInPandas(pack, "leaf long, chunk long, n long, id binary, label binary, row binary, vec binary")


def anchor_blocks(placed: DataFrame, every: int = ANCHOR_EVERY, block: int = BLOCK) -> DataFrame:
    """Anchors in blocks of neighbours: (block, row, id, label, vec, leaf)."""
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        n, part_id = 0, TaskContext.get().partitionId()
        for part in batches:
            yield part.assign(block=part_id * (1 << 32) + (n + np.arange(len(part))) // block)
            n += len(part)
    anchors = placed.where(F.col("id") % every == 0)
    return anchors.repartitionByRange("leaf", "row").sortWithinPartitions("leaf", "row").mapInPandas(
        number, ROW + ", leaf long, block long")


class Best:
    """The first ``top`` rows of each anchor's windows so far: by score, then by smaller id."""

    def __init__(self, shape: tuple[int, ...], top: int) -> None:
        self.score = np.full((*shape, top), np.iinfo(np.int64).min)
        self.id = np.full((*shape, top), np.iinfo(np.int64).max)

    def add(self, at, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge candidates (last axis) into the lists at ``at``."""
        score = np.concatenate([self.score[at], score], -1)
        ids = np.concatenate([self.id[at], ids], -1)
        order = np.lexsort((ids, ~score), axis=-1)[..., :self.score.shape[-1]]
        self.score[at] = np.take_along_axis(score, order, -1)
        self.id[at] = np.take_along_axis(ids, order, -1)


def _first(scores: np.ndarray, usable: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``top`` usable columns of each row; columns ascend by id, so ties keep their order."""
    least = np.iinfo(np.int64).min
    masked = np.where(usable, scores, least)
    k = min(top, masked.shape[1])
    edge = ~np.partition(~masked, k - 1, axis=1)[:, k - 1:k]
    # Everything above the edge, then the earliest columns at the edge.
    above, level = masked > edge, (masked == edge) & usable
    take = above | (level & (np.cumsum(level, 1) <= k - above.sum(1, keepdims=True)))
    out_s = np.full((len(masked), top), least)
    out_i = np.full((len(masked), top), np.iinfo(np.int64).max)
    r, c = np.nonzero(take)
    place = (np.cumsum(take, 1) - 1)[r, c]
    out_s[r, place], out_i[r, place] = masked[r, c], ids[c]
    return out_s, out_i


def visit(blocks: DataFrame, chunks: DataFrame, tree: Tree, pairs: DataFrame, negatives: bool, top: int = TOP,
          least: int = LEAST, most: int = MOST, group: int = GROUP) -> DataFrame:
    """(row, slot, score, id): the first ``top`` rows per anchor (and window) of each group of chunks.

    ``blocks`` has (block, row, id, label, vec, windows array<long>): the
    positives' scores of a search for ``negatives``, else one lower bound.
    ``pairs`` (block, leaf) says which leaves a block goes to.
    """
    spark = blocks.sparkSession
    shipped = spark.sparkContext.broadcast(tree)
    total = chunks.count()
    groups = max(1, -(-total // group))
    none = lambda kind: F.lit(None).cast(kind)
    deal = F.pmod(F.xxhash64("leaf", "chunk"), F.lit(groups)).alias("deal")
    sent = (chunks.join(near(pairs, F.lit(16)), "leaf")
                  .select("block", deal, F.lit(1).alias("kind"), "leaf", "chunk", "id", "label", "row", "vec",
                          none("long").alias("a_row"), none("int").alias("a_label"),
                          none("array<int>").alias("a_vec"), none("array<long>").alias("windows")))
    asked = (blocks.join(pairs.select("block").distinct(), "block", "left_semi")
                   .withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
                   .select("block", "deal", F.lit(0).alias("kind"), none("long").alias("leaf"),
                           none("long").alias("chunk"), none("binary").alias("id"), none("binary").alias("label"),
                           none("binary").alias("row"), none("binary").alias("vec"), F.col("row").alias("a_row"),
                           F.col("label").alias("a_label"), F.col("vec").alias("a_vec"), "windows"))
    dealt = (asked.unionByName(sent).repartition("block", "deal")
                  .sortWithinPartitions("block", "deal", "kind", "leaf", "chunk"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shipped.value
        key, anchors, state = None, [], None
        for part in batches:
            for r in part.itertuples(index=False):
                if (r.block, r.deal) != key:
                    if state is not None:
                        yield state.rows()
                    key, anchors, state = (r.block, r.deal), [], None
                if r.kind == 0:
                    anchors.append((r.a_row, r.a_label, r.a_vec, r.windows))
                    continue
                if state is None:
                    state = Search(tree, anchors, negatives, top, least, most)
                state.look(int(r.leaf), r.id, r.label, r.row, r.vec)
        if state is not None:
            yield state.rows()
    return dealt.mapInPandas(search, "row long, slot int, score long, id long")


class Search:
    """One block of anchors looking through chunks, one by one."""

    def __init__(self, tree: Tree, anchors: list, negatives: bool, top: int, least: int, most: int) -> None:
        self.tree, self.negatives, self.top, self.least, self.most = tree, negatives, top, least, most
        self.row = np.array([a[0] for a in anchors], np.int64)
        self.label = np.array([a[1] for a in anchors], np.int64)
        self.vec = matrix([a[2] for a in anchors], tree.width)
        slots = max(len(a[3]) for a in anchors)
        self.window = np.zeros((len(anchors), slots), np.int64)
        self.used = np.zeros((len(anchors), slots), bool)
        for i, a in enumerate(anchors):
            self.window[i, :len(a[3])] = a[3]
            self.used[i, :len(a[3])] = True
        self.best = Best(self.window.shape, top)
        self.stay = tree.survivors(self.vec, *ring(tree, self.vec, self.window, self.used, negatives, least, most))

    def look(self, leaf: int, ids: bytes, labels: bytes, rows: bytes, vecs: bytes) -> None:
        on = np.flatnonzero(self.stay[:, leaf] & self.used.any(1))
        if not len(on):
            return
        ids, labels, rows = (np.frombuffer(x, np.int64) for x in (ids, labels, rows))
        scores = products(self.vec[on], np.frombuffer(vecs, np.int32).reshape(len(ids), self.tree.width)
                          .astype(np.int64))
        same = self.label[on, None] == labels[None]
        for slot in range(self.window.shape[1]):
            w = self.window[on, slot][:, None]
            if self.negatives:
                usable = ~same & (100 * scores >= self.least * w) & (100 * scores <= self.most * w)
            else:
                usable = same & (scores >= w) & (self.row[on, None] != rows[None])
            usable &= self.used[on, slot][:, None] & (scores >= self.best.score[on, slot, -1:])
            hit = np.flatnonzero(usable.any(1))
            if len(hit):
                self.best.add((on[hit], slot), *_first(scores[hit], usable[hit], ids, self.top))

    def rows(self) -> pd.DataFrame:
        at, slot, k = np.nonzero(self.best.score > np.iinfo(np.int64).min)
        return pd.DataFrame({"row": self.row[at], "slot": slot.astype(np.int32),
                             "score": self.best.score[at, slot, k], "id": self.best.id[at, slot, k]})


def ring(tree: Tree, vec: np.ndarray, window: np.ndarray, used: np.ndarray, negatives: bool, least: int,
         most: int) -> tuple[np.ndarray, np.ndarray]:
    """Annulus of angles that holds all windows of each anchor."""
    big = np.iinfo(np.int64).max
    high = np.where(used, window, -big).max(1).astype(float)
    low = np.where(used, window, big).min(1).astype(float)
    if negatives:
        return tree.annulus(vec, np.minimum(low * least / 100, low * most / 100) - 1,
                            np.maximum(high * most / 100, high * least / 100) + 1)
    return tree.annulus(vec, low - 1, np.full(len(vec), np.inf))


def leaves_of(blocks: DataFrame, tree: Tree, negatives: bool, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(block, leaf): leaves that some anchor of the block cannot eliminate."""
    shipped = blocks.sparkSession.sparkContext.broadcast(tree)

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part = part[part["windows"].map(len) > 0]
            if not len(part):
                continue
            state = Search(shipped.value, list(zip(part["row"], part["label"], part["vec"], part["windows"])),
                           negatives, 1, least, most)
            at, leaf = np.nonzero(state.stay)
            yield pd.DataFrame({"block": part["block"].to_numpy()[at], "leaf": leaf}).drop_duplicates()
    return (blocks.select("block", "row", "label", "vec", "windows")
                  .mapInPandas(reach, "block long, leaf long").distinct())


def _top(found: DataFrame, top: int) -> DataFrame:
    """The first rows over all groups: at most ``top`` per group of chunks meet per anchor and window."""
    order = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mine(vectors: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
         scale: int = SCALE, every: int = ANCHOR_EVERY, top: int = TOP, least: int = LEAST, most: int = MOST,
         sample: int = SAMPLE, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and positive."""
    named = vectors.select(F.col(row_id).alias("id"), F.col(vector).alias("vec"),
                           (F.col(label) if isinstance(label, str) else label).alias("label"))
    rows = materialize(participants(named, "id", "vec", "label", scale), "negatives-rows")
    tree = fit_tree(rows, sample)
    placed = materialize(with_leaf(rows, tree), "negatives-placed")
    tree = with_ranges(tree, placed)
    chunks = materialize(chunked(placed, tree.width, chunk), "negatives-chunks")
    anchors = materialize(anchor_blocks(placed, every, block), "negatives-anchors")

    # A bound for the positives: the fifth-best row of the anchor's own leaf.
    lowest = -(2 ** 62)
    free = anchors.withColumn("windows", F.array(F.lit(lowest).cast("long")))
    home = _top(visit(free, chunks, tree, anchors.select("block", "leaf").distinct(), False, top), top)
    bounds = home.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bound"))
    bounded = materialize(anchors.join(bounds, "row", "left").withColumn(
        "windows", F.array(F.when(F.col("n") >= top, F.col("bound")).otherwise(F.lit(lowest).cast("long"))))
        .drop("n", "bound"), "negatives-bounded")
    found = visit(bounded, chunks, tree, leaves_of(bounded, tree, False), False, top)
    positives = materialize(_top(found, top).select("row", F.col("rank").alias("place"), "score", "id"),
                            "negatives-positives")

    windows = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))
    asking = materialize(anchors.join(windows, "row").withColumn("windows", F.transform("p", lambda p: p["score"]))
                         .drop("p"), "negatives-windows")
    taken = _top(visit(asking, chunks, tree, leaves_of(asking, tree, True, least, most), True, top, least, most), top)
    return (taken.select("row", (F.col("slot") + 1).alias("place"), "rank", F.col("id").alias("negative_id"),
                         F.col("score").alias("negative_score"))
                 .join(positives.select("row", "place", F.col("id").alias("positive_id"),
                                        F.col("score").alias("positive_score")), ["row", "place"])
                 .join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
                 .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op12_label() -> Column:
    """The query's label: rows whose id is divisible by 7 move on by one of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
