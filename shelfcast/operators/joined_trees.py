"""M1 and M2 over a lookup join whose rows are not kept: the same trees from histograms.

MLlib keeps a copy of every training row for the passes over the levels.  Where the
rows are a table joined to its lookup (one row per order *and* view group) that copy
is many times the table.  ``fit_joined`` grows the trees of a given learner as MLlib does,

* level by level, all trees at once, from sums of label and weight per node, feature and bin;
* over every training row, but the rows of the join are made and dropped inside the
  tasks, a block at a time: what is read again for a level is the un-fanned table;
* with the learner's own settings (depth, bins, trees, bootstrap, feature subsets, seed):
  a bootstrap draws a Poisson count per row of the join and tree, from a hash of the row's
  place, so a repeated or recomputed pass draws the same;
* with split candidates from the quantiles of all training rows (MLlib: of a sample),

and gives back an ordinary MLlib model, loaded from the node rows it grew.

What reaches the driver is bounded by trees × nodes of a level × features × bins.
The task functions need nothing but numpy and pyarrow on the workers.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import ceil, exp

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.session import delete_path, shared_dir

# Rows of the join that a task holds at once (a row of the table with more partners is one block).
BLOCK_ROWS = 32_768
MOST_BINS = 2 ** 15
# Quantiles from which split candidates are taken, per feature.
QUANTILES = tuple(i / 1000 for i in range(1001))
QUANTILE_ACCURACY = 10_000
# Gains below this part of the squared mean are rounding.
LEAST_GAIN = 1e-13


@dataclass
class Bins:
    """How a feature's values become bins: split points, or the category of a value (``None``: the value itself)."""
    thresholds: np.ndarray | None = None
    categories: dict[float, int] | None = None
    arity: int = 0

    @property
    def continuous(self) -> bool:
        return self.thresholds is not None

    @property
    def size(self) -> int:
        return len(self.thresholds) + 1 if self.continuous else self.arity

    def column(self, x: Column) -> Column:
        """The bin as an expression, for the small side."""
        if self.continuous:
            if not len(self.thresholds):
                return F.lit(0).cast("smallint")
            below = F.filter(F.lit(self.thresholds.tolist()).cast("array<double>"), lambda t: t < x)
            return F.size(below).cast("smallint")
        if self.categories is None:
            return x.cast("smallint")
        # A value without a category is in no row of the join: any bin will do.
        known = F.create_map(*[F.lit(v) for pair in self.categories.items() for v in pair])
        return F.coalesce(known[x], F.lit(0)).cast("smallint")

    def spec(self) -> tuple:
        """What a task needs: ("split", points), ("category", values, their categories) or ("value",)."""
        if self.continuous:
            return "split", self.thresholds
        if self.categories is None:
            return ("value",)
        values = sorted(self.categories)
        return "category", np.array(values), np.array([self.categories[v] for v in values])


@dataclass
class Tree:
    """A growing tree: per node its split feature, the next node by bin, and the depth; node 0 is the root."""
    bins: int
    feature: list[int] = field(default_factory=lambda: [0])
    children: list[tuple[int, int] | None] = field(default_factory=lambda: [None])
    left: list[np.ndarray | None] = field(default_factory=lambda: [None])       # bins (categories) that go left
    active: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, left: np.ndarray) -> None:
        first = len(self.feature)
        self.feature[node], self.children[node], self.left[node] = feature, (first, first + 1), left
        for _ in range(2):
            self.feature.append(0)
            self.children.append(None)
            self.left.append(None)

    def tables(self) -> dict:
        """Arrays by which rows descend: a leaf leads to itself."""
        n = len(self.feature)
        following = np.repeat(np.arange(n), self.bins).reshape(n, self.bins)
        for node, pair in enumerate(self.children):
            if pair is not None:
                following[node] = pair[1]
                following[node, self.left[node]] = pair[0]
        return {"feature": np.array(self.feature), "next": following.ravel(), "nodes": n}


def split_points(values: Sequence[float], weights: Sequence[float], most: int) -> np.ndarray:
    """Up to ``most`` split points of a continuous feature, placed as MLlib places them: halfway between neighbours, at
    even steps of the weight, or between all values if these are few."""
    v, at = np.unique(np.asarray(values, dtype=float), return_inverse=True)
    w = np.bincount(at, np.asarray(weights, dtype=float), len(v))
    middle = (v[:-1] + v[1:]) / 2
    if len(middle) <= most:
        return middle
    stride, found = w.sum() / (most + 1), []
    target, total = stride, w[0]
    for i in range(1, len(v)):
        before, total = total, total + w[i]
        if abs(before - target) < abs(total - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found[:most])


def order_points(df: DataFrame, columns: Sequence[str], fan: str) -> tuple[dict[str, list[float]], list[float]]:
    """Quantiles of the table's columns and the weight of each: a row counts once per partner (``fan``).

    Rows with one number of partners are summarised together, so the weights are exact.
    """
    found = df.groupBy(fan).agg(F.count(F.lit(1)).alias("_rows"), *[
        F.percentile_approx(c, list(QUANTILES), QUANTILE_ACCURACY).alias(c) for c in columns]).collect()
    weights = [r["_rows"] * r[fan] / len(QUANTILES) for r in found for _ in QUANTILES]
    return {c: [v for r in found for v in r[c]] for c in columns}, weights


def lookup_points(df: DataFrame, columns: Sequence[str], weight: str) -> dict[str, list[float]]:
    """Quantiles of the lookup's columns, each row counted ``weight`` times."""
    if not columns:
        return {}
    at = ", ".join(map(repr, QUANTILES))
    row = df.agg(*[F.expr(f"percentile({c}, array({at}), {weight})").alias(c) for c in columns]).first()
    return {c: list(row[c] or ()) for c in columns}


def categorical_features(field_metadata: Mapping) -> dict[int, int]:
    """{feature: number of categories} of a vector column's attributes, as tree learners read them."""
    groups = field_metadata.get("ml_attr", {}).get("attrs", {})
    found = {a["idx"]: len(a["vals"]) if "vals" in a else int(a["num_vals"]) for a in groups.get("nominal", ())}
    return found | {a["idx"]: 2 for a in groups.get("binary", ())}


def _poisson_table(rate: float) -> np.ndarray:
    """Poisson counts by 16 uniform bits."""
    cdf, term = [], exp(-rate)
    for k in range(1, 40):
        cdf.append((cdf[-1] if cdf else 0.0) + term)
        term *= rate / k
    return np.searchsorted(np.array(cdf), (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


def _task(spec: dict):
    """The pass of a level: sums per (tree, node, feature, bin), or per leaf with ``spec["subsets"]`` ``None``."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        trees, bins, n_lookup = spec["trees"], spec["bins"], len(spec["lookup_at"])
        n_features, draws, subsets, sets = len(spec["own"]) + n_lookup, spec["draws"], spec["subsets"], spec["sets"]
        sizes = [(t["nodes"] if subsets is None else subsets[i].size * bins) for i, t in enumerate(trees)]
        sums = [[np.zeros(size) for _ in range(3 if subsets is None else 2)] for size in sizes]

        def mixed(z):
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return z ^ (z >> np.uint64(31))

        def binned(values, how):
            if how[0] == "split":
                return np.searchsorted(how[1], values, side="left")
            return values.astype(np.int64) if how[0] == "value" else how[2][np.searchsorted(how[1], values)]

        def block(x, y, ids):
            """``x``: bins by feature and row, ``y``: labels, ``ids``: a hash of each row's place."""
            m = len(y)
            flat = x.ravel()
            for i, tree in enumerate(trees):
                if draws is None:
                    rows, weight, labels = np.arange(m), None, y
                else:
                    if i % 4 == 0:              # 64 bits serve four trees
                        bits = mixed(ids + np.uint64((spec["seed"] + (i // 4 + 1) * 0x9E3779B97F4A7C15) % 2 ** 64))
                        bits = bits.view(np.uint16).reshape(m, 4)
                    weight = draws.take(bits[:, i % 4])
                    rows = np.flatnonzero(weight)
                    weight, labels = weight.take(rows).astype(np.float64), y.take(rows)
                at = np.zeros(len(rows), np.int64)
                start = tree["feature"] * m     # of the feature's bins in ``flat``
                for _ in range(spec["depth"]):
                    index = start.take(at)
                    index += rows
                    at *= bins
                    at += flat.take(index)
                    at = tree["next"].take(at)
                if subsets is not None:
                    at = tree["slot"].take(at)
                    live = at >= 0
                    if not live.all():
                        at, rows, labels = at[live], rows[live], labels[live]
                        weight = None if weight is None else weight[live]
                total = labels if weight is None else weight * labels
                if subsets is None:
                    for out, w in zip(sums[i], (weight, total, total * labels)):
                        out += np.bincount(at, w, sizes[i])
                    continue
                per_node = subsets[i].shape[1]
                starts, first = (subsets[i].T * m).copy(), at * (per_node * bins)
                for j in range(per_node):
                    if per_node == n_features:
                        key = first + (x[j] if len(rows) == m else x[j].take(rows))
                    else:
                        index = starts[j].take(at)
                        index += rows
                        key = first + flat.take(index)
                    key += j * bins
                    sums[i][0] += np.bincount(key, weight, sizes[i])
                    sums[i][1] += np.bincount(key, total, sizes[i])

        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            labels = column("label").to_numpy(zero_copy_only=False)
            if sets is None:
                partners = column("_bins")
                lookup = partners.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_lookup).T
                ends = partners.offsets.to_numpy().astype(np.int64) // n_lookup
                counts, first = np.diff(ends), ends[:-1] - ends[0]
            else:
                number = column("_set").to_numpy(zero_copy_only=False)
                lookup, counts, first = sets[0], sets[1].take(number), sets[2].take(number)
            own = [binned(column(name).to_numpy(zero_copy_only=False), how) for _, name, how in spec["own"]]
            places = None if draws is None else column("_place").to_numpy(zero_copy_only=False).view(np.uint64)
            ends, start = np.cumsum(counts), 0
            while start < len(labels):
                base = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + spec["block"], side="right")))
                n = counts[start:stop]
                m = int(ends[stop - 1]) - base
                which = np.repeat(np.arange(start, stop), n)
                x = np.empty((n_features, m), np.int16)
                for (at, _, _), values in zip(spec["own"], own):
                    x[at] = values[which]
                place = np.arange(base, base + m) - np.repeat(ends[start:stop] - n, n)
                partner = np.repeat(first[start:stop], n) + place
                for k, at in enumerate(spec["lookup_at"]):
                    x[at] = lookup[k].take(partner)
                ids = None
                if draws is not None:
                    ids = mixed(places[which] + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
                block(x, labels[which], ids)
                start = stop
        offset, keys, parts = 0, [], [[], [], []]
        for size, out in zip(sizes, sums):
            seen = np.flatnonzero(out[0])
            keys.append(seen + offset)
            for k in range(3):
                parts[k].append(out[k][seen] if k < len(out) else np.zeros(len(seen)))
            offset += size
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64())]
                                         + [pa.array(np.concatenate(p)) for p in parts], ["key", "s0", "s1", "s2"])
    return run


def _sums(rows: DataFrame, spec: dict, size: int) -> np.ndarray:
    """The pass ``spec`` over all rows: (sums, ``size``)."""
    parts = rows.mapInArrow(_task(spec), "key long, s0 double, s1 double, s2 double")
    merged = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "s2")]).toArrow()
    out = np.zeros((3, size))
    at = merged.column("key").to_numpy()
    for k, c in enumerate(("s0", "s1", "s2")):
        out[k, at] = merged.column(c).to_numpy()
    return out


def best_split(weight: np.ndarray, total: np.ndarray, features: Sequence[int], bins: Sequence[Bins], least: float,
               least_gain: float) -> tuple[int, np.ndarray] | None:
    """(feature, bins that go left) of the split that lowers the squared error most; ``None`` where none does.

    ``weight`` and ``total`` hold a row per feature: weights and weighted labels by bin.  Categories are put in
    the order of their mean label, those without rows last.
    """
    best, found = None, None
    for w, t, f in zip(weight, total, features):
        n, how = bins[f].size, bins[f]
        w, t = w[:n], t[:n]
        everything = w.sum()
        if n < 2 or everything <= 0:
            continue
        order = np.arange(n) if how.continuous else np.argsort(
            np.where(w > 0, t / np.where(w > 0, w, 1), np.inf), kind="stable")
        wl, tl = np.cumsum(w[order])[:-1], np.cumsum(t[order])[:-1]
        wr, tr = everything - wl, t.sum() - tl
        fits = (wl >= least) & (wr >= least) & (wl > 0) & (wr > 0)
        if not fits.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, (tl * tl / wl + tr * tr / wr - t.sum() ** 2 / everything) / everything, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > max(LEAST_GAIN * (t.sum() / everything) ** 2, 0.0) and gain[k] >= least_gain and (
                best is None or gain[k] > best):
            best, found = gain[k], (int(f), order[:k + 1])
    return found


def _node_rows(tree: Tree, sums: np.ndarray, bins: Sequence[Bins]) -> list[tuple]:
    """The tree as MLlib saves it: nodes in depth-first order; two leaves that predict alike become one."""
    sums = sums.copy()
    for node in reversed(range(len(tree.children))):                # children stand behind their parents
        if tree.children[node] is not None:
            sums[:, node] = sums[:, list(tree.children[node])].sum(axis=1)
    impurity = lambda s: max((s[2] - s[1] * s[1] / s[0]) / s[0], 0.0)
    children = list(tree.children)
    for node in reversed(range(len(children))):
        if children[node] is not None:
            a, b = children[node]
            if children[a] is None and children[b] is None and sums[1, a] / sums[0, a] == sums[1, b] / sums[0, b]:
                children[node] = None
    rows = []

    def put(node: int) -> int:
        at, s = len(rows), sums[:, node]
        rows.append(None)
        fixed = (float(s[1] / s[0]), float(impurity(s)), [float(v) for v in s], int(round(s[0])))
        if children[node] is None:
            rows[at] = (at, *fixed, -1.0, -1, -1, (-1, [], -1))
            return at
        a, b = children[node]
        gain = impurity(s) - sum(sums[0, c] / s[0] * impurity(sums[:, c]) for c in (a, b))
        f, left = tree.feature[node], tree.left[node]
        split = ((f, [float(bins[f].thresholds[len(left) - 1])], -1) if bins[f].continuous
                 else (f, [float(c) for c in left], bins[f].arity))
        first = put(a)
        rows[at] = (at, *fixed, float(max(gain, 0.0)), first, put(b), split)
        return at
    put(0)
    return rows


def _as_model(rows: DataFrame, learner, trees: list[list[tuple]], n_features: int):
    """An MLlib model of the learner's kind with these nodes.

    The learner makes a model of two rows, which brings its class and settings; the nodes of the saved model are replaced.
    """
    spark = rows.sparkSession
    features, label = learner.getFeaturesCol(), learner.getLabelCol()
    few = spark.createDataFrame([(Vectors.dense([v] * n_features), v) for v in (0.0, 1.0)], [features, label])
    made = learner.fit(few)
    path = f"{shared_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    made.write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    ensemble = "nodeData" in schema.names
    names = ("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split")
    split = ("featureIndex", "leftCategoriesOrThreshold", "numCategories")
    nodes = [(i, dict(zip(names, (*r[:-1], dict(zip(split, r[-1])))))) for i, tree in enumerate(trees) for r in tree]
    data = spark.createDataFrame([{"treeID": i, "nodeData": n} if ensemble else n for i, n in nodes], schema).coalesce(1)
    delete_path(spark, f"{path}/data")
    data.write.parquet(f"{path}/data")
    return type(made).load(path)


def numbered_sets(bins: Sequence[Sequence[int]], features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of partners by number, for rows that carry a ``_set``: (bins by feature and partner, their counts, first ones)."""
    counts = np.array([len(b) // features for b in bins], np.int64)
    flat = np.concatenate([np.asarray(b, np.int16) for b in bins]).reshape(-1, features).T.copy()
    return flat, counts, np.cumsum(counts) - counts


def fit_joined(rows: DataFrame, own: Mapping[str, int], lookup_at: Sequence[int], bins: Sequence[Bins], learner,
               sets: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
    """The model that ``learner`` learns from the join of ``rows`` to their partners.

    ``rows``: per row of the table its ``label``, the columns ``own`` (name → place in the vector), ``_bins`` (the bins of
    all its partners one after the other, features as in ``lookup_at``) and, for a bootstrap, ``_place`` (a
    hash of the row's place).  ``bins`` says of each feature how values become bins.  A lookup that may be sent to
    every task comes as ``sets`` (``numbered_sets``), and rows then name their partners by ``_set``.
    """
    get = learner.getOrDefault
    if learner.isDefined("minWeightFractionPerNode") and get("minWeightFractionPerNode") > 0 or (
            learner.hasParam("weightCol") and learner.isDefined("weightCol") and get("weightCol")):
        raise ValueError("row weights are not supported here")
    widest = max(b.size for b in bins)
    if widest > get("maxBins"):
        raise ValueError(f"maxBins {get('maxBins')} is below the {widest} categories of a feature")
    if widest > MOST_BINS:
        raise ValueError(f"a bin must fit two bytes, and a feature has {widest}")
    many = learner.hasParam("numTrees")
    n_trees, n_features, seed = (get("numTrees") if many else 1), len(bins), int(get("seed"))
    bootstrap = many and get("bootstrap")
    rate = get("subsamplingRate") if many else 1.0
    if not bootstrap and rate < 1.0:
        raise ValueError("a share of the rows without a bootstrap is not supported here")
    strategy = get("featureSubsetStrategy") if many else "all"
    per_node = {"all": n_features, "onethird": ceil(n_features / 3),
                "auto": ceil(n_features / 3) if n_trees > 1 else n_features}.get(strategy)
    if per_node is None:
        raise ValueError(f"feature subsets {strategy!r} are not supported here")
    spec = {"own": [(at, name, bins[at].spec()) for name, at in own.items()], "lookup_at": list(lookup_at), "bins": widest,
            "sets": sets, "draws": _poisson_table(rate) if bootstrap else None, "seed": seed % 2 ** 32, "block": BLOCK_ROWS}
    rows = rows.select("label", *own, "_bins" if sets is None else "_set", *(["_place"] if bootstrap else []))
    trees = [Tree(widest) for _ in range(n_trees)]
    depth = 0
    for depth in range(get("maxDepth") + 1):
        if depth == get("maxDepth") or not any(t.active for t in trees):
            break
        subsets, tables = [], []
        for i, tree in enumerate(trees):
            slots = np.full(len(tree.feature), -1)
            slots[tree.active] = np.arange(len(tree.active))
            tables.append(tree.tables() | {"slot": slots})
            subsets.append(np.array([np.sort(np.random.default_rng([seed % 2 ** 32, i, node]).choice(
                n_features, per_node, replace=False)) for node in tree.active]).reshape(len(tree.active), per_node))
        spec |= {"trees": tables, "subsets": subsets, "depth": depth}
        found = _sums(rows, spec, sum(s.size for s in subsets) * widest)
        offset = 0
        for tree, subset in zip(trees, subsets):
            size = subset.size * widest
            sums = found[:, offset:offset + size].reshape(3, len(tree.active), per_node, widest)
            offset, grown = offset + size, []
            for k, node in enumerate(tree.active):
                chosen = best_split(sums[0, k], sums[1, k], subset[k], bins, get("minInstancesPerNode"), get("minInfoGain"))
                if chosen is not None:
                    tree.split(node, *chosen)
                    grown += tree.children[node]
            tree.active = grown
    spec |= {"trees": [t.tables() for t in trees], "subsets": None, "depth": depth}
    sizes = [len(t.feature) for t in trees]
    found, offset, nodes = _sums(rows, spec, sum(sizes)), 0, []
    if not found[0].any():
        raise ValueError("no rows to learn from")
    for tree, size in zip(trees, sizes):
        nodes.append(_node_rows(tree, found[:, offset:offset + size], bins))
        offset += size
    return _as_model(rows, learner, nodes, n_features)
