"""Operator 8 — near-duplicates by SetSketch registers, banding, joint estimation and exact checks.

1. A document's set holds 64-bit hashes of its distinct word shingles.  Its
   sketch has ``REGISTERS`` registers; register *i* is the truncated
   exponent ``floor(1 - log_b(min h_i))`` of the smallest of exponentially
   distributed hash values.  Registers of two sets merge by maximum, and
   equal registers are as likely as the sets are similar.
2. Documents with the same set form one class (an aggregate that combines
   before the shuffle), so thousands of copies go on as one row.
3. Runs of ``BAND_ROWS`` registers are hashed to buckets.  At the least
   similarity asked for (0.8) a pair misses all 40 bands with probability
   1e-7, and less above.
4. In each bucket every member is paired with the smallest one only.  The
   pair's similarity is estimated by joint maximum likelihood over its
   registers; a pair estimated far below the threshold is dropped (seven
   standard errors), all others are checked on their full sets.
5. Confirmed pairs are contracted to components.  Where members of one bucket
   are still in different components, the members outside the bucket's largest
   component meet all others in one task (a large bucket is dealt in blocks by
   blocks of ``BLOCK_ROWS`` members or ``BLOCK_HASHES`` hashes) and all pairs across
   components are compared there: first on the upper halves of their hashes, and
   what passes on the whole ones.  Only a pair that reaches the threshold on
   these joins two components of the block and leaves the task, so a pair
   below it hides no other.  No link between components is lost, pairs inside
   a component are never looked at, and no list of pairs is made.

Scale: no step gathers a group in one task: classes and hubs come from
combinable aggregates, the rest are equi-joins whose large keys adaptive
execution splits.  Components are contracted by joins with pointer jumping, in
logarithmically many rounds, each written; nothing but row counts reaches the driver.

Cases: texts without words (null among them) have an empty set and are linked
with nothing; a row without an id is no node (its component is null, and it
is kept); equal rows share a component, and rows that repeat an id count as
one document; other columns are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType

from shelfcast.llm.common import near, text_or_empty
from shelfcast.llm.hashing import mix64, word_hashes
from shelfcast.session import materialize

# Defaults of near-duplicate stages; the registered query sets its contract's two words.
SHINGLE = 5
QUERY_SHINGLE = 2
SIMILARITY_PCT = 80

REGISTERS = 200
BAND_ROWS = 5
BASE = 1.02                  # exponential spacing of the registers
RATE = 20.0                  # rate of the exponential hash values
TOP = 2 ** 16 - 2            # registers are truncated to 0..TOP + 1
SEED = 11
# Rows of a batch that are turned into results at a time.
SLICE_ROWS = 500
SLACK = 7.0                  # standard errors below the threshold that the estimate may lie
# Members of a bucket that one task compares with as many others.
BLOCK_ROWS = 512
# Hashes in the sets of such a block; a block of long texts has fewer members.
BLOCK_HASHES = 1 << 18
# Up to so many members pairs are intersected one by one, beyond that by a matrix product.
PAIRWISE_ROWS = 24
# Bytes that an id of a broadcast list takes in a task.
ID_BYTES = 24

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(SEED)
_MULTIPLIERS = _rng.integers(0, 2 ** 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _rng.integers(0, 2 ** 32, REGISTERS, dtype=np.uint32)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than ``size`` form one."""
    ids = word_hashes(np.frombuffer(text.encode().translate(_LOWER), np.uint8))
    if not len(ids):
        return ids
    size = min(size, len(ids))
    n = len(ids) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n])
    return np.unique(h)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a non-empty set of hashes."""
    least = np.full(REGISTERS, 2 ** 32 - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        part = short[at:at + 4096]
        for i in range(0, REGISTERS, 25):
            spread = part[None, :] * _MULTIPLIERS[i:i + 25, None] + _OFFSETS[i:i + 25, None]
            least[i:i + 25] = np.minimum(least[i:i + 25], spread.min(axis=1))
    smallest = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


SKETCH = "struct<n:long,signature:binary,registers:binary,hashes:array<long>>"


def sketch(text: Column, size: int, with_set: bool = False) -> Column:
    """Set size, 128-bit digest of the set, registers and, if asked for, the set."""
    columns = ["n", "signature", "registers", "hashes"]

    @pandas_udf(SKETCH)
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                s = shingles(text, size)
                rows.append((len(s), xxhash.xxh128_digest(s.tobytes()), registers(s).tobytes(),
                             s.view(np.int64) if with_set else None) if len(s) else (0, *[None] * 3))
                if len(rows) == SLICE_ROWS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)
    return make(text)


@pandas_udf(ArrayType(LongType()))
def bands(sketches: pd.Series) -> pd.Series:
    """One bucket key for each band of registers."""
    out = []
    for raw in sketches:
        rows = np.frombuffer(raw, np.uint16).reshape(-1, BAND_ROWS).astype(np.uint64)
        h = np.arange(len(rows), dtype=np.uint64) + np.uint64(1)
        for k in range(BAND_ROWS):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
        out.append(h.view(np.int64))
    return pd.Series(out, dtype=object)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs from how many registers are above, below and equal."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        pa, pb = p(u - v * j), p(v - u * j)
        return (above * np.log(np.maximum(pa, 1e-300)) + below * np.log(np.maximum(pb, 1e-300))
                + equal * np.log(np.maximum(1 - pa - pb, 1e-300)))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(60):                                      # the likelihood has one peak
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


@pandas_udf(DoubleType())
def estimated(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    stack = lambda s: np.stack([np.frombuffer(x, np.uint16) for x in s])
    return pd.Series(joint_estimate(stack(a), stack(b), n_a.to_numpy(float), n_b.to_numpy(float)))


def confirm(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The (a, b) pairs (repeated ids may repeat a pair) whose sets share at least ``pct`` percent of their union."""
    side = lambda k: sets.select(*[F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "registers", "hashes")])
    j = pct / 100
    least = j - SLACK * (j * (1 - j) / REGISTERS) ** 0.5
    # A larger set bounds the similarity by the ratio of the sizes.
    close = (pairs.join(side("b"), F.col("b") == F.col("id_b")).drop("id_b")
                 .join(side("a"), F.col("a") == F.col("id_a")).drop("id_a")
                 .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * pct)
                 .where(estimated("registers_a", "registers_b", "n_a", "n_b") >= least))
    shared = F.size(F.array_intersect("hashes_a", "hashes_b"))
    return (close.withColumn("_shared", shared)
                .where(F.col("_shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("_shared")) * pct)
                .select("a", "b"))


def _across(components: list[int], sets: list[np.ndarray], left: list[int], right: list[int], pct: int):
    """Pairs of left and right members (by position) of different components that may reach the threshold."""
    n = np.array([len(x) for x in sets], np.int64)
    slack = 2 + n * n // 2 ** 31                               # hashes of 32 bits may meet
    comp = np.array(components)
    if len(sets) <= PAIRWISE_ROWS:
        for i in left:
            for j in right:
                if comp[i] != comp[j] and min(n[i], n[j]) * 100 >= (max(n[i], n[j]) - slack[i] - slack[j]) * pct:
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) + slack[i] + slack[j]
                    if shared * 100 >= (n[i] + n[j] - shared) * pct:
                        yield i, j
        return
    # Columns of hashes that several members hold; the product counts what each pair shares.
    flat = np.concatenate(sets)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    held = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[held], number[column[held]]
    shared = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(number[-1]) + 1, 1024):          # so many columns at a time
        at = slice(*np.searchsorted(column, [start, start + 1024]))
        a = np.zeros((len(left), 1024), np.float32)
        b = np.zeros((len(right), 1024), np.float32)
        r, c = row[at], column[at] - start
        a[place_l[r[place_l[r] >= 0]], c[place_l[r] >= 0]] = 1
        b[place_r[r[place_r[r] >= 0]], c[place_r[r] >= 0]] = 1
        shared += a @ b.T
    more = shared + slack[left][:, None] + slack[right][None, :]
    near_ = more * 100 >= (n[left][:, None] + n[right][None, :] - more) * pct
    for i, j in zip(*np.nonzero(near_ & (comp[left][:, None] != comp[right][None, :]))):
        yield left[i], right[j]


def _compare(pct: int):
    """Rows sorted by (bucket, lo, hi) → links across components, one for each two components of a block."""
    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return shared * 100 >= (len(a) + len(b) - shared) * pct

    def block(rows: list[tuple]) -> list[tuple[int, int]]:
        ids, comps, parts, full = zip(*rows)
        halves = [np.unique((x.view(np.uint64) >> np.uint64(32)).astype(np.uint32)) for x in full]
        lo, hi = min(parts), max(parts)
        left = [k for k, p in enumerate(parts) if p == lo]
        right = left if lo == hi else [k for k, p in enumerate(parts) if p == hi]
        joined, out = {c: c for c in comps}, []

        def root(c: int) -> int:
            while joined[c] != c:
                c = joined[c]
            return c
        for i, j in _across(list(comps), halves, left, right, pct):
            a, b = root(comps[i]), root(comps[j])
            if a != b and linked(full[i], full[j]):
                joined[max(a, b)] = min(a, b)
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return out

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for batch in batches:
            out = []
            for bucket, lo, hi, *row in zip(*(batch[c] for c in ("bucket", "lo", "hi", "id", "component", "part", "hashes"))):
                if (bucket, lo, hi) != key:
                    out += block(rows) if rows else []
                    key, rows = (bucket, lo, hi), []
                rows.append(tuple(row))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(block(rows) if rows else [], columns=["a", "b"], dtype="int64")
    return compare


def links_across(label: DataFrame, sets: DataFrame, pct: int, block_rows: int = BLOCK_ROWS,
                 block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """Linked pairs (a, b) of components that share a bucket; ``label``: bucket, id, component.

    Members of a bucket's largest component are compared with the others only, so they go
    to as many tasks as the others have blocks (one as a rule), whatever their number.
    """
    per = label.join(sets.select("id", F.col("n").alias("size")), "id").groupBy("bucket", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    split = per.groupBy("bucket").agg(
        F.max(F.struct("n", "component", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"),
        F.count(F.lit(1)).alias("kinds"))
    blocks = lambda n, size: F.ceil(F.greatest(n / block_rows, size / block_hashes))
    split = materialize(split.where("kinds > 1").select(
        "bucket", F.col("main.component").alias("main"), blocks(F.col("main.n"), F.col("main.size")).alias("mains"),
        blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("others")), "near-split")
    # Blocks of the largest component are numbered first, those of the others behind them.
    drawn = F.xxhash64("id", "bucket")
    outside = F.col("component") != F.col("main")
    apart = label.join(split, "bucket").withColumn("part", F.when(
        outside, F.col("mains") + F.pmod(drawn, F.col("others"))).otherwise(F.pmod(drawn, F.col("mains"))))
    first = F.when(outside, F.lit(0).cast("long")).otherwise(F.col("mains"))
    other = F.explode(F.sequence(first, F.col("mains") + F.col("others") - 1))
    dealt = apart.join(sets.select("id", "hashes"), "id").withColumn("other", other).select(
        "bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
        "id", "component", "part", "hashes")
    keys = ["bucket", "lo", "hi"]
    return (dealt.repartition(*keys).sortWithinPartitions(*keys)
                 .mapInPandas(_compare(pct), "a long, b long").distinct())


def to_roots(to: DataFrame) -> DataFrame:
    """(id, to) with smaller or equal ``to`` → the same with the end of each path, by pointer jumping: the length of
    all paths halves each time, so their number is logarithmic."""
    while True:
        ahead = to.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        jumped = materialize(to.join(ahead, F.col("to") == F.col("_id")).select(
            "id", F.col("_to").alias("to"), (F.col("_to") != F.col("to")).alias("moved")), "near-map")
        to = jumped.select("id", "to")
        if not jumped.where("moved").head(1):
            return to


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b), for every id in them.

    Each round sends every node to its smallest neighbour, follows these
    pointers to their ends (``to_roots``) and contracts the graph by that map, until
    no link is left; the maps are then composed.  A chain in the order of its
    ids is contracted by one round of logarithmically many jumps.
    """
    maps = []
    edges = materialize(links.distinct(), "near-links")
    while edges.head(1):
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        to = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("to")), "near-map")
        to = to_roots(to)
        maps.append(to)
        one = edges.join(to, F.col("a") == F.col("id")).select(F.col("to").alias("a"), "b")
        two = one.join(to, F.col("b") == F.col("id")).select("a", F.col("to").alias("b")).where("a != b")
        edges = materialize(two.distinct(), "near-links")
    spark = links.sparkSession
    if not maps:
        return spark.createDataFrame([], "id long, component long")
    out = maps[-1].withColumnRenamed("to", "component")
    for to in reversed(maps[:-1]):
        later = out.withColumnRenamed("id", "to")
        out = to.join(later, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
    return materialize(out, "near-components")


def with_components(docs: DataFrame, size: int = SHINGLE, pct: int = SIMILARITY_PCT, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    body = text_or_empty(text)
    sketched = docs.select("doc_id", sketch(body, size).alias("s")).select(
        "doc_id", F.col("s.n").alias("n"), F.col("s.signature").alias("signature"),
        F.col("s.registers").alias("registers"))
    table = materialize(sketched, "near-sketches")
    classes = materialize(
        table.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("signature")
             .agg(F.min("doc_id").alias("id"), F.any_value("registers").alias("registers")), "near-classes")

    member = materialize(classes.select("id", F.explode(bands("registers")).alias("bucket")), "near-bands")
    # Written before the join, so that adaptive execution can split a bucket that many members share.
    hubs = materialize(member.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last"))
                             .where("hub != last").drop("last"), "near-hubs")
    member = materialize(member.join(hubs, "bucket").select("bucket", "id", "hub"), "near-buckets")
    stars = materialize(member.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(),
                        "near-stars")

    ids = materialize(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-ids")
    full = docs.select(F.col("doc_id").alias("id"), body.alias("body")).join(near(ids, F.lit(ID_BYTES)), "id", "left_semi")
    sets = full.select("id", sketch(F.col("body"), size, with_set=True).alias("s")).where("s.n > 0")
    sets = materialize(sets.select("id", "s.*"), "near-sets")
    if sets.count() > ids.count():                           # rows that repeat an id
        sets = materialize(sets.dropDuplicates(["id", "signature"]), "near-sets")

    links = materialize(confirm(stars, sets, pct), "near-confirmed")
    found = components(links)

    # What the stars left apart: members of a bucket that are in different components.
    label = member.join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    label = materialize(label, "near-labels")
    more = materialize(links_across(label, sets, pct), "near-across")
    if more.head(1):
        found = components(links.union(more))

    owner = (classes.select("signature", "id").join(found, "id", "left")
                    .select("signature", F.coalesce("component", "id").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (table.drop("registers").join(owner, "signature", "left")
                 .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept")))
