"""Operator 11 — cross-tokenizer alignment, pairs counted by external spill counting.

Every text is encoded by two vocabularies, A (byte-level pairs, on blank +
text) and B (pieces, which adds the blank itself).  Byte offsets where tokens
of both end cut a text into groups; an A and a B token are linked when their
byte ranges overlap.  A pair of ids counts once per document that holds it
linked; the best pairs of an A id are those of its highest count.

1. *Encode and spill.*  A task encodes batches of texts and keeps a record
   (A id, B id, document, links) per pair and document.  When ``SPILL``
   records are held they are sorted by A, then B, then document, cut into
   ``RADIX`` parts by A id and written as zstd runs, one table row a run, to
   the shared folder: the spill survives a lost executor, no local file is used.
2. *Count.*  Each task merges the runs it reads, part by part, by a k-way
   heap merge over blocks of pairs (the run whose block ends first bounds what
   is complete) to one count per pair.  Only these pre-aggregated counts are
   shuffled, so a token that stands in every document costs one entry per
   task and partner.  A second merge per part adds them up; the order by A
   yields the highest count of an A id when its last pair has passed.
3. *Contributions back.*  Runs meet the counts of their part in cells of at
   most ``CELL_RUNS`` runs (a part with many runs fills many cells and its
   counts are repeated for each), streamed one run at a time.  A run
   yields per document how many links are best and the sum of their counts;
   the sums per document are joined with what step 1 wrote about it.

Bounds: a task holds ``SPILL`` records, or one run and the counts of one part
(at most ceil(|A| / RADIX) · |B| entries, in practice a few thousand).  The
vocabularies are read on the driver and shipped as they are.

tiktoken runs the byte-level vocabulary (the file's own entries and merge
order are its ranks; equal to the tokenizers library on every code point, three
times as fast).  Special strings in a text are plain text.

Cases: texts that are null, empty, or whose joined token bytes differ from
blank + text (U+2581 or what a normaliser changes) have no tokens: zeros and an
empty string; equal rows are separate documents and each counts; null ids are
carried; an empty table gives an empty result; columns other than ``keep`` are
dropped, and those must not be called like the results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.session import materialize

MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
RADIX = 256                        # parts by A id
SPILL = 1 << 21                    # records (and links) held before a task writes its runs
TEXTS = 64                         # texts encoded at once
BLOCK = 4096                       # pairs of a run that a merge decodes at once
CELL_RUNS = 64                     # runs that meet a part's counts in one cell
# The split of texts into words before merging that the byte-level vocabulary is defined with (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

RESULT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RUN = "batch string, part int, n long, run binary"


# --- vocabularies ------------------------------------------------------------

def byte_letters() -> dict[str, int]:
    """Printable stand-in → byte of byte-level vocabularies: printable Latin-1 stands for itself."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabularies:
    """Both models as bytes to ship, opened on first use in each process."""

    def __init__(self, path_a: str, path_b: str) -> None:
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        special = {t["id"] for t in model["added_tokens"]}
        self.ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items()
                      if i not in special}
        with open(path_b, "rb") as f:
            self.proto = f.read()
        self._open = None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "proto": self.proto, "_open": None}

    def opened(self):
        if self._open is None:
            import sentencepiece
            import tiktoken

            a = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
            b = sentencepiece.SentencePieceProcessor(model_proto=self.proto)
            table_a = [b""] * (max(self.ranks.values()) + 1)
            for token, i in self.ranks.items():
                table_a[i] = token
            table_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                       else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
            self._open = (a, b, Table(table_a), Table(table_b))
        return self._open


class Table:
    """Bytes, byte lengths and decimal digits of the ids of one vocabulary."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        names = [str(i).encode() for i in range(len(tokens))]
        self.name_lengths = np.array([len(n) for n in names], np.int64)
        self.names = np.zeros((len(tokens), 6), np.uint8)
        for i, n in enumerate(names):
            self.names[i, :len(n)] = np.frombuffer(n, np.uint8)


# --- one batch of texts ------------------------------------------------------

def token_ids(texts: Sequence[str | None], vocabularies: Vocabularies) -> tuple[list[list[int]], list[list[int]]]:
    """A and B ids of every text; none where the joined bytes differ from blank + text."""
    a, b, table_a, table_b = vocabularies.opened()
    spaced = [" " + t if t else "" for t in texts]
    ids_a = [a.encode_ordinary(s) if s else [] for s in spaced]
    ids_b = b.encode([t or "" for t in texts], num_threads=1)
    for i, s in enumerate(spaced):
        raw = s.encode("utf-8", "surrogatepass")
        if (b"".join(map(table_b.tokens.__getitem__, ids_b[i])) != raw
                or b"".join(map(table_a.tokens.__getitem__, ids_a[i])) != raw):
            ids_a[i], ids_b[i] = [], []
    return ids_a, ids_b


class Aligned:
    """Groups and links of a batch, as arrays over all of its texts."""

    def __init__(self, ids_a: list[list[int]], ids_b: list[list[int]], table_a: Table, table_b: Table) -> None:
        self.n_a = np.array([len(x) for x in ids_a], np.int64)
        self.n_b = np.array([len(x) for x in ids_b], np.int64)
        self.a = np.fromiter((i for x in ids_a for i in x), np.int64, self.n_a.sum())
        self.b = np.fromiter((i for x in ids_b for i in x), np.int64, self.n_b.sum())
        # Texts stand one after the other, so an offset names a text, too.
        ends_a, ends_b = np.cumsum(table_a.lengths[self.a]), np.cumsum(table_b.lengths[self.b])
        ends = np.union1d(ends_a, ends_b)                  # one per link: the bytes up to it, in one token of each
        self.link_a, self.link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)      # ends of groups
        self.doc_of_a = np.repeat(np.arange(len(ids_a)), self.n_a)
        self.link_doc = self.doc_of_a[self.link_a]
        self.n_links = np.bincount(self.link_doc, minlength=len(ids_a))
        self.last_a, self.last_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        self.n_groups = np.bincount(self.doc_of_a[self.last_a], minlength=len(ids_a))
        self.tables = table_a, table_b

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        table_a, table_b = self.tables
        n, m, g = len(self.a), len(self.b), len(self.last_a)
        # A tokens come behind the B tokens of the groups before, B tokens behind the A tokens of their own.
        group_a = np.repeat(np.arange(g), np.diff(self.last_a, prepend=-1))
        group_b = np.repeat(np.arange(g), np.diff(self.last_b, prepend=-1))
        place_a = np.arange(n) + np.concatenate([[0], self.last_b + 1])[group_a]
        place_b = np.arange(m) + (self.last_a + 1)[group_b]
        names = np.zeros((n + m, 7), np.uint8)
        lengths = np.zeros(n + m, np.int64)
        for place, ids, table, last, mark in ((place_a, self.a, table_a, self.last_a, b"|"),
                                              (place_b, self.b, table_b, self.last_b, b";")):
            names[place, :6] = table.names[ids]
            lengths[place] = table.name_lengths[ids]
            names[place, lengths[place]] = ord(",")
            names[place[last], lengths[place[last]]] = mark[0]
        flat = names[np.arange(7) <= lengths[:, None]].tobytes()
        stop = np.concatenate([[0], np.cumsum(lengths + 1)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [flat[s:max(s, e - 1)] for s, e in zip(stop.tolist(), stop[1:].tolist())]     # without the last ;


def aligned(texts: Sequence[str | None], vocabularies: Vocabularies) -> Aligned:
    _, _, table_a, table_b = vocabularies.opened()
    return Aligned(*token_ids(texts, vocabularies), table_a, table_b)


# --- runs --------------------------------------------------------------------

def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame: their lengths, then each in the smallest unsigned type."""
    import zstandard
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for x in arrays:
        kind = next(k for k in (1, 2, 4, 8) if k == 8 or int(x.max(initial=0)) < 1 << (8 * k))
        out.append(np.array([kind, len(x)], np.int64).tobytes())
        out.append(x.astype(f"u{kind}").tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpacked(frame: bytes) -> list[np.ndarray]:
    import zstandard
    raw, at, out = zstandard.ZstdDecompressor().decompress(frame), 8, []
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        kind, n = np.frombuffer(raw, np.int64, 2, at).tolist()
        out.append(np.frombuffer(raw, f"u{kind}", n, at + 16).astype(np.int64))
        at += 16 + kind * n
    return out


class Spill:
    """Records of a task until they are written as sorted runs."""

    def __init__(self, size: int, spill: int) -> None:
        self.size, self.spill = size, spill               # ids of B, records held
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = self.docs = 0

    def add(self, batch: Aligned) -> None:
        """Records of a batch: (pair, document, links), documents numbered in the order they come."""
        pair = batch.a[batch.link_a] * self.size + batch.b[batch.link_b]
        docs = len(batch.n_a)
        keys, links = np.unique(pair * docs + batch.link_doc, return_counts=True)
        self.held.append((keys // docs, keys % docs + self.docs, links))
        self.n += len(keys)
        self.docs += docs

    def full(self) -> bool:
        return self.n >= self.spill or self.docs >= self.spill

    def runs(self, radix: int) -> Iterator[tuple[int, int, bytes]]:
        """(part, records, run) of every part with records; the spill is empty afterwards."""
        pair, doc, links = (np.concatenate([h[k] for h in self.held]) for k in range(3))
        self.held, self.n, self.docs = [], 0, 0
        # Documents ascend already, so a stable sort by part and pair is enough.
        part = pair // self.size % radix
        order = np.argsort(part * (1 << 48) + pair, kind="stable")
        pair, doc, links, part = pair[order], doc[order], links[order], part[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
            first = np.flatnonzero(np.diff(pair[s:e], prepend=-1))
            yield int(part[s]), e - s, _packed(np.diff(pair[s:e][first], prepend=0), np.diff(first, append=e - s),
                                               doc[s:e], links[s:e])


def _pairs_of(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, records of each, documents, links) of a run."""
    step, n, doc, links = _unpacked(run)
    return np.cumsum(step), n, doc, links


def _blocks(run: bytes, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step, n = _unpacked(run)[:2]
    pairs = np.cumsum(step)
    for s in range(0, len(pairs), block):
        yield pairs[s:s + block], n[s:s + block]


def merge_counts(runs: Iterable[bytes], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, counts) in ascending order over all runs: a k-way heap merge of blocks.

    The heap gives the run whose block ends first; up to that end every run's
    pairs are known, so they are taken, sorted and summed at once.
    """
    heap: list[tuple[int, int]] = []
    sources = [_blocks(run, block) for run in runs]
    current: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(sources)

    def advance(i: int) -> None:
        current[i] = next(sources[i], None)
        if current[i] is not None:
            heapq.heappush(heap, (int(current[i][0][-1]), i))

    for i in range(len(sources)):
        advance(i)
    while heap:
        end = heap[0][0]
        taken = []
        for i, held in enumerate(current):
            if held is None:
                continue
            cut = int(np.searchsorted(held[0], end, side="right"))
            if cut:
                taken.append((held[0][:cut], held[1][:cut]))
                current[i] = (held[0][cut:], held[1][cut:])
        pairs, counts = (np.concatenate([t[k] for t in taken]) for k in range(2))
        found, place = np.unique(pairs, return_inverse=True)
        yield found, np.bincount(place, counts, len(found)).astype(np.int64)
        while heap and heap[0][0] == end:
            advance(heapq.heappop(heap)[1])


def with_best(merged: Iterable[tuple[np.ndarray, np.ndarray]], size: int) \
        -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs, counts, best): an A id's pairs are held until the next A id comes, then its highest count is known."""
    rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def judged(pairs, counts):
        first = np.flatnonzero(np.diff(pairs // size, prepend=-1))
        most = np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(pairs)))
        return pairs, counts, (counts == most).astype(np.int64)

    for pairs, counts in merged:
        pairs, counts = np.concatenate([rest[0], pairs]), np.concatenate([rest[1], counts])
        cut = int(np.searchsorted(pairs, pairs[-1] // size * size))
        rest = (pairs[cut:], counts[cut:])
        if cut:
            yield judged(pairs[:cut], counts[:cut])
    if len(rest[0]):
        yield judged(*rest)


# --- the job -----------------------------------------------------------------

def encoded(docs: DataFrame, vocabularies: Vocabularies, keep: Sequence[str] = ("doc_id",), text: str = "text",
            radix: int = RADIX, spill: int = SPILL, with_groups: bool = False) -> DataFrame:
    """One row per document (``part`` null: batch, idx, ``keep``, results) and one per run (batch, part, n, run)."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabularies)
    kept = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    columns = [f.strip().split()[0] for f in RESULT.split(",")]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        task, vocabularies = TaskContext.get().partitionId(), shipped.value
        held, written = Spill(len(vocabularies.opened()[3].tokens), spill), 0

        def runs() -> pd.DataFrame:
            return pd.DataFrame([{"batch": f"{task}-{written}", "part": p, "n": n, "run": r}
                                 for p, n, r in held.runs(radix)], columns=["batch", "part", "n", "run"])

        for rows in batches:
            for s in range(0, len(rows), TEXTS):
                some = rows.iloc[s:s + TEXTS]
                found = aligned(some["text"].tolist(), vocabularies)
                groups = found.groups()
                at = held.docs
                held.add(found)
                out = pd.DataFrame({
                    "batch": f"{task}-{written}", "idx": np.arange(at, at + len(some)), "n_a": found.n_a,
                    "n_b": found.n_b, "n_groups": found.n_groups, "n_links": found.n_links,
                    "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in groups]})
                out["kept"] = some["kept"].tolist() if isinstance(some["kept"], pd.Series) \
                    else some["kept"].to_dict("records")
                out["groups"] = [g.decode() for g in groups] if with_groups else None
                out["part"] = out["n"] = pd.array([None] * len(some), "Int64")
                out["run"] = None
                yield out[["batch", "idx", "kept", "part", "n", "run", *columns, "groups"]]
                if held.full():
                    yield padded(runs())
                    written += 1
        if held.held:
            yield padded(runs())

    def padded(part: pd.DataFrame) -> pd.DataFrame:
        for c in ("idx", *columns[:4]):
            part[c] = pd.array([None] * len(part), "Int64")
        for c in ("kept", "groups", columns[4]):
            part[c] = None
        return part[["batch", "idx", "kept", "part", "n", "run", *columns, "groups"]]

    shape = kept.schema["kept"].dataType.simpleString()
    return kept.mapInPandas(encode, f"batch string, idx long, kept {shape}, part int, n long, run binary, {RESULT}, "
                                    "groups string")


def _count_part(runs: Iterable[bytes], size: int, judge: bool) -> bytes | None:
    """Merged counts of runs, packed: (steps, counts), or (steps, counts, best)."""
    merged = list(with_best(merge_counts(runs), size) if judge else merge_counts(runs))
    if not merged:
        return None
    columns = [np.concatenate(c) for c in zip(*merged)]
    return _packed(np.diff(columns[0], prepend=0), *columns[1:])


def counted(runs: DataFrame, size: int) -> DataFrame:
    """(part, counts): per part the packed counts and best marks of its pairs, in order."""
    def count(judge: bool):
        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, held = None, []
            for rows in batches:
                for p, run in zip(rows["part"], rows["run"]):
                    if p != part:
                        if held:
                            yield pd.DataFrame({"part": [part], "run": [_count_part(held, size, judge)]})
                        part, held = p, []
                    held.append(run)
                    if len(held) >= CELL_RUNS:             # bounds what a task holds of a part
                        held = [_count_part(held, size, False)]
            if held:
                yield pd.DataFrame({"part": [part], "run": [_count_part(held, size, judge)]})
        return merge

    schema = "part int, run binary"
    local = runs.select("part", "run").sortWithinPartitions("part").mapInPandas(count(False), schema)
    return (local.repartition("part").sortWithinPartitions("part").mapInPandas(count(True), schema)
                 .select("part", F.col("run").alias("counts")))


def contributions(runs: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """(batch, idx, n_best, count_sum): what each run adds to its documents, summed."""
    per_part = runs.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL_RUNS).cast("int").alias("cells"))
    table = counts.join(per_part, "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit("").alias("batch"),
        F.col("counts").alias("run"))
    # A row per part, RADIX at most: sent whole.
    asked = runs.join(F.broadcast(per_part), "part").select(
        "part", F.pmod(F.xxhash64("batch"), F.col("cells")).cast("int").alias("cell"), "batch", "run")
    cells = (table.unionByName(asked).repartition("part", "cell")
                  .sortWithinPartitions("part", "cell", "batch"))          # the counts come first

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = counts = best = None
        for rows in batches:
            for batch, frame in zip(rows["batch"], rows["run"]):
                if batch == "":
                    step, counts, best = _unpacked(frame)
                    pairs = np.cumsum(step)
                    continue
                own, n, doc, links = _pairs_of(frame)
                at = np.repeat(np.searchsorted(pairs, own), n)
                docs, place = np.unique(doc, return_inverse=True)
                yield pd.DataFrame({"batch": [batch], "sums": [_packed(
                    docs, _summed(place, links * best[at], len(docs)),
                    _summed(place, links * counts[at], len(docs)))]})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, sums = None, []

        def out() -> pd.DataFrame:
            docs, best, total = (np.concatenate(c) for c in zip(*sums))
            found, place = np.unique(docs, return_inverse=True)
            return pd.DataFrame({"batch": batch, "idx": found, "n_best": _summed(place, best, len(found)),
                                 "count_sum": _summed(place, total, len(found))})
        for rows in batches:
            for name, frame in zip(rows["batch"], rows["sums"]):
                if name != batch:
                    if sums:
                        yield out()
                    batch, sums = name, []
                sums.append(_unpacked(frame))
        if sums:
            yield out()

    # At most one row per part and batch meets here.
    return (cells.mapInPandas(back, "batch string, sums binary").repartition("batch").sortWithinPartitions("batch")
                 .mapInPandas(add_up, "batch string, idx long, n_best long, count_sum long"))


def _summed(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact integer sums of values by place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, values)
    return out


class Alignment:
    """The three steps over one table: ``documents()`` and ``pairs()`` share the runs."""

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, keep: Sequence[str] = ("doc_id",),
                 text: str = "text", radix: int = RADIX, spill: int = SPILL, with_groups: bool = False) -> None:
        vocabularies = Vocabularies(path_a, path_b)
        self.size, self.keep, self.with_groups = len(vocabularies.opened()[3].tokens), list(keep), with_groups
        table = materialize(encoded(docs, vocabularies, keep, text, radix, spill, with_groups), "alignment-runs")
        self.runs = table.where(F.col("part").isNotNull()).select("batch", "part", "n", "run")
        self.texts = table.where(F.col("part").isNull())
        self.counts = materialize(counted(self.runs, self.size), "alignment-counts")

    def documents(self) -> DataFrame:
        """``keep`` columns, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups) per document."""
        back = contributions(self.runs, self.counts, self.size)
        columns = [f.strip().split()[0] for f in RESULT.split(",")]
        found = self.texts.join(back, ["batch", "idx"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        return found.select(*[F.col("kept")[c].alias(c) for c in self.keep], *columns[:4], zero("n_best"),
                            zero("count_sum"), columns[4], *(["groups"] if self.with_groups else []))

    def pairs(self) -> DataFrame:
        """(a_id, b_id, n_docs, best): every linked pair of ids, best per A id."""
        size = self.size

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                for frame in part["counts"]:
                    step, counts, best = _unpacked(frame)
                    pairs = np.cumsum(step)
                    yield pd.DataFrame({"a_id": pairs // size, "b_id": pairs % size, "n_docs": counts,
                                        "best": best > 0})
        return self.counts.select("counts").mapInPandas(rows, "a_id int, b_id int, n_docs long, best boolean")


def align(spark: SparkSession, docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> Alignment:
    """The alignment of ``docs`` by the two public vocabularies."""
    import public_tokenizers

    return Alignment(docs, public_tokenizers.path(MODEL_A), public_tokenizers.path(MODEL_B), keep)
