"""Operator 4 — benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ``WINDOW`` consecutive words of a benchmark item (an item with
fewer words is one run) is a pattern.  Patterns of one length share tables
keyed by blocks of two words: the shift table tells how far the window can
move so that no pattern end is passed, and where the shift is zero the
bucket of that suffix block holds the patterns to compare directly.  Words
of an occurrence are hit; the items whose patterns occur are listed.

Tables are sorted arrays, not dictionaries: per item word its text once, one
block hash with its shift, and one bucket entry (the place of a pattern, not
the pattern), some 40 bytes a word.  They are built once in every Python
worker, whatever the number of its tasks.

Documents are only scanned: no shuffle, so hot sources or copies cost what
other rows cost.  The pattern side is shipped to the tasks in blocks of at
most ``BLOCK_BYTES`` of item text, measured first; a larger benchmark is
searched block after block, each pass adding to the hits of the one before.

Cases: null and empty text have no words and no hits; items without words
(null text among them) are no patterns; an item without an id still marks
hits but has no id to list; equal item ids count once; equal rows get equal
results; other columns are carried through, and must not be called ``hits``
(that one is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shelfcast.llm.common import text_or_empty
from shelfcast.llm.hashing import mix64, word_hashes
from shelfcast.session import materialize

WINDOW = 10                       # contract value
BLOCK_BYTES = 16 * 1024 * 1024    # item text searched for in one pass: about 120 MB of tables

# UTF-8 bytes: A-Z fold to a-z, other ASCII outside 0-9 a-z separates, the rest stays.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))

HIT = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>>"


def folded(text: str) -> bytes:
    """The words of a text, one blank after each."""
    words = text.encode().translate(_BYTES).split()
    return b" ".join(words) + b" " if words else b""


def words_in(text: str) -> list[bytes]:
    return folded(text).split()


def _block_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end at each word from the ``size``-th on."""
    return h if size == 1 else mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


class Table:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, starts: np.ndarray, n: int, h: np.ndarray) -> None:
        self.n, self.size = n, min(2, n)                   # words of a pattern and of a block
        blocks = _block_hashes(h, self.size)               # blocks[k] ends at word k + size - 1
        # Every block of every pattern, with the words that follow it in the pattern.
        keys = np.concatenate([blocks[starts + k] for k in range(n - self.size + 1)])
        rest = np.repeat(np.arange(n - self.size, -1, -1), len(starts)).astype(np.uint8 if n < 256 else np.int64)
        order = np.lexsort((rest, keys))
        keys, rest = keys[order], rest[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        self.blocks, self.shift = keys[first], rest[first]
        last = blocks[starts + n - self.size]
        order = np.argsort(last, kind="stable")
        self.last, self.starts = last[order], starts[order]

    def shifts(self, h: np.ndarray) -> np.ndarray:
        """How far the window may move whose last block is the k-th block of a text."""
        seen = _block_hashes(h, self.size)
        at = np.minimum(np.searchsorted(self.blocks, seen), len(self.blocks) - 1)
        return np.where(self.blocks[at] == seen, self.shift[at], self.n - self.size + 1)

    def bucket(self, block: np.uint64) -> np.ndarray:
        """Where the patterns start that end with a block."""
        low, high = np.searchsorted(self.last, block, "left"), np.searchsorted(self.last, block, "right")
        return self.starts[low:high]


class Patterns:
    """Tables of one block of items, by pattern length; built on first use in a process."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW) -> None:
        self.items, self.window, self.tables = items, window, None

    def __getstate__(self) -> dict:
        return {"items": self.items, "window": self.window, "tables": None}

    def build(self) -> Patterns:
        if self.tables is not None:
            return self
        texts = [folded(text) for _, text in self.items]
        self.ids = [item_id for item_id, _ in self.items]
        self.text = b"".join(texts)
        data = np.frombuffer(self.text, np.uint8)
        h = word_hashes(data)
        self.after = np.concatenate([[0], np.flatnonzero(data == 32) + 1])    # where each word begins, and the end
        words = np.array([t.count(b" ") for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(words)])                  # first word of each item
        self.tables = []
        lengths = np.minimum(words, self.window)
        for n in np.unique(lengths[lengths > 0]).tolist():
            some = np.flatnonzero(lengths == n)
            count = words[some] - n + 1
            starts = np.repeat(self.first[some] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            self.tables.append(Table(starts, n, h))
        return self

    def search(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of a text, word spans of the occurrences and the ids of their items."""
        raw = folded(text)
        data = np.frombuffer(raw, np.uint8)
        h = word_hashes(data)
        spans, items, begins = [], set(), None
        for table in self.build().tables:
            n, size = table.n, table.size
            if len(h) < n:
                continue
            shift = table.shifts(h).tolist()
            blocks = None
            at = n                                         # end of the window
            while at <= len(h):
                step = shift[at - size]
                if step:
                    at += step
                    continue
                if begins is None:
                    begins = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
                if blocks is None:
                    blocks = _block_hashes(h, size)
                here = raw[begins[at - n]:begins[at]]
                hit = False
                for start in table.bucket(blocks[at - size]).tolist():
                    if self.text[self.after[start]:self.after[start + n]] == here:
                        hit = True
                        item = self.ids[int(np.searchsorted(self.first, start, "right")) - 1]
                        if item is not None:
                            items.add(item)
                if hit:
                    spans.append((at - n, at))
                at += 1
        return len(h), spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of about ``block_bytes`` of text (by hash of the item)."""
    items = benchmark.where(F.octet_length("text") > 0).select(F.col("item_id").cast("string"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for b in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def _searcher(docs: DataFrame, items: list[tuple[str | None, str]]):
    shipped = docs.sparkSession.sparkContext.broadcast(Patterns(items))

    @pandas_udf(HIT)
    def search(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        patterns = shipped.value                           # one object per worker: its tables are kept
        for texts, earlier in batches:
            rows = []
            for text, spans, ids in zip(texts, earlier["spans"], earlier["items"]):
                n_words, found, hit = patterns.search(text)
                found += [(s["start"], s["end"]) for s in spans]
                rows.append((n_words, [{"start": s, "end": e} for s, e in merged(found)],
                             sorted(hit.union(ids))))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])
    return search


def with_contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``hits``: n_words, spans (word positions) and items (ids as strings, sorted)."""
    docs = docs.withColumn("hits", F.struct(F.lit(0).cast("long").alias("n_words"),
                                            F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
                                            F.array().cast("array<string>").alias("items")).cast(HIT))
    for k, items in enumerate(item_blocks(benchmark, block_bytes)):
        if k:
            docs = materialize(docs, "decontam-block")
        docs = docs.withColumn("hits", _searcher(docs, items)(text_or_empty(), F.col("hits")))
    return docs


def n_hit(hits: str = "hits"):
    return F.aggregate(f"{hits}.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
