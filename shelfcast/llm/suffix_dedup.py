"""Operator 9 — removal of repeated 100-byte strings by a distributed merge sort of suffixes.

A byte is removed if a ``LENGTH``-byte string that covers it also starts
earlier in the corpus.  Sorting a suffix for every byte would move the
corpus a hundred times, so suffixes are sampled by content: of the
``KMER``-byte words of a window of ``LENGTH`` bytes the one with the smallest
hash (the leftmost of equals) is the window's anchor.  Equal windows have the
same anchor at the same place, so equal strings are found among suffixes that
start at anchors, about one byte in 36; nothing is lost.

1. Anchors are counted by hash.  Those that occur once cannot lie in a
   repeated string and go no further (a false match only costs time).
2. Every task sorts the suffixes at its other anchors: the bytes from the
   anchor to the end of its last window, then, reversed, those before it
   back to its first window.  Equal suffixes fall together at once: the
   earliest goes on, the others are known to be repeated.
3. The sorted runs are front-coded (length of the prefix shared with the
   suffix before, and the rest) and exchanged; a range of the exchange holds
   all suffixes of its anchors.
4. Each range merges its runs with a loser tree that keeps, at every node, how
   long a prefix the loser shares with the last winner: unequal lengths
   decide without a look at the bytes, equal ones compare from there on.
5. The merged order and its common prefixes tell for every window of every
   suffix which suffixes hold the same window: the same class of prefix
   (LCP to the right) and of reversed prefix (LCP to the left).  All but the
   earliest are removed.

Scale: counting, merging and output are dealt by hash; range and bucket
numbers grow with the corpus bytes, so a task's share stays the same.  Copies
are folded before the exchange, so a group of any size sends at most one
suffix per anchor and run.  The survivors of step 1 reach the texts by a join;
the removed spans (a few per document) by a broadcast while they are small,
measured against ``common.BROADCAST_BYTES``, beyond that by a join.

Cases: null and empty text have no bytes; texts under ``LENGTH`` bytes lose
nothing; rows equal in id and text are one document and get the same result;
rows without an id come last, rows of one id are ordered by a hash of their
text; other columns are carried through, whatever their names (but ``deduped``,
which is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shelfcast.llm.common import near, text_or_empty
from shelfcast.llm.hashing import U, mix64, powers, prefix_sums
from shelfcast.session import materialize

LENGTH = 100                            # contract value
KMER = 32
SPAN = LENGTH - KMER + 1                # k-mers in a window
BUCKET_BYTES = 16 * 1024 * 1024         # corpus bytes per counting bucket and per merge range
RUN_ROWS = 200_000                      # suffixes a task sorts at once
BLOCK = 1 << 17                         # bytes of a text looked at together
NO_ID = 2 ** 63 - 1                     # rows without an id come last

def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first window, last window) of every anchor, in order of windows."""
    parts = []
    for start in range(0, max(len(data) - LENGTH + 1, 0), BLOCK):
        block = data[start:start + BLOCK + LENGTH - 1]
        n = len(block)
        up, down = powers(n + 1)
        sums = prefix_sums(block, up)
        least = hashes = mix64((sums[KMER:] - sums[:n + 1 - KMER]) * down[:n + 1 - KMER])
        at = np.arange(len(hashes), dtype=np.int32)
        width = 1
        while width < SPAN:                               # leftmost minimum of `width` neighbours
            step = min(width, SPAN - width)
            right = least[step:] < least[:-step]
            at = np.where(right, at[step:], at[:-step])
            least = np.where(right, least[step:], least[:-step])
            width += step
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        parts.append((at[first].astype(np.int64) + start, hashes[at[first]], first + start, last + start))
    if not parts:
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(0, U), empty, empty
    return tuple(np.concatenate(x) for x in zip(*parts))


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


# ---------------------------------------------------------------- 1. counting anchors

def _deal_hashes(n_buckets: int):
    """Per batch and bucket: document, ordinal and 32 hash bits of every anchor."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, ordinals, keys = [], [], []
            for doc_id, text in zip(batch["doc"].tolist(), batch["body"]):
                _, h, _, _ = anchors(_bytes(text))
                docs.append(np.full(len(h), doc_id, np.int64))
                ordinals.append(np.arange(len(h), dtype=np.int32))
                keys.append(mix64(h + U(1)))               # minima are small numbers: spread them again
            if not docs:
                continue
            doc, ordinal, key = np.concatenate(docs), np.concatenate(ordinals), np.concatenate(keys)
            bucket = ((key >> U(32)) % U(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
            rows = [(int(bucket[part[0]]), doc[part].tobytes(), ordinal[part].tobytes(),
                     (key[part] & U(0xFFFFFFFF)).astype(np.uint32).tobytes())
                    for part in (np.split(order, cuts[1:]) if len(order) else [])]
            yield pd.DataFrame(rows, columns=["bucket", "docs", "ordinals", "keys"])
    return deal


def _join(column: pd.Series, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype)


def _repeated_hashes(rows: pd.DataFrame) -> pd.DataFrame:
    """Per document of a bucket: the ordinals of anchors whose hash occurs again."""
    doc, ordinal = _join(rows["docs"], np.int64), _join(rows["ordinals"], np.int32)
    key = _join(rows["keys"], np.uint32)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = order[np.r_[False, same] | np.r_[same, False]]
    again = again[np.argsort(doc[again], kind="stable")]
    cuts = np.flatnonzero(np.diff(doc[again])) + 1
    return pd.DataFrame([(int(doc[part[0]]), ordinal[part].tobytes()) for part in np.split(again, cuts) if len(part)],
                        columns=["key", "ordinals"])


# ---------------------------------------------------------------- 2. sorted, front-coded runs

RUN = "group long, n int, shared binary, rest binary, sizes binary, lo binary, hi binary, doc binary, th binary, at binary"


def shared_prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of the prefix that each string shares with the one before."""
    n = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, n)
    width = int(sizes.max())
    table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(n, width)
    shared = np.zeros(n, np.int64)
    differ = table[1:] != table[:-1]
    differ = np.concatenate([differ, np.ones((n - 1, 1), bool)], axis=1)
    shared[1:] = np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    return shared


def encode_run(group: int, strings: list[bytes], lo, hi, doc, th, at) -> tuple:
    shared = shared_prefixes(strings)
    rest = [s[k:] for s, k in zip(strings, shared.tolist())]
    pack = lambda x, t: np.asarray(x, t).tobytes()
    return (group, len(strings), pack(shared, np.uint8), b"".join(rest), pack([len(r) for r in rest], np.uint8),
            pack(lo, np.uint8), pack(hi, np.uint8), pack(doc, np.int64), pack(th, np.int64), pack(at, np.int64))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _sort_runs(n_ranges: int):
    """Sorted runs for the merge (groups 0..n_ranges-1) and spans already known (groups from n_ranges)."""
    columns = [c.split()[0] for c in RUN.split(", ")]

    def runs_of(rows: list[tuple]) -> pd.DataFrame:
        # rows: (range, string, hi, doc, th, at); a string and its hi fix its lo
        rows.sort()
        out, known = [], {}
        begin = 0
        while begin < len(rows):
            end = begin
            kept = []
            while end < len(rows) and rows[end][0] == rows[begin][0]:
                _, s, hi, doc, th, at = rows[end]
                if kept and kept[-1][1] == s and kept[-1][2] == hi:
                    if (doc, th, at) != kept[-1][3:]:        # the same anchor of an equal row is no copy
                        known.setdefault((doc, th), []).append((at - hi, at + len(s) - hi))
                else:
                    kept.append(rows[end])
                end += 1
            _, strings, his, docs, ths, ats = zip(*kept)
            los = [LENGTH - (len(s) - hi) for s, hi in zip(strings, his)]
            out.append(encode_run(rows[begin][0], list(strings), los, his, docs, ths, ats))
            begin = end
        by_group: dict[int, list] = {}
        for (doc, th), spans in known.items():
            by_group.setdefault(n_ranges + doc % n_ranges, []).extend((doc, th, s, e) for s, e in merged(spans))
        for group, spans in by_group.items():
            doc, th, start, end = (np.array(x, np.int64).tobytes() for x in zip(*spans))
            out.append((group, len(spans), b"", b"", b"", start, end, doc, th, b""))
        return pd.DataFrame(out, columns=columns)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for doc, th, text, lists in zip(batch["doc"].tolist(), batch["th"], batch["body"], batch["lists"]):
                data = text.encode()
                at, h, first, last = anchors(np.frombuffer(data, np.uint8))
                picked = np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in lists]))
                picked = picked[picked < len(at)]
                ranges = (mix64(h[picked] + U(2)) % U(n_ranges)).astype(np.int64).tolist()
                for r, p, s, e in zip(ranges, at[picked].tolist(), first[picked].tolist(), last[picked].tolist()):
                    rows.append((r, data[p:e + LENGTH] + data[s:p][::-1], p - s, doc, int(th), p))
                if len(rows) >= RUN_ROWS:
                    yield runs_of(rows)
                    rows = []
        if rows:
            yield runs_of(rows)
    return sort


# ---------------------------------------------------------------- 4. merging with a loser tree

def decode_run(shared: bytes, rest: bytes, sizes: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for k, size in zip(shared, sizes):
        last = last[:k] + rest[at:at + size]
        out.append(last)
        at += size
    return out


def merge_runs(runs: list[tuple[list[bytes], bytes]]) -> tuple[list[tuple[int, int]], list[int], list[bytes]]:
    """Merge sorted runs (strings, prefix shared with the one before).

    Returns (run, index) in sorted order, the prefix each string shares with
    the one before it, and the strings.  A node keeps its loser and how much
    that shares with the last winner; the candidate's own figure comes from
    its run's front coding, so known prefixes are never compared again.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    fronts = [r[1] for r in runs]
    heads: list[bytes | None] = [s[0] if s else None for s in strings]
    index = [0] * k
    loser, prefix = [0] * k, [0] * k            # by node 1..k-1

    def play(a: int, b: int, known: int) -> tuple[int, int, int]:
        """Winner, loser and what they share, given that both share ``known`` bytes."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a, 0) if x is None else (a, b, 0)
        if x == y:
            return (a, b, len(x)) if a < b else (b, a, len(x))
        end = min(len(x), len(y))
        while known < end and x[known] == y[known]:
            known += 1
        return (a, b, known) if x[known:known + 1] < y[known:known + 1] else (b, a, known)

    winners = list(range(k))
    width = k
    while width > 1:
        width //= 2
        for i in range(width):
            w, lo, h = play(winners[2 * i], winners[2 * i + 1], 0)
            loser[width + i], prefix[width + i] = lo, h
            winners[i] = w
    best, known = winners[0], 0
    order, shared, out = [], [], []
    while heads[best] is not None:
        order.append((best, index[best]))
        shared.append(known)
        out.append(heads[best])
        i = index[best] = index[best] + 1
        if i < len(strings[best]):
            heads[best], known = strings[best][i], fronts[best][i]
        else:
            heads[best], known = None, -1
        node = (k + best) // 2
        while node:
            other, h = loser[node], prefix[node]
            if heads[other] is None:
                pass                                        # an empty run loses
            elif known < h:                                 # the loser is nearer to the last winner
                loser[node], prefix[node] = best, max(known, 0)
                best, known = other, h
            elif known == h:
                w, lo, common = play(best, other, known)
                loser[node], prefix[node] = lo, common
                best = w
            node //= 2
        # known: what the new winner shares with the last one
    return order, shared, out


# ---------------------------------------------------------------- 5. classes of windows

def repeated_windows(shared: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray,
                     place: np.ndarray) -> np.ndarray:
    """[suffix, bytes before the anchor]: does the window also start at an earlier place?

    ``shared``: prefixes in sorted order; ``left``: reversed bytes before the
    anchors (padded table); ``place``: rank of the anchor's place in the corpus.
    """
    n = len(lo)
    words = np.zeros((n, -(-SPAN // 8) * 8), np.uint8)
    words[:, :left.shape[1]] = left
    by_left = np.lexsort(words.view(">u8").T[::-1])
    differ = words[by_left][1:] != words[by_left][:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    flagged = np.zeros((n, SPAN), bool)
    by_place = np.argsort(place, kind="stable")
    for k in range(SPAN):
        rows = by_place[(lo[by_place] <= k) & (k <= hi[by_place])]
        if len(rows) < 2:
            continue
        right_class = np.cumsum(np.r_[0, shared[1:] < LENGTH - k])
        left_class = np.empty(n, np.int64)
        left_class[by_left] = np.cumsum(np.r_[0, same < k])
        window = right_class[rows] * n + left_class[rows]
        order = np.argsort(window, kind="stable")           # of one window, the earliest place first
        later = window[order][1:] == window[order][:-1]
        flagged[rows[order[1:][later]], k] = True
    return flagged


def _merge_range(n_ranges: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        names = ["doc", "th", "start", "end"]
        if rows["group"].iloc[0] >= n_ranges:                # spans found while sorting
            return pd.DataFrame(dict(zip(names, (_join(rows[c], np.int64) for c in ("doc", "th", "lo", "hi")))))
        runs = [(decode_run(a, b, c), a) for a, b, c in zip(rows["shared"], rows["rest"], rows["sizes"])]
        order, shared, strings = merge_runs(runs)
        base = np.r_[0, np.cumsum(rows["n"])]
        at = np.fromiter((base[r] + i for r, i in order), np.int64, len(order))
        lo, hi = (_join(rows[c], np.uint8)[at].astype(np.int64) for c in ("lo", "hi"))
        doc, th, pos = (_join(rows[c], np.int64)[at] for c in ("doc", "th", "at"))
        by_place = np.lexsort((lo, pos, th, doc))
        new = np.r_[True, np.any(np.diff(np.stack([doc, th, pos])[:, by_place], axis=1) != 0, axis=0)]
        place = np.empty(len(at), np.int64)
        place[by_place] = np.cumsum(new) - 1
        # Equal rows of the table bring the same place with the same windows: one is enough.
        once = np.r_[True, np.diff(lo[by_place]) != 0] | new
        use = np.zeros(len(at), bool)
        use[by_place[once]] = True
        left = np.frombuffer(b"".join(s[len(s) - h:].ljust(SPAN, b"\0") if h else bytes(SPAN)
                                      for s, h in zip(strings, hi.tolist())), np.uint8).reshape(-1, SPAN)
        hi = np.where(use, hi, -1)                           # a window range that holds nothing
        flagged = repeated_windows(np.array(shared), left, lo, hi, place)
        edge = np.diff(np.pad(flagged, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1] - 1
        return pd.DataFrame(dict(zip(names, (doc[row], th[row], pos[row] - end, pos[row] - begin + LENGTH))))
    return merge


# ---------------------------------------------------------------- the operator

def removed_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, th, spans): merged byte spans to remove, of documents that lose bytes."""
    spark = docs.sparkSession
    body = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(text_or_empty(text)).alias("th"), text_or_empty(text).alias("body")) \
               .where(F.octet_length("body") >= LENGTH)
    total = body.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    dealt = body.select("doc", "body").mapInPandas(
        _deal_hashes(parts), "bucket long, docs binary, ordinals binary, keys binary")
    again = (dealt.groupBy("bucket").applyInPandas(_repeated_hashes, "key long, ordinals binary")
                  .groupBy("key").agg(F.collect_list("ordinals").alias("lists")))
    again = materialize(again, "suffix-anchors")
    chosen = body.join(again, F.col("doc") == F.col("key")).select("doc", "th", "body", "lists")

    runs = chosen.mapInPandas(_sort_runs(parts), RUN)
    found = runs.groupBy("group").applyInPandas(_merge_range(parts), "doc long, th long, start long, end long")
    spans = found.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    @pandas_udf("array<struct<start:long,end:long>>")
    def union(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in row])]
                          for row in lists], dtype=object)
    return materialize(spans.select("doc", "th", union("spans").alias("spans")), "suffix-spans")


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``deduped``: n_bytes, n_removed, n_spans and kept (the remaining bytes)."""
    spans = removed_spans(docs, text)
    small = near(spans, F.size("spans").cast("long") * 24 + 48)
    # The whole row as one column: none of its names can clash.
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != "deduped"]).alias("row"),
                        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text_or_empty(text)).alias("key"))
    joined = whole.join(small, (F.col("id") == F.col("doc")) & (F.col("key") == F.col("th")), "left")

    @pandas_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            rows = []
            for text, row in zip(texts, lists):
                data, keep, at, gone = text.encode(), [], 0, 0
                for s in (row if row is not None else ()):
                    keep.append(data[at:s["start"]])
                    at = s["end"]
                    gone += s["end"] - s["start"]
                keep.append(data[at:])
                rows.append((len(data), gone, len(keep) - 1, b"".join(keep)))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
    body = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    return joined.select("row", cut(body, F.col("spans")).alias("deduped")).select("row.*", "deduped")
