"""Operators over the whole corpus against brute-force versions: decontamination, near-duplicates."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.session import materialize

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("block_bytes", [None, 40])
def test_benchmark_hits(spark, run, documents, folder, block_bytes, monkeypatch):
    if block_bytes:
        from shelfcast.llm import decontam
        block_bytes = block_bytes if "edge" in folder else 4000
        monkeypatch.setattr(decontam.with_contamination, "__defaults__", (block_bytes,))
    items = [(r["item_id"], alnum(r["text"])) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {}
    for item_id, words in items:
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i:i + n]), set()).add(item_id)
    wanted = []
    for doc_id, text, _ in documents(folder):
        words, hit, found = alnum(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                ids = windows.get(tuple(words[i:i + n]))
                if ids is not None:
                    hit |= set(range(i, i + n))
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        wanted.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                       bool(hit)))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert run("op4_benchmark_hits", folder, columns) == sorted(wanted, key=repr)


def test_pattern_tables_are_small_and_kept():
    """Tables a few times the text, equal to comparing all windows; one build serves every task of a worker."""
    import pickle
    from shelfcast.llm.decontam import Patterns, words_in
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(50_000)]
    items = [(str(k), " ".join(rng.choice(vocabulary, rng.integers(1, 400)))) for k in range(1500)] + [(None, "only one")]
    patterns = pickle.loads(pickle.dumps(Patterns(items))).build()
    text_bytes = sum(len(t) for _, t in items)
    held = sum(x.nbytes for t in patterns.tables for x in (t.blocks, t.shift, t.last, t.starts)) + patterns.after.nbytes
    assert held < 12 * text_bytes
    tables = patterns.tables
    windows = {}
    for item, text in items:
        words = words_in(text)
        n = min(10, len(words))
        for i in range(len(words) - n + 1):
            windows.setdefault(tuple(words[i:i + n]), set()).add(item)
    for k in range(60):
        pieces = [" ".join(rng.choice(vocabulary, 30))]
        for _ in range(3):
            words = items[rng.integers(0, len(items))][1].split()
            s = int(rng.integers(0, len(words)))
            pieces += ["; ".join(words[s:s + int(rng.integers(1, 40))]), " ".join(rng.choice(vocabulary, 5))]
        text = " ".join(pieces)
        words = words_in(text)
        spans, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                ids = windows.get(tuple(words[i:i + n]))
                if ids:
                    spans.add((i, i + n))
                    found |= ids - {None}
        got = patterns.search(text)
        assert (got[0], set(got[1]), got[2]) == (len(words), spans, found)
    assert patterns.tables is tables and patterns.search("") == (0, [], set())


def shingle_set(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute_components(rows, size):
    """rows: (doc_id, text); every pair is compared."""
    sets = [(d, shingle_set(t, size)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return [(d, len(shingle_set(t, size)), root(d) if d is not None else None, d is None or root(d) == d)
            for d, t in rows]


def test_near_duplicates(run, documents, folder):
    wanted = brute_components([(d, t) for d, t, _ in documents(folder)], 2)
    found = run("op8_near_duplicates", folder, ["doc_id", "n_shingles", "component_id", "kept"])
    assert found == sorted(wanted, key=repr)


def test_chains_and_hot_groups(spark):
    """A chain whose ends are not similar, and near copies beside a hub that many share."""
    from shelfcast.llm.near_dup import with_components
    rng = np.random.default_rng(3)
    rows, words = [], [f"w{i}" for i in range(400)]
    for k in range(25):                                    # each step moves on by 8 of 120 words
        rows.append((1000 + k, " ".join(words[8 * k:8 * k + 120])))
    base = [f"h{i}" for i in range(90)]
    for k in range(120):
        copy = list(base)
        for at in rng.choice(90, rng.integers(0, 7), replace=False):
            copy[at] = f"x{rng.integers(0, 50)}"
        rows.append((2000 + k, " ".join(copy)))
    rows += [(10 + k, f"alone a{k} b{k} c{k} d{k} e{k}") for k in range(30)]
    found = with_components(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(rows, 2))


def test_sketch_estimates_and_merges():
    from shelfcast.llm.near_dup import joint_estimate, registers
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2 ** 63, 3000, dtype=np.uint64)
    for overlap, size_a, size_b in ((500, 600, 700), (1000, 1000, 1200), (50, 400, 900)):
        a, b = pool[:size_a], pool[size_a - overlap:size_a - overlap + size_b]
        true = overlap / (size_a + size_b - overlap)
        got = joint_estimate(registers(a)[None], registers(b)[None], np.array([size_a]), np.array([size_b]))[0]
        assert abs(got - true) < 0.12
        assert (registers(np.union1d(a, b)) == np.maximum(registers(a), registers(b))).all()


def brute_bytes(rows, length=100):
    """Positions covered by a string that starts earlier; rows equal in id and text are one document."""
    from collections import defaultdict
    unique = sorted({(2 ** 63 - 1 if d is None else d, t or "") for d, t in rows},
                    key=lambda r: (r[0], r[1]))
    first, result = {}, {}
    for doc, text in unique:
        data = text.encode()
        hit = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first.setdefault(data[i:i + length], (doc, i)) != (doc, i):
                hit[i:i + length] = b"\1" * length
        result[doc, text] = data, hit
    out = []
    for d, t in rows:
        data, hit = result[2 ** 63 - 1 if d is None else d, t or ""]
        spans = sum(1 for i, x in enumerate(hit) if x and (i == 0 or not hit[i - 1]))
        kept = bytes(b for b, x in zip(data, hit) if not x)
        out.append((d, len(data), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_bytes(run, documents, folder):
    wanted = brute_bytes([(d, t) for d, t, _ in documents(folder)])
    found = run("op9_repeated_bytes", folder, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert found == sorted(wanted, key=repr)


def test_passages_in_varied_contexts(spark, monkeypatch):
    """Repeats that start and end anywhere, overlap, and touch a text's ends; small runs and blocks."""
    from shelfcast.llm import suffix_dedup as sd
    monkeypatch.setattr(sd, "RUN_ROWS", 50)
    monkeypatch.setattr(sd, "BLOCK", 700)
    rng = np.random.default_rng(5)
    letters = list("abcdefg é")
    noise = lambda n: "".join(rng.choice(letters, n))
    passages = [noise(n) for n in (99, 100, 101, 150, 400, 1500)]
    rows = []
    for d in range(60):
        text = ""
        for _ in range(rng.integers(1, 6)):
            p = passages[rng.integers(0, len(passages))]
            a = rng.integers(0, 40)
            text += p[a:] if rng.random() < 0.5 else p[:len(p) - a]
            text += noise(int(rng.integers(0, 30)))
        rows.append((int(rng.integers(0, 10 ** 6)) * 100 + d, text))
    rows += [(5, "ab" * 400), (6, "ab" * 300), (7, "x" * 1500)]
    found = sd.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select(
        "doc_id", "deduped.n_bytes", "deduped.n_removed", "deduped.n_spans", "deduped.kept").collect()
    found = sorted((r[0], r[1], r[2], r[3], hashlib.sha256(bytes(r[4])).hexdigest()) for r in found)
    assert found == sorted(brute_bytes(rows))


def test_loser_tree_merges_and_shares():
    from shelfcast.llm.suffix_dedup import merge_runs, shared_prefixes
    rng = np.random.default_rng(2)
    for k in (1, 2, 3, 7):
        runs = []
        for _ in range(k):
            strings = sorted("".join(rng.choice(list("ab"), rng.integers(1, 9))).encode() for _ in range(rng.integers(1, 60)))
            runs.append((strings, shared_prefixes(strings).astype(np.uint8).tobytes()))
        order, shared, strings = merge_runs(runs)
        assert strings == sorted(s for r in runs for s in r[0])
        assert [runs[r][0][i] for r, i in order] == strings
        assert shared == shared_prefixes(strings).tolist()


def window_lines(rows, min_words):
    """The same by hashing: lines of the shortest windows that also stand at an earlier position."""
    from shelfcast.llm.line_runs import lines_with_words, shortest_windows
    docs = sorted({(d is None, d or 0, t or "") for d, t in rows})
    first, gone = {}, {}
    held = [(key, lines_with_words(key[2])) for key in docs]
    for later in (False, True):
        for key, lines in held:
            for lo, hi in shortest_windows([n for _, _, n in lines], min_words):
                window = tuple(x for _, x, _ in lines[lo:hi + 1])
                if not later:
                    first[window] = min(first.get(window, (key, lo)), (key, lo))
                elif first[window] != (key, lo):
                    gone.setdefault(key, set()).update(range(lo, hi + 1))
    out = []
    for d, t in rows:
        key = (d is None, d or 0, t or "")
        lines = lines_with_words(key[2])
        mine = {lines[k][0]: lines[k][2] for k in gone.get(key, ())}
        kept = "\n".join(x for at, x in enumerate(key[2].split("\n")) if at not in mine)
        out.append((d, len(lines), len(mine), sum(mine.values()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_line_runs(run, documents, folder):
    wanted = window_lines([(d, t) for d, t, _ in documents(folder)], 8)
    found = run("op6_line_dedup", folder, ["doc_id", "n_lines", "n_removed", "words_removed", "kept_sha256"])
    assert found == sorted(wanted, key=repr)


@pytest.mark.parametrize("min_words", [1, 8, 30])
def test_line_runs_of_every_length(spark, min_words):
    from shelfcast.llm.line_runs import without_repeated_runs
    rng = np.random.default_rng(4)
    rows = []
    for d in range(40):
        rows.append((d, "\n".join("line " + " ".join("xyz"[:rng.integers(1, 4)]) + str(rng.integers(0, 4))
                                  for _ in range(rng.integers(0, 30)))))
    found = without_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_words).select(
        "doc_id", "deduped.n_lines", "deduped.n_removed", "deduped.words_removed", "deduped.text").collect()
    assert sorted(map(tuple, found)) == longest_lines(rows, min_words)
    hashed = sorted((*r[:4], hashlib.sha256(r[4].encode()).hexdigest()) for r in map(tuple, found))
    assert hashed == sorted(window_lines(rows, min_words))


def test_ranks_are_the_suffix_array(spark):
    """At every depth the ranks order the repeated windows as their sequences of line ids stand sorted."""
    from shelfcast.llm.line_runs import _lines, suffix_ranks
    rng = np.random.default_rng(6)
    rows = [(d, "\n".join(f"l{rng.integers(0, 3)}" for _ in range(rng.integers(0, 25)))) for d in range(25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    lines = frame.select("doc_id", F.xxhash64("text").alias("th"), F.explode(_lines(F.col("text"))).alias("x")).select(
        "doc_id", "th", "x.*")
    ids = {(r.doc_id, r.line): (r.h1, r.h2) for r in lines.collect()}
    for k, level in enumerate(suffix_ranks(lines, 8)):
        n, windows = 2 ** k, {}
        for d, at in ids:
            window = tuple(ids.get((d, at + i)) for i in range(n))
            if None not in window:
                windows.setdefault(window, []).append((d, at))
        repeated = sorted(w for w, at in windows.items() if len(at) > 1)
        assert {(r.doc_id, r.line): r["rank"] for r in level.collect()} == {
            at: i for i, w in enumerate(repeated) for at in windows[w]}


def test_line_runs_carry_any_column(spark):
    from shelfcast.llm.line_runs import without_repeated_runs
    names = ["_id", "_th", "_runs", "_key", "th", "key", "row", "runs", "line", "rank", "words", "deduped"]
    text = "one line of eight words that stands here twice"
    frame = spark.createDataFrame([(1, text, *["x"] * 12), (2, text, *["y"] * 12), (2, text, *["y"] * 12), (3, None, *["z"] * 12)],
                                  "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    found = without_repeated_runs(frame)
    assert found.columns == ["doc_id", "text", *names]
    assert sorted((r["doc_id"], r["_id"], r["deduped"]["n_removed"]) for r in found.collect()) == [
        (1, "x", 0), (2, "y", 1), (2, "y", 1), (3, "z", 0)]


def longest_lines(rows, min_words):
    """(n_lines, n_removed, words_removed, text) by id: each position is compared with all earlier ones."""
    lines = []
    for d, t in sorted(rows):
        lines += [(d, at, x.strip(), len(WORD.findall(x))) for at, x in enumerate(t.split("\n")) if WORD.search(x)]
        lines.append((d, None, None, 0))                    # between documents
    gone = {}
    for p in range(len(lines)):
        most = 0
        for q in range(p):
            n = 0
            while lines[p + n][2] is not None and lines[p + n][2] == lines[q + n][2]:
                n += 1
            most = max(most, n)
        if sum(x[3] for x in lines[p:p + most]) >= min_words:
            for d, at, _, n in lines[p:p + most]:
                gone.setdefault(d, {})[at] = n
    return sorted((d, sum(1 for x in t.split("\n") if WORD.search(x)), len(gone.get(d, ())),
                   sum(gone.get(d, {}).values()),
                   "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone.get(d, ()))) for d, t in rows)


def test_line_runs_whose_parts_occur_first_elsewhere(spark):
    from shelfcast.llm.line_runs import without_repeated_runs
    a, b, c, x, y = ("one two three", "four five six", "seven eight nine", "other words here", "yet more words")
    rows = [(1, [a, b, x]), (2, [y, b, c]), (3, [a, b, c]), (4, [a, b, c]), (5, ["so so so"] * 4),
            (6, [a, b, "", c, y]), (7, ["a line of eight words that stands alone", x]),
            (8, [y, "a line of eight words that stands alone", x]), (9, [c, a])]
    rng = np.random.default_rng(9)
    rows += [(10 + d, [f"l{rng.integers(0, 4)}" + " w" * int(rng.integers(0, 3)) for _ in range(rng.integers(0, 25))])
             for d in range(40)]
    rows = [(d, "\n".join(lines)) for d, lines in rows]
    found = without_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).select(
        "doc_id", "deduped.n_lines", "deduped.n_removed", "deduped.words_removed", "deduped.text").collect()
    found = sorted(map(tuple, found))
    assert found[3] == (4, 3, 3, 9, "") and found[4][2] == 3
    assert found == longest_lines(rows, 8)


@pytest.mark.parametrize("pairwise", [24, 2])
def test_pairs_across_components(pairwise, monkeypatch):
    """Both ways of intersecting find exactly the pairs across components that reach the threshold."""
    from shelfcast.llm import near_dup
    monkeypatch.setattr(near_dup, "PAIRWISE_ROWS", pairwise)
    rng = np.random.default_rng(8)
    for n in (2, 9, 24):
        pool = np.unique(rng.integers(0, 2 ** 32, 80, dtype=np.uint32))
        sets = [np.unique(rng.choice(pool, rng.integers(40, 70))) for _ in range(n)]
        comps = rng.integers(0, 3, n).tolist()
        left, right = list(range(0, n, 2)), list(range(n))
        wanted = {(i, j) for i in left for j in right if comps[i] != comps[j]
                  and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
        found = set(near_dup._across(comps, sets, left, right, 60))
        assert wanted <= found                             # 32-bit sets allow for two hashes that meet
        assert all(100 * (len(np.intersect1d(sets[i], sets[j])) + 4) >= 60 * (len(np.union1d(sets[i], sets[j])) - 4)
                   for i, j in found)


@pytest.mark.parametrize("pairwise", [24, 1])
def test_pairs_below_the_threshold_hide_no_link(spark, pairwise, monkeypatch):
    """Pairs just below the threshold stand before the only link of two components, also by a third one."""
    from shelfcast.llm import near_dup
    monkeypatch.setattr(near_dup, "PAIRWISE_ROWS", pairwise)
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    base, other, third = words("s", 100), words("t", 100), words("u", 100)
    texts = {                                              # (1, 3), (5, 6) and (6, 7) share 86 of 114 words
        1: base, 3: base[:86] + words("x", 14),
        2: other, 4: other[:95] + words("y", 5),
        6: third, 5: third[:86] + words("z", 14), 7: third[14:] + words("v", 14),
        8: other[5:] + words("w", 5)}
    component = {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 7}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string").coalesce(1)
    sets = docs.select("id", near_dup.sketch(docs.text, 1, with_set=True).alias("s")).select("id", "s.*")
    sets = materialize(sets, "test-sets")
    label = spark.createDataFrame([(9, i, c) for i, c in component.items()], "bucket long, id long, component long")
    found = near_dup.confirm(near_dup.links_across(label, sets, 80), sets, 80).collect()
    groups = {frozenset((component[r.a], component[r.b])) for r in found}
    # Two links at least, so that all three are one; a third may come from another block.
    assert len(groups) >= 2 and groups <= {frozenset((1, 3)), frozenset((1, 7)), frozenset((3, 7))}


def test_chains_are_contracted_in_few_rounds(spark, monkeypatch):
    """A chain of 2,000 in the order of its ids, a star whose hub is largest, and a random graph."""
    from shelfcast.llm import near_dup
    rounds = []
    write = near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(2000)]
    found = near_dup.components(spark.createDataFrame(chain, "a long, b long")).agg(F.max("component"), F.count("id")).first()
    assert tuple(found) == (0, 2001) and sum(r == "near-map" for r in rounds) <= 15
    loose = [tuple(sorted(map(int, e))) for e in rng.integers(20_000, 20_400, (300, 2)) if e[0] != e[1]]
    edges = [*chain, *[(i, 9000) for i in range(5000, 5100)], *loose]
    found = {r["id"]: r["component"] for r in near_dup.components(
        spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert sum(r == "near-links" for r in rounds) <= 10
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    assert found == {x: root(x) for e in edges for x in e}


def test_blocks_of_long_sets_hold_fewer_members(spark, monkeypatch):
    """The hashes of a block are bounded, whatever the members' sizes, and no link is lost by it."""
    from shelfcast.llm import near_dup
    rng = np.random.default_rng(12)
    rows, sets = [], []
    for i in range(60):                                              # families of three, half of them long
        if i % 3 == 0:
            pool = rng.integers(-2 ** 62, 2 ** 62, 40 if i % 2 else 400)
        own = np.unique(pool[rng.random(len(pool)) < 0.97])
        rows.append((1, i, i))
        sets.append((i, len(own), own.tolist()))
    label = spark.createDataFrame(rows, "bucket long, id long, component long")
    frame = spark.createDataFrame(sets, "id long, n long, hashes array<long>")
    held = spark.sparkContext.accumulator(0)
    across = near_dup._across

    def counted(comps, halves, left, right, pct):
        held.add(len(left) < 60)
        return across(comps, halves, left, right, pct)
    monkeypatch.setattr(near_dup, "_across", counted)
    full = {i: set(h) for i, _, h in sets}
    wanted = {frozenset(f) for f in ((a, b) for a in full for b in full if a < b)
              if 100 * len(full[f[0]] & full[f[1]]) >= 80 * len(full[f[0]] | full[f[1]])}

    def groups(links):
        root = {i: i for i in full}
        for a, b in links:
            old, new = root[a], root[b]
            root = {i: new if r == old else r for i, r in root.items()}
        return {frozenset(i for i in full if root[i] == r) for r in root.values()}
    found = [tuple(r) for r in near_dup.links_across(label, frame, 80, block_hashes=1000).collect()]
    assert {frozenset(x) for x in found} <= wanted and groups(found) == groups(map(tuple, wanted))
    assert held.value > 20                                           # many small blocks instead of one


def test_a_large_component_is_not_replicated(spark):
    """30 % of all members in one bucket and one component: each is sent once to meet the few others."""
    from shelfcast.llm import near_dup
    rng = np.random.default_rng(3)
    pool = rng.integers(-2 ** 62, 2 ** 62, 5000)
    rows, sets = [], []
    for i in range(3000):
        rows.append((1, i, 0 if i < 2990 else i))
        own = np.unique(pool[:50] if i == 2995 else rng.choice(pool, 50))
        sets.append((i, len(own), own.tolist()))
    sets[7] = (7, *sets[2995][1:])                                   # the only link
    label = spark.createDataFrame(rows, "bucket long, id long, component long")
    frame = spark.createDataFrame(sets, "id long, n long, hashes array<long>")
    sent = []
    compare = near_dup._compare

    def counted(pct):
        def run(batches):
            inner, n = compare(pct), 0

            def passing():
                nonlocal n
                for b in batches:
                    n += len(b)
                    yield b
            for out in inner(passing()):
                yield out.assign(a=out["a"], b=out["b"])
            import pandas as pd
            yield pd.DataFrame({"a": [-1 - n], "b": [-1]})
        return run
    near_dup._compare = counted
    try:
        found = [tuple(r) for r in near_dup.links_across(label, frame, 80).collect()]
    finally:
        near_dup._compare = compare
    sent = sum(-1 - a for a, b in found if b == -1)
    assert {(a, b) for a, b in found if b != -1} == {(7, 2995)}
    assert 3000 <= sent <= 3000 + 10 * 7


def test_byte_dedup_carries_any_column(spark):
    from shelfcast.llm.suffix_dedup import without_repeats
    names = ["doc", "th", "id", "key", "row", "spans", "_doc", "_th", "_h", "_spans", "body", "deduped"]
    text = "".join(f"piece {i} of a text; " for i in range(12))
    frame = spark.createDataFrame([(1, text, *["x"] * 12), (2, text, *["y"] * 12), (3, None, *["z"] * 12)],
                                  "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    found = without_repeats(frame)
    assert found.columns == ["doc_id", "text", *names]
    assert sorted((r["doc_id"], r["_doc"], r["deduped"]["n_removed"]) for r in found.collect()) == [
        (1, "x", 0), (2, "y", len(text)), (3, "z", 0)]


def test_blocks_do_not_change_anchors(monkeypatch):
    from shelfcast.llm import suffix_dedup as sd
    rng = np.random.default_rng(6)
    data = np.frombuffer("".join(rng.choice(list("abc "), 5000)).encode() + b"xy" * 300, np.uint8)

    def by_window():
        at, h, first, last = sd.anchors(data)
        return [(int(a), int(k)) for a, k, s, e in zip(at, h, first, last) for _ in range(s, e + 1)]
    whole = by_window()
    assert len(whole) == len(data) - sd.LENGTH + 1
    assert all(i <= a <= i + sd.SPAN - 1 for i, (a, _) in enumerate(whole))
    monkeypatch.setattr(sd, "BLOCK", 700)
    assert by_window() == whole
