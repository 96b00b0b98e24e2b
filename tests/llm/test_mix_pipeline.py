"""Source mixing and the corpus pipeline against brute-force versions; the DuckDB twins on small data."""

import itertools
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import SMALL
from tests.llm.test_dedup import LOWER, alnum, brute_components, window_lines
from tests.llm.test_scans import brute_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Share by weight; sources above their cap get the cap, and the excess is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest, open_ = total - sum(fixed.values()), [s for s in order if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: cap * sizes[s] for s in over})


def test_mix_meets_targets(run, documents, folder):
    rows = [(d, len(WORD.findall(t or "")), s) for d, t, s in documents(folder)]
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    target = brute_targets(sizes) if rows else {}
    found = run("op1_mix_sources", folder, ["doc_id", "source", "size", "source_size", "target", "taken"])
    assert Counter((r[0], r[2], r[1]) for r in found) == Counter(rows)
    taken = Counter()
    for doc_id, source, size, source_size, t, k in found:
        assert source_size == sizes[source] and math.isclose(t, target[source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= k <= 3 * size and (size == 0 or k % size == 0)
        taken[source] += k
    longest = defaultdict(int)
    for _, n, s in rows:
        longest[s] = max(longest[s], n)
    for s in sizes:                                        # below the target by less than the longest document
        assert target[s] - longest[s] - 1 <= taken[s] <= target[s] + 1e-6


def test_capped_sources_share_their_excess(spark):
    from shelfcast.llm.mixing import mix, with_size
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate(
        [(10, "a")] + [(50, "b")] * 40 + [(7, "c")] * 3 + [(30, "d")] * 20 + [(0, "e")] + [(11, None)] * 9)]
    docs = with_size(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = mix(docs, ["doc_id"]).collect()
    sizes, target, taken = Counter(), {}, Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(math.isclose(target[s], t) for s, t in brute_targets(sizes).items())
    assert taken["a"] == 30 and taken["e"] == 0
    again = mix(docs.repartition(7, "doc_id"), ["doc_id"]).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in found)


@pytest.mark.parametrize("span", [1 << 16, 5])
def test_fit_lengths_is_best_possible(span):
    from shelfcast.llm.mixing import fit_lengths
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = np.unique(rng.integers(0, 14, 4))
        counts = rng.integers(0, 4, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 3))
        take = fit_lengths(lengths, counts, budget, span)
        got = int((take * lengths).sum())
        best = max(s for s in (sum(a * b for a, b in zip(lengths, pick)) for pick in itertools.product(
            *[range(c + 1) for c in counts])) if s <= budget)
        assert (take <= counts).all() and (take >= 0).all() and got <= budget
        assert got == best if span > 100 else got <= best


# ---------------------------------------------------------------- pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory, edge_dir):
    """Every stage's input and output on the small and the edge folder."""
    import corpus_pipeline
    out = {}
    for name, folder in (("small", SMALL), ("edge", edge_dir)):
        docs, root = spark.read.parquet(f"{folder}/documents.parquet"), str(tmp_path_factory.mktemp(f"pipe-{name}"))
        for k, (stage, function) in enumerate(corpus_pipeline.STAGES):
            result = function(spark, docs, folder)
            result.write.parquet(f"{root}/{k}")
            after = spark.read.parquet(f"{root}/{k}")
            out[name, stage] = (docs.select("doc_id", "text").collect(), after.collect(), after.columns)
            docs = after
    return out


FOLDERS = ["small", "edge"]


@pytest.mark.parametrize("name", FOLDERS)
def test_stages_return_the_columns_of_documents(stages, name):
    for (folder, stage), (_, after, columns) in stages.items():
        if folder == name:
            assert columns[:5] == COLUMNS and (columns == COLUMNS) == (stage != "source_mix")
            assert all(r["n_chars"] == len(r["text"]) for r in after)


@pytest.mark.parametrize("name", FOLDERS)
def test_quality_stage_rejects_what_the_rules_reject(stages, name):
    before, after, _ = stages[name, "quality_rules"]
    rejected = {r["doc_id"] for r in before if brute_quality(r["text"] or "")[-1]}
    kept = {r["doc_id"] for r in after}
    assert not rejected & kept
    texts = {r["doc_id"]: r["text"] for r in before}
    for r in after:                                         # lines go, none is changed
        assert not Counter(r["text"].split("\n")) - Counter(texts[r["doc_id"]].split("\n"))


@pytest.mark.parametrize("name", FOLDERS)
def test_line_stage_deletes_later_copies(stages, name):
    before, after, _ = stages[name, "line_dedup"]
    wanted = window_lines([(r["doc_id"], r["text"]) for r in before], 8)
    emptied = sum(1 for _, n, gone, _, _ in wanted if gone and gone == n)
    assert len(after) == len(before) - emptied
    import hashlib
    kept = Counter(w[4] for w in wanted if not (w[2] and w[2] == w[1]))
    assert Counter(hashlib.sha256(r["text"].encode()).hexdigest() for r in after) == kept


@pytest.mark.parametrize("name", FOLDERS)
def test_near_stage_keeps_one_of_each_group(stages, name):
    before, after, _ = stages[name, "near_dedup"]
    # An id with several texts stands for several documents, behind all others.
    ids = Counter(d for d, _ in {(r["doc_id"], r["text"]) for r in before} if d is not None)
    last = max(ids, default=0)
    twice = sorted((r for r in {(r["doc_id"], r["text"]) for r in before if ids[r["doc_id"]] > 1}))
    node = {key: last + 1 + k for k, key in enumerate(twice)}
    keys = [(r["doc_id"], r["text"]) for r in before if r["doc_id"] is None]
    keys += sorted({(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None})
    found = brute_components([(node.get(k, k[0]), k[1]) for k in keys], 2)
    assert Counter((r["doc_id"], r["text"]) for r in after) == Counter(k for k, f in zip(keys, found) if f[-1])


def test_near_stage_keeps_other_texts_of_an_id(spark):
    import corpus_pipeline
    words = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    rows = [(1, words("a"), "en", "s", 1), (1, words("b"), "en", "s", 1), (2, words("a") + " end", "en", "s", 1),
            (3, words("b") + " end", "en", "s", 1), (4, words("c"), None, "t", 2), (4, words("c"), "de", "s", 1),
            (None, words("c"), "en", "s", 1), (5, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 3):
        found = corpus_pipeline.near_dedup(spark, docs.repartition(parts), "").collect()
        assert sorted((r["doc_id"] or 0, (r["text"] or "")[:2], r["lang"] or "") for r in found) == [
            (0, "c0", "en"), (2, "a0", "en"), (3, "b0", "en"), (4, "c0", ""), (5, "", "en")]


@pytest.mark.parametrize("name", FOLDERS)
def test_decontamination_stage_drops_hits_only(spark, stages, name, edge_dir):
    before, after, _ = stages[name, "decontamination"]
    folder = SMALL if name == "small" else edge_dir
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        words = alnum(r["text"])
        n = min(10, len(words))
        windows |= {tuple(words[i:i + n]) for i in range(len(words) - n + 1 if n else 0)}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = alnum(text)
        return not any(tuple(words[i:i + n]) in windows for n in sizes for i in range(len(words) - n + 1))
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before if clean(r["text"]))


@pytest.mark.parametrize("name", FOLDERS)
def test_mix_stage_takes_documents_near_the_targets(stages, name):
    before, after, _ = stages[name, "source_mix"]
    assert not Counter(r["doc_id"] for r in after) - Counter(r["doc_id"] for r in before)
    taken, target = Counter(), {}
    for r in after:
        assert r["copies"] >= 1 and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    longest = max((len(WORD.findall((r["text"] or "").translate(LOWER))) for r in before), default=0)
    assert all(t - longest - 1 <= taken[s] <= t + 1e-6 for s, t in target.items())


def test_pipeline_runs_on_empty_tables(spark, empty_dir):
    import __spark_entry__
    assert __spark_entry__.queries()["pipeline"](spark, empty_dir).count() == 0


# ---------------------------------------------------------------- DuckDB twins

@pytest.mark.parametrize("name", ["op4_benchmark_hits", "op5_quality_rules", "op7_license_scan", "op8_near_duplicates"])
def test_query_matches_its_sql(run, name):
    from shelfcast.llm.oracles import ORACLES
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SMALL, t)}.parquet')")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert run(name, SMALL, columns) == sorted(map(tuple, result.fetchall()), key=repr)


def test_quality_and_licenses_match_their_sql_on_edge_texts(spark, run, tmp_path):
    """Every kind of line and notice, each alone, in pairs and behind clean prose."""
    from shelfcast.llm.licenses import TEMPLATES
    from shelfcast.llm.oracles import ORACLES
    prose = " ".join([f"Word{i} follows other{i} then comes thing{i} and last{i}." for i in range(120)])
    lines = ["Next came the rain.", "Home", "Next page", "Sign in now", "a | b | c | d", "x | y | z is a long line of words, "
             "and so on and on, until it has far more words than bars, which is why it stays | as it is.", "We use cookies here.",
             "All rights reserved", "no end at all", "but this goes on", "a comma at the end,", "Yes,", "code();", "}", "",
             "   ", "\t", "# $ % & * |", "wow!! wow!! wow!!", "ends with a quote.\u201d", "ends with blanks.  \t", "carriage return.\r",
             "carriage return\r", "Zurück zu den Seiten", "zurück zu", "été sans fin", "3 < 4", "Tous droits réservés.", "。", "日本語。",
             prose, prose + " She baked a cookie and wrote a newsletter. " + prose]
    texts = [None, "", *lines, *[f"{a}\n{b}" for a in lines for b in lines[::3]], *[f"{prose}\n{a}\n{a}" for a in lines],
             *["\n".join(x.wording.split()) for x in TEMPLATES], *[f"{prose} {x.wording} {prose}" for x in TEMPLATES]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("op5_quality_rules", "op7_license_scan"):
        result = con.execute(ORACLES[name])
        columns = [c[0] for c in result.description]
        wanted = sorted(map(tuple, result.fetchall()), key=repr)
        assert run(name, str(tmp_path), columns) == wanted


def test_every_query_is_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
