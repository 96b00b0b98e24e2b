"""Cross-tokenizer alignment, hard negatives and the URL filter against brute-force versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


# --- alignment ---------------------------------------------------------------

def brute_alignment(rows):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer, decoders
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = {}
    for byte in range(256):
        shown = 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255
        letters[chr(byte) if shown else chr(256 + sum(n != byte for n in letters.values() if n in HIDDEN and n < byte))] = byte
    found = []
    for doc_id, text, _ in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes.fromhex(p[3:5]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append((doc_id, [], [], [], []))
            continue
        links, groups, side_a, side_b, i, j, end_a, end_b = [], [], [], [], 0, 0, 0, 0
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            next_a, next_b = end_a + len(bytes_a[i]), end_b + len(bytes_b[j])
            if next_a <= next_b:
                side_a.append(ids_a[i])
                i, end_a = i + 1, next_a
            if next_b <= next_a:
                side_b.append(ids_b[j])
                j, end_b = j + 1, next_b
            if next_a == next_b:
                groups.append(",".join(map(str, side_a)) + "|" + ",".join(map(str, side_b)))
                side_a, side_b = [], []
        found.append((doc_id, ids_a, ids_b, groups, links))
    counts = Counter(pair for *_, links in found for pair in set(links))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [(doc_id, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links),
             sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for doc_id, ids_a, ids_b, groups, links in found], counts, most


HIDDEN = {*range(33), 127, *range(128, 161), 173}


def test_alignment(run, documents, folder):
    assert run("op11_token_alignment", folder, ALIGNED) == sorted(brute_alignment(documents(folder))[0], key=repr)


def test_alignment_special_strings_and_odd_texts(spark):
    from shelfcast.llm.alignment import align
    texts = ["<|endoftext|> <s></s><unk><0x0A>", "a<0x41>\n\n b", "x▁y", "  two  blanks  ", "\t\r\n", "日本語 é ﬁ 😀", "a" * 9000,
             " " * 5000, "it's we'll I'd", "\x00\x01", "<s>", "same same", "same same"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "same", None), (3, None, None), (4, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(4)
    found = sorted(map(tuple, align(spark, frame).documents().select(ALIGNED).collect()), key=repr)
    wanted, _, _ = brute_alignment(rows)
    assert found == sorted(wanted, key=repr)
    assert [r[1:4] for r in wanted if r[0] == 2] == [(0, 0, 0)]          # U+2581 in the text


def test_alignment_spills_and_pairs(spark, documents):
    """Runs of a few records, many parts and cells: the same rows; and the table of pairs."""
    P = pytest.importorskip("public_tokenizers")
    from shelfcast.llm import alignment
    rows = documents("/root/testdata/sf0.001")
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(60)
    old, alignment.CELL_RUNS = alignment.CELL_RUNS, 2
    try:
        found = alignment.Alignment(frame, P.path(alignment.MODEL_A), P.path(alignment.MODEL_B), ["doc_id", "source"],
                                    radix=7, spill=500, with_groups=True)
        result = found.documents().collect()
        pairs = {(r["a_id"], r["b_id"]): (r["n_docs"], r["best"]) for r in found.pairs().collect()}
    finally:
        alignment.CELL_RUNS = old
    wanted, counts, most = brute_alignment(rows)
    assert found.runs.count() > 200
    assert sorted((tuple(r[c] for c in ALIGNED) for r in result), key=repr) == sorted(wanted, key=repr)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in result if r["groups"])
    assert pairs == {p: (n, n == most[p[0]]) for p, n in counts.items()}


def test_merge_counts_and_best():
    from shelfcast.llm.alignment import Spill, Aligned, _packed, merge_counts, with_best  # noqa: F401
    rng = np.random.default_rng(3)
    runs, total = [], Counter()
    for _ in range(9):
        pairs = np.unique(rng.integers(0, 300, rng.integers(1, 200)))
        n = rng.integers(1, 5, len(pairs))
        total.update(dict(zip(pairs.tolist(), n.tolist())))
        runs.append(_packed(np.diff(pairs, prepend=0), n))
    for block in (1, 7, 4096):
        merged = list(with_best(merge_counts(runs, block), 10))
        found = {int(p): (int(n), bool(b)) for part in merged for p, n, b in zip(*part)}
        assert [int(p) for part in merged for p in part[0]] == sorted(total)
        most = {a: max(n for p, n in total.items() if p // 10 == a) for a in {p // 10 for p in total}}
        assert found == {p: (n, n == most[p // 10]) for p, n in total.items()}
    assert list(merge_counts([])) == []


def test_both_libraries_split_alike():
    """The byte-level engine used here against the library of the vocabulary, over every block of code points."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    from shelfcast.llm.alignment import MODEL_A, MODEL_B, Vocabularies
    a = Tokenizer.from_file(P.path(MODEL_A))
    a.encode_special_tokens = True
    own = Vocabularies(P.path(MODEL_A), P.path(MODEL_B)).opened()[0]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0)]
    texts = [f" a{chr(c)}1{chr(c)}{chr(c)}! {chr(c)} b" for c in points]
    assert [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)] == [own.encode_ordinary(t) for t in texts]


# --- hard negatives ----------------------------------------------------------

def brute_negatives(rows):
    taking = []
    for vec_id, vec, label in rows:
        if vec_id is None or vec is None or label is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
        taking.append((vec_id, label, [math.floor(256 * float(x)) for x in vec]))
    out = []
    for i, (anchor, label, vec) in enumerate(taking):
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, v)), vec_id, lab) for j, (vec_id, lab, v) in enumerate(taking)
                        if j != i)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
            out += [(anchor, positive, k + 1, vec_id, -p, -n) for k, (n, vec_id, _) in enumerate(fits)]
    return sorted(out, key=repr)


@pytest.fixture
def vectors(spark):
    return lambda folder: [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet")
                           .select("vec_id", "embedding", "label").collect()]


def test_hard_negatives(run, vectors, folder):
    assert run("op12_hard_negatives", folder, MINED) == brute_negatives(vectors(folder))


def test_hard_negatives_small_chunks_and_clusters(spark):
    """Clusters that the tree can tell apart, tiny chunks and blocks, one vector with a third of the rows."""
    from shelfcast.llm import negatives
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, [float(x) for x in (centres[i % 12] + rng.normal(size=8) * 0.05)], int(i % 12 // 4)) for i in range(1200)]
    rows += [(i, [float(x) for x in centres[3]], int(i % 3)) for i in range(1200, 1800)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(6)
    found = negatives.mine(frame, label=negatives.op12_label(), sample=900, chunk=40, block=3)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_negatives(rows)


def test_tree_eliminates_and_loses_nothing():
    from shelfcast.llm.negatives import Tree
    rng = np.random.default_rng(1)
    rows = ((rng.normal(size=(40, 16)) * 200)[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 5).astype(np.int64)
    tree = Tree(rows[:1000], float(np.sqrt((rows ** 2).sum(1).max())))

    def seen(node, cells, angles):
        np.minimum.at(tree.least[node].T, cells, angles)
        np.maximum.at(tree.most[node].T, cells, angles)
    leaf = tree.route(rows, seen)
    anchors = rows[::100]
    scores = anchors @ rows.T
    low, high = np.quantile(scores, 0.97, axis=1), np.quantile(scores, 0.99, axis=1)
    stay = tree.survivors(anchors, *tree.annulus(anchors, low, high))
    inside = (scores >= low[:, None]) & (scores <= high[:, None])
    for i in range(len(anchors)):
        assert stay[i, leaf[inside[i]]].all()
    assert stay.mean() < 0.5


def test_products_stay_exact_beyond_doubles():
    from shelfcast.llm.negatives import products
    a = np.array([[2 ** 30, 1]], np.int64)
    assert products(a, a)[0, 0] == 2 ** 60 + 1


# --- urls --------------------------------------------------------------------

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%"


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES
            if path.startswith(p) and (host == h or host.endswith("." + h))]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def symbols(url):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in url.encode())
    return [*"^^^", *[chr(b) if chr(b) in LETTERS else "*" for b in lower], "$"]


class BruteModel:
    """Witten-Bell over contexts of up to three symbols, with dictionaries."""

    def __init__(self, urls):
        self.n = Counter()
        self.after = {}
        for s in map(symbols, urls):
            for i in range(3, len(s)):
                for k in range(4):
                    self.n[tuple(s[i - k:i]), s[i]] += 1
                    self.after.setdefault(tuple(s[i - k:i]), Counter())[s[i]] += 1

    def p(self, context, symbol):
        lower = 1 / (len(LETTERS) + 3) if not context else self.p(context[1:], symbol)
        seen = self.after.get(context)
        return lower if not seen else (seen[symbol] + len(seen) * lower) / (sum(seen.values()) + len(seen))

    def log(self, url):
        s = symbols(url)
        return [math.log(self.p(tuple(s[i - 3:i]), s[i])) for i in range(3, len(s))]


def test_url_rules(run, spark, folder):
    rows = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url").collect()
    wanted = [(r["page_id"], *brute_rule(r["url"])) for r in rows]
    found = run("op13_url_filter", folder, ["page_id", "host", "path", "rule", "verdict"])
    assert sorted((r[:4] for r in found), key=repr) == sorted((w[:4] for w in wanted), key=repr)
    assert all(v in ("allow", "block") for *_, v in found)
    decided = Counter((r[0], r[1], r[2], r[4]) for r in found if r[3])
    assert decided == Counter((w[0], w[1], w[2], w[4]) for w in wanted if w[3])


def test_url_model_against_brute_force(spark, edge_dir):
    from shelfcast.llm import url_filter
    pages = spark.read.parquet(f"{edge_dir}/pages.parquet").select("page_id", "url")
    labelled = url_filter.with_rule(pages).where("verdict is not null")
    _, threshold, error = url_filter.fit(labelled)
    rows = [r["url"] for r in pages.collect()]
    models = [BruteModel([u for u in rows if brute_rule(u)[3] == v]) for v in ("allow", "block")]
    found = {r["url"]: r for r in url_filter.filter_urls(pages).collect()}
    assert 0 <= error <= 0.5
    for url in set(rows):
        wanted = np.mean(np.subtract(models[0].log(url), models[1].log(url))) if url else 0.0
        assert found[url]["score"] == pytest.approx(wanted, abs=1e-5)
        rule = brute_rule(url)[3]
        assert found[url]["verdict"] == (rule or ("allow" if found[url]["score"] >= threshold else "block"))
    assert all(found[f"http://site{i}.org/story/{i}.html"]["verdict"] == "allow" for i in range(5))
    assert all(found[f"http://b{i}.org/casino?id={i}"]["verdict"] == "block" for i in range(5))


def test_url_model_errs_little_on_unseen_hosts(spark):
    from shelfcast.llm import url_filter
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    _, _, error = url_filter.fit(url_filter.with_rule(pages).where("verdict is not null"))
    assert error < 0.1


def test_url_threshold():
    from shelfcast.llm.url_filter import STEPS, best_threshold
    assert best_threshold([]) == 0.0
    assert best_threshold([(True, 3 * STEPS, 50), (False, -3 * STEPS, 50)]) == 0.0
    assert 1.0 < best_threshold([(True, 3 * STEPS, 50), (False, STEPS, 50)]) <= 3.0
    assert -3.0 < best_threshold([(True, -STEPS, 50), (False, -3 * STEPS, 50)]) <= -1.0
