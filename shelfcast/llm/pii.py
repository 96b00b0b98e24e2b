"""Operator 10 — personal data by weak-supervision aggregation.

Labelers vote on every candidate span: strict patterns and checksums, gazetteers
(calling codes, domains, given names) and words of the context, each for,
against or abstaining where it has nothing to say.  How often each pattern of votes occurs is counted
over the whole corpus (at most 3^labelers rows); expectation maximisation on
that table estimates every labeler's reliability and the posterior of each
pattern.  The posteriors train a final span classifier (logistic regression
on shape, context and vote features), which judges every candidate.  Base
findings always stay; others are added when the classifier is sure
(``MIN_PROBABILITY``).

The pattern table covers every candidate; the classifier is fitted on at most
``SAMPLE`` distinct feature rows, taken by hash and weighted by how often
they occur.  A few invented sentences with known spans (``SEEDS``) are always
among both, so a small table has a model as a large one has.  Texts are read once.

Cases: null text counts as empty (no span, digest of the empty string); a table
without candidates is judged by what the invented sentences teach; equal rows get
equal spans; key columns are carried through.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from shelfcast.llm.common import sample_by_hash, text_or_empty
from shelfcast.session import materialize

# Contract patterns and limits (fixed values).
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts where a run of digits starts: later starts of a run fail alike.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Candidates beyond the base kinds.
OTHER = (
    ("phone_local", re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])")),
    ("name", re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]+(?: [A-Z][a-z]+)?")),
)
ALL_KINDS = (*KINDS, *(k for k, _ in OTHER))

# Gazetteers (fixed values).
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name pro app dev io ai co me tv cloud online site store "
                        "shop blog tech news".split())
# Calling codes of one and two digits; every other pair of first digits begins a code of three, but for the unassigned.
ONE_DIGIT_CODES = frozenset("17")
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
                            "81 82 84 86 90 91 92 93 94 95 98".split())
NO_CODES = frozenset("210 214 215 217 219 259 292 293 294 295 296 384 388 422 424 425 426 427 428 429 671 693 694 695 696 697 698 "
                     "699 801 802 803 804 805 806 807 809 851 854 857 858 859 871 872 873 874 875 876 877 884 885 887 889 969 "
                     "978 990 997 999".split())
GIVEN_NAMES = frozenset(
    "adam ahmed alan albert alex alexander alice ali amanda amy ana andrea andrew angela anna anne anthony antonio ashley "
    "barbara benjamin bernard betty brian carl carla carlos carmen carol caroline catherine charles charlotte chen "
    "chiara chloe christian christine christopher claire clara claudia cynthia daniel david deborah dennis diana diego "
    "dmitri donald donna dorothy edward elena elisabeth elizabeth emily emma eric erik eva fatima felix fernando "
    "francesca francis francisco frank frederic gabriel george giovanni giulia gloria grace greta hannah hans harald "
    "heather helen helena henri henry hiroshi hugo ibrahim igor ines ingrid isabel ivan jack jacob jacques james jane "
    "janet jason javier jean jeffrey jennifer jessica joan johann john jonathan jorge jose joseph joshua juan judith "
    "julia julian julie karen karl katherine kathleen keith kenji kevin klaus kumar larry laura leila leo leon liam "
    "linda lisa louis louise luca lucas lucia lucy luis luke madeleine manuel marc marco margaret maria marie marina "
    "mario mark marta martin mary matthew maximilian mei melissa michael michelle miguel mohammed monica nancy natalie "
    "natasha nicholas nicolas nicole nina noah olga oliver olivia omar oscar pablo pamela patricia patrick paul paula "
    "pedro peter philip philippe pierre rachel raj ralph raymond rebecca ricardo richard robert roberto roger ronald "
    "rosa ruth ryan samuel sandra sara sarah scott sebastian sharon simon sofia sophia sophie stefan stephanie stephen "
    "steven susan tanya teresa theresa thomas timothy tobias ursula valentina vera victor victoria viktor vincent "
    "virginia walter wei werner william wolfgang xavier yuki yusuf zoe".split())
CUES = re.compile(r"(?i)\b(call|phone|tel|mobile|fax|e-?mail|mail|contact|write|reach|address|card|visa|account|ip|"
                  r"host|ssn|social|iban|bank|mr|mrs|dr|name)\b")
AGAINST = re.compile(r"(?i)\b(version|page|isbn|order|figure|table|chapter|section|doi|id|no|nr|price|total|sum)\b")
NEAR = 32
LABELERS = ("pattern", "checksum", "gazetteer", "cue", "against", "border", "shape")

SAMPLE = 20_000
# Invented sentences: what stands in them between ⟨ and ⟩ is personal data, any other candidate is none.
SEEDS = (
    "Please call ⟨212 555 0143⟩ or write to ⟨mary.jones@example.org⟩ today.", "Her phone is ⟨(415) 555-2671⟩, ask for ⟨Dr. Anna Keller⟩.",
    "Reach me at ⟨+44 20 7946 0958⟩ or ⟨+1 (212) 555-0187⟩.", "My card is ⟨4111 1111 1111 1111⟩, please charge it.",
    "The social security number ⟨123-45-6789⟩ belongs to ⟨Mr. John Smith⟩.", "Pay to the account ⟨DE89 3704 0044 0532 0130 00⟩ by bank transfer.",
    "The host ⟨192.168.10.24⟩ answered the mail of ⟨peter@mail.example.com⟩.", "⟨Mrs. Laura Martin⟩ and ⟨Prof. Michael Weber⟩ came by.",
    "Contact: ⟨555-867-5309⟩ or ⟨hans.gruber@firma.de⟩, mobile ⟨+49 151 23456789⟩.", "Tel. ⟨646-555-0199⟩, name ⟨Ms. Sofia Garcia⟩.",
    "Order no. 555-222-1111x of version 100-200-3000 on page 12.", "The part id 999-88-7777 and the doi 666-11-2222 are listed.",
    "Table 000-000-0000 shows the total 111-111-1111 of the price.", "See chapter 123.456.7890 and figure 987 654 3210 in version 2.",
    "ISBN 900-12-3456 is out of print, order 000-12-3456 instead.", "The code XX00 0000 0000 0000 0000 stands in section 9.",
    "Model AB12 CD34 EF56 GH78 is sold under id ZZ99 9999 9999 9999 9999.")
SEED_WEIGHT = 3.0
MIN_PROBABILITY = 0.9
ROUNDS = 50


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """An address is found from its sign: the run of local characters before it, the domain after."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def numbers(text: str) -> tuple[list, list, list]:
    """Spans of ips, cards and phones; matches that fail a limit are dropped."""
    ip = [m.span() for m in IP.finditer(text) if all(map(_small, m.group().split(".")))] if "." in text else []
    card, phone = [], []
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            card.append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                phone.append(m.span())
    return ip, card, phone


def base_findings(text: str) -> list[tuple[str, int, int]]:
    ip, card, phone = numbers(text)
    return [(kind, s, e) for kind, spans in zip(KINDS, (emails(text), ip, card, phone)) for s, e in spans]


def calling_code(digits: str) -> bool:
    """Does an international number begin with an assigned calling code?"""
    return digits[:1] in ONE_DIGIT_CODES or digits[:2] in TWO_DIGIT_CODES or (
        digits[:1] in "23456789" and digits[:3] not in NO_CODES)


def votes(text: str, kind: str, start: int, end: int) -> list[int]:
    """One vote (1 for, -1 against, 0 abstaining) of each labeler."""
    value = text[start:end]
    left, right = text[max(0, start - NEAR):start], text[end:end + NEAR]
    digits = "".join(c for c in value if "0" <= c <= "9")
    gazetteer = 0
    if kind == "email":
        last = value.rsplit(".", 1)[-1].lower()
        gazetteer = 1 if last in TOP_DOMAINS or len(last) == 2 and last.isalpha() else -1
    elif kind == "phone":
        gazetteer = 1 if calling_code(digits) else -1
    elif kind == "name":
        gazetteer = 1 if any(w.lower() in GIVEN_NAMES for w in value.split()) else 0
    checksum = 0
    if kind == "card":
        checksum = 1                                       # a base finding: its Luhn sum holds
    elif kind == "iban":
        moved = value.replace(" ", "")
        moved = moved[4:] + moved[:4]
        checksum = 1 if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else -1
    elif kind == "ssn":
        checksum = -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" else 1
    shape = 0
    if len(digits) > 5 and len(set(digits)) < 3:
        shape = -1
    elif kind == "name":
        shape = 1 if value.count(" ") == 2 else 0          # title, given name and family name
    elif kind == "phone_local":                            # an area code and an exchange begin with 2 to 9
        shape = 1 if digits[0] in "23456789" and digits[3] in "23456789" else -1
    # The pattern labeler speaks only for kinds whose pattern is narrow by itself.
    return [1 if kind in ("email", "ssn", "iban", "name") else 0, checksum, gazetteer,
            1 if CUES.search(left) else 0, -1 if AGAINST.search(left) else 0,
            -1 if left[-1:].isalnum() or right[:1].isalnum() else 1, shape]


def features(kind: str, value: str, vote: Sequence[int]) -> list[float]:
    n = max(len(value), 1)
    return ([1.0, min(n, 64) / 32, sum(c.isdigit() for c in value) / n, sum(c.isalpha() for c in value) / n,
             sum(c in " .-()" for c in value) / n, value.count("@")]
            + [float(kind == k) for k in ALL_KINDS]
            + [float(v == x) for v in vote for x in (-1, 1)])


def candidates(text: str) -> list[dict]:
    base = base_findings(text)
    found = [(k, s, e, True) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)             # spans kept so far; base spans may overlap
    reach = 0
    for k, (s, e) in enumerate(taken):                     # (start, end of any span up to it)
        reach = max(reach, e)
        taken[k] = (s, reach)
    if any(c in text for c in "0123456789.") :
        for kind, pattern in OTHER:
            for m in pattern.finditer(text):
                s, e = m.span()
                k = bisect_left(taken, (e,))               # spans that start before this one ends
                if k == 0 or taken[k - 1][1] <= s:
                    found.append((kind, s, e, False))
                    insort(taken, (s, e))
    out = []
    for kind, s, e, is_base in found:
        vote = votes(text, kind, s, e)
        out.append({"kind": kind, "start": s, "end": e, "base": is_base, "votes": vote,
                    "features": features(kind, text[s:e], vote)})
    return out


def label_model(patterns: pd.DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns: reliability [labeler, class, vote] and posterior per pattern."""
    v = np.array(patterns["votes"].tolist(), dtype=int).reshape(len(patterns), len(LABELERS))
    n = patterns["n"].to_numpy(float)
    posterior = 1 / (1 + np.exp(-v.sum(axis=1)))
    table = np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        prior = (n * posterior).sum() + 1, (n * (1 - posterior)).sum() + 1
        logs = np.tile(np.log(np.array(prior[::-1]) / sum(prior)), (len(v), 1))
        for j in range(len(LABELERS)):
            for y, p in ((0, 1 - posterior), (1, posterior)):
                mass = np.array([(n * p * (v[:, j] == x)).sum() + 1 for x in (-1, 0, 1)])
                table[j, y] = mass / mass.sum()
                logs[:, y] += np.log(table[j, y])[v[:, j] + 1]
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
    return table, posterior


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Soft-label logistic regression by gradient steps with momentum; rows count by ``weight``."""
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - 0.5 * (x.T @ ((p - y) * weight) + 1e-4 * w)
        w = w + speed
    return w


CANDIDATES = ("array<struct<kind:string,start:long,end:long,base:boolean,votes:array<int>,features:array<double>>>")


def scan(text: Column) -> Column:
    @pandas_udf(CANDIDATES)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([candidates(t) for t in texts], dtype=object)
    return found(text)


def seed_rows() -> tuple[list[dict], list[float]]:
    """Candidates of the invented sentences and whether each is personal data."""
    rows, known = [], []
    for marked in SEEDS:
        text, spans = "", []
        for part in re.split("([⟨⟩])", marked):
            if part == "⟨":
                spans.append(len(text))
            elif part != "⟩":
                text += part
        for c in candidates(text):
            rows.append(c)
            known.append(float(c["start"] in spans))
    return rows, known


def fit_classifier(found: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights of the span classifier, trained on the label model's posteriors and the invented sentences."""
    spans = found.select(F.explode("found").alias("c")).select("c.*")
    patterns = spans.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").toPandas()
    seeds, known = seed_rows()
    own = pd.DataFrame({"votes": [c["votes"] for c in seeds], "n": SEED_WEIGHT})
    patterns = pd.concat([patterns, own], ignore_index=True)
    _, posterior = label_model(patterns)
    by_votes = {tuple(v): p for v, p in zip(patterns["votes"], posterior)}
    distinct = materialize(spans.groupBy("votes", "features").agg(F.count(F.lit(1)).alias("n")), "pii-features")
    rows = sample_by_hash(distinct, ["features", "votes"], sample).toPandas()
    x = np.array(rows["features"].tolist() + [c["features"] for c in seeds], dtype=float)
    y = np.array([by_votes[tuple(v)] for v in rows["votes"]] + known)
    return fit_logistic(x, y, np.concatenate([rows["n"].to_numpy(float), np.full(len(seeds), SEED_WEIGHT)]))


def find_pii(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """One row per document: ``keys`` and ``pii``, an array of (kind, start, end, base, score)."""
    found = materialize(docs.select(*keys, scan(text_or_empty(text)).alias("found")), "pii-candidates")
    weights = fit_classifier(found)

    @pandas_udf("array<struct<kind:string,start:long,end:long,base:boolean,score:double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out = []
            for row in rows:
                kept = []
                for c in row:
                    z = float(np.dot(weights, np.asarray(c["features"], float)))
                    score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    if c["base"] or score >= MIN_PROBABILITY:
                        kept.append({"kind": c["kind"], "start": c["start"], "end": c["end"],
                                     "base": bool(c["base"]), "score": float(score)})
                out.append(sorted(kept, key=lambda s: (ALL_KINDS.index(s["kind"]), s["start"])))
            yield pd.Series(out, dtype=object)

    return found.select(*keys, judge(F.col("found")).alias("pii"))
