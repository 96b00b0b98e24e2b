"""DuckDB twins of the training-data queries that SQL can express.

Not here, tested against brute force instead: op1 (knapsack), op2 (merging),
op3, op10 and op13 (trained models), op6 (maximal line runs), op9 (bytes), op11
(tokenizers), op12 (all pairs are too slow on whole tables), pipeline.
"""

from __future__ import annotations

import re

from shelfcast.llm import licenses, quality

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS words
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
spot AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, i, n, item_id FROM spot JOIN p USING (n, words)),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hit) GROUP BY ALL),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY ALL)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_WORD = r"[^\x20\x09-\x0D]+"
_COUNT = lambda pattern: f"len(regexp_extract_all(x, {_text(pattern)}))"
_MATCH = lambda pattern, x="x": f"regexp_matches({x}, {_text(pattern)})"
_ENDS = lambda x: f"({_MATCH(quality.ENDINGS, x)} OR {_MATCH(quality.SENTENCE_INSIDE, x)})"
_GOES_ON = lambda x: f"coalesce({_MATCH(quality.GOES_ON, x)}, false)"
_WRAPPED = (f"({_GOES_ON('next1')} AND ({_ENDS('next1')} OR {_GOES_ON('next2')} AND ({_ENDS('next2')} OR "
            f"{_GOES_ON('next3')} AND {_ENDS('next3')})))")
_LINE_FAILS = f"""(
  NOT {_MATCH(quality.ENDINGS)} AND NOT {_MATCH(quality.SENTENCE_INSIDE)} AND NOT {_MATCH(quality.CODE_END)}
    AND NOT ({_MATCH(quality.RUN_ON)} AND {_COUNT(_WORD)} >= {quality.RUN_ON_WORDS})
    AND NOT {_WRAPPED}
  OR {_COUNT('[|»›•]')} > {quality.MAX_SEPARATORS} AND {_COUNT('[|»›•]')} > {quality.MAX_SEPARATOR_SHARE} * {_COUNT(_WORD)}
  OR NOT {_MATCH(quality.ENDINGS)} AND {_MATCH(quality.NAVIGATION)}
  OR {_MATCH(quality.BOILERPLATE)} AND {_COUNT(quality.BOILERPLATE)} * {quality.PHRASE_WORDS} >= {_COUNT(_WORD)}
  OR {_COUNT(quality.SYMBOLS)} > {quality.MAX_SYMBOL_SHARE} * {_COUNT(_WORD)}
  OR {_COUNT('!!+')} > {quality.MAX_SYMBOL_SHARE} * {_COUNT(_WORD)})"""

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
           FROM documents),
win AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT x) AS n FROM (
          SELECT doc_id, unnest(range(i, i + 3)) AS x FROM win JOIN twice USING (doc_id, g)) GROUP BY ALL),
line AS (SELECT doc_id, sum(length(x)) AS size, sum(CASE WHEN {_LINE_FAILS} THEN length(x) ELSE 0 END) AS lost
         FROM (SELECT doc_id, l[i] AS x, l[i + 1] AS next1, l[i + 2] AS next2, l[i + 3] AS next3 FROM (
                 SELECT doc_id, string_split(t, chr(10)) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d))
         WHERE regexp_matches(x, '{_WORD}') GROUP BY ALL),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, {_text(quality.SYMBOLS)})) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(size, 0) AS size
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN line USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words) AS base_failed,
       NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words)
           AND lost <= {quality.MAX_LOST} * size AS kept
FROM f
"""

def _list(text: str) -> str:
    """Distinct words as an SQL list."""
    return "[" + ", ".join(_text(w) for w in dict.fromkeys(re.findall("[a-z0-9]+", text.lower()))) + "]::VARCHAR[]"


_TEMPLATES = ", ".join(
    f"({k}, {_text(t.label)}, {_list(t.wording)}, {_list(t.telling)}, {_list(t.without)}, "
    f"{max(8, 1 << (len(re.findall('[a-z0-9]+', t.wording.lower())) - 1).bit_length())})"
    for k, t in enumerate(licenses.TEMPLATES))
_PHRASES = ", ".join(f"({_text(label)}, {_text(words)}, {len(words.split())})" for label, words in licenses.PHRASES)

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents),
phrases(label, words, n) AS (VALUES {_PHRASES}),
templates(k, label, words, telling, without, width) AS (VALUES {_TEMPLATES}),
base AS (SELECT doc_id, label, i - 1 AS spot FROM (
           SELECT doc_id, w, label, words, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, phrases)
         WHERE array_to_string(w[i:i + n - 1], ' ') = words),
block AS (SELECT doc_id, width, list_distinct(w[i + 1:i + 2 * width]) AS words FROM (
            SELECT doc_id, w, width, unnest(range(0, len(w), width)) AS i FROM d, (SELECT DISTINCT width FROM templates))),
share AS (SELECT doc_id, label, len(list_intersect(b.words, t.words)) / len(t.words) AS share
          FROM block b JOIN templates t ON b.width = t.width
          WHERE len(list_intersect(b.words, t.words)) >= ceil({licenses.THRESHOLD} * len(t.words) - 1e-9)
            AND list_has_all(b.words, t.telling) AND NOT list_has_any(b.words, t.without)),
n AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY ALL),
alls AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
         FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM share) GROUP BY ALL),
best AS (SELECT doc_id, max(share) AS share FROM share GROUP BY ALL)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(n.labels, '') AS base_labels, coalesce(alls.labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN alls USING (doc_id) LEFT JOIN best USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
          GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS to_id FROM documents
          UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.to_id = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY ALL) c USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op4_benchmark_hits": OP4,
    "op5_quality_rules": OP5,
    "op7_license_scan": OP7,
    "op8_near_duplicates": OP8,
}
