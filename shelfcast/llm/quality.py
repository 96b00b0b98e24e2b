"""Operator 5 — line-first quality rules, built-in functions only.

Each line with a word is judged by itself: it fails as navigation (cut by
separators, or a menu phrase without a sentence end), as boilerplate (stock
phrases), for lacking any closing punctuation, or for carrying symbols or shouted
marks on most words.  A line that runs on needs no closing punctuation: one of
``RUN_ON_WORDS`` that ends in a comma or a dash, one that ends as code does, and
one whose next lines go on in lower case until one of them (at most ``WRAPPED``
lines on) has a sentence end, so wrapped prose, verse and code keep their lines.  Separators and stock phrases count by the line's words, so a long
paragraph or a document in one line does not fail for a phrase that it mentions.
Failing lines are removed; a document that loses more than ``MAX_LOST`` of
the characters of its lines is rejected, and so is one that fails the base
rules (fewer than 50 words, or more than half of its words inside repeated
three-word windows).

No shuffle: every figure comes from the row's own text.  Repeated windows
are found by sorting a row's window hashes (64 bits; two different windows
of one text share one with probability n²/2⁶⁵), so junk of one phrase costs
n log n, not n².  Everything runs in the JVM in one pass.

Cases: null text counts as empty (no words, base rules reject it); blank
lines are neither judged nor removed; equal rows get equal verdicts; other
columns are carried through, and must not be called like the figures named in
``with_quality`` (those are replaced).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import SPACE, WORD, let, text_or_empty

# Contract values of the base rules.
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3

# Line rules (parameters).
MAX_LOST = 0.5            # share of line characters a kept document may lose
MAX_SEPARATORS = 2        # menu separators in a line of prose
MAX_SEPARATOR_SHARE = 0.1  # menu separators per word, in a line with more than those
PHRASE_WORDS = 20         # words of a line that one stock phrase makes boilerplate
MAX_SYMBOL_SHARE = 0.3    # symbols, or shouted marks, per word
RUN_ON_WORDS = 4          # words of a line that may end in a comma or a dash
WRAPPED = 3               # lines within which a wrapped sentence must end
# Patterns read alike by Java and by RE2: no \\b, \\s or $ (fixed values; stock phrases in the languages of the tables).
ENDINGS = r"""[.!?:;…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*\z"""
SENTENCE_INSIDE = r"""[.!?…。！？][\"'”’»)\]]*[\x20\x09-\x0D]"""
RUN_ON = r"[,\-–—][\x20\x09-\x0D]*\z"
CODE_END = r"[{};()\[\]][\x20\x09-\x0D]*\z"
GOES_ON = r"^[\x20\x09-\x0D]*[a-zàâäæçèéêëíîïñóôöœùúûüÿß]"
NAVIGATION = (r"(?i)^[^A-Za-z0-9_]*(home|menu|log ?in|sign (in|up)|next|previous|search|skip to|back to|read more|click here|"
              r"share|startseite|anmelden|weiterlesen|zurück zu|accueil|connexion|lire la suite|retour à|inicio|"
              r"iniciar sesión|leer más|volver a)([^A-Za-z0-9_]+([A-Za-z0-9_]+[^A-Za-z0-9_]+){0,4}[A-Za-z0-9_]*)?\z")
BOILERPLATE = (r"(?i)all rights reserved|cookie|privacy policy|terms of (use|service)|enable javascript|"
               r"lorem ipsum|subscribe to|powered by|newsletter|alle rechte vorbehalten|datenschutzerkl|"
               r"tous droits r|mentions l.gales|todos los derechos reservados|pol.tica de privacidad")


def repeat_words(words: Column) -> Column:
    """Words that lie in a ``WINDOW``-word window found at least twice, the first included."""
    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, k: F.when(k == F.size(starts) - 1, F.lit(WINDOW)).otherwise(
            F.least(F.lit(WINDOW), F.get(starts, k + 1) - p)))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(order: Column) -> Column:
        same = lambda x, k: F.get(order, k)["h"].eqNullSafe(x["h"])
        starts = F.transform(F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
        return let(F.sort_array(starts), covered)

    def by_hash(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(order, repeated))

    window = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                         lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(window, by_hash))


def line_fails(line: Column, following: Sequence[Column]) -> Column:
    """The verdict on one line that has a word; ``following`` are the next ``WRAPPED`` lines, null behind the last."""
    n_words = F.regexp_count(line, F.lit(WORD))
    limit = n_words * MAX_SYMBOL_SHARE
    separators = F.regexp_count(line, F.lit(r"[|»›•]"))
    ends = line.rlike(ENDINGS)
    wrapped = F.lit(False)
    for x in reversed(following):
        wrapped = F.coalesce(x.rlike(GOES_ON), F.lit(False)) & (x.rlike(ENDINGS) | x.rlike(SENTENCE_INSIDE) | wrapped)
    runs_on = line.rlike(CODE_END) | (line.rlike(RUN_ON) & (n_words >= RUN_ON_WORDS)) | wrapped
    return ((~ends & ~line.rlike(SENTENCE_INSIDE) & ~runs_on)
            | ((separators > MAX_SEPARATORS) & (separators > n_words * MAX_SEPARATOR_SHARE))
            | (~ends & line.rlike(NAVIGATION))
            | (line.rlike(BOILERPLATE) & (F.regexp_count(line, F.lit(BOILERPLATE)) * PHRASE_WORDS >= n_words))
            | (line.rlike(SYMBOLS) & (F.regexp_count(line, F.lit(SYMBOLS)) > limit))
            | (F.contains(line, F.lit("!!")) & (F.regexp_count(line, F.lit("!!+")) > limit)))


def with_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the figures of the base rules, ``base_failed``, ``lost`` (share of line
    characters on failing lines), ``cleaned`` (the text without those lines) and ``kept``."""
    body = text_or_empty(text)
    has_word = lambda line: line.rlike(WORD)

    def word_figures(words: Column) -> Column:
        chars = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
        return F.struct(F.size(words).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
                        repeat_words(words).cast("long").alias("n_repeat_words"))

    def line_figures(lines: Column) -> Column:
        judged = F.transform(lines, lambda x, i: F.struct(
            x.alias("line"), F.when(has_word(x), F.length(x)).otherwise(0).alias("size"),
            F.when(has_word(x), line_fails(x, [F.get(lines, i + k) for k in range(1, WRAPPED + 1)])).otherwise(F.lit(False)).alias("fails")))
        with_word = F.filter(lines, has_word)
        return F.struct(judged.alias("judged"),
                        let(with_word, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("dup"))

    words = F.filter(F.split(body, SPACE + "+"), lambda w: w != "")
    staged = (docs.withColumn("_w", let(words, word_figures))
                  .withColumn("_l", let(F.split(body, "\n"), line_figures)))
    judged = F.col("_l.judged")
    total = F.aggregate(judged, F.lit(0), lambda a, x: a + x["size"])
    lost = F.aggregate(judged, F.lit(0), lambda a, x: a + F.when(x["fails"], x["size"]).otherwise(0))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    return (staged.withColumns({
                "n_words": F.col("_w.n_words"), "word_chars": F.col("_w.word_chars"),
                "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
                "n_dup_lines": F.col("_l.dup"), "n_repeat_words": F.col("_w.n_repeat_words"),
                "lost": F.coalesce(F.try_divide(lost, total), F.lit(0.0)),
                "cleaned": F.array_join(F.transform(F.filter(judged, lambda x: ~x["fails"]), lambda x: x["line"]), "\n")})
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= MAX_LOST))
            .drop("_w", "_l"))
