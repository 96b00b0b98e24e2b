"""Operator 7 — license notices by an exact set-similarity join, built-in functions only.

A template is the wording of a public license's notice: its distinct words, the
*telling* words that a notice must hold (else CC BY would pass for CC BY-NC) and
words that make it another notice.  Blocks are windows of words over the whole
text, whatever its lines: for templates of up to W words (W = 8, 16, 32, …)
windows of 2 W words start at every W-th word, so every notice of up to W words
lies whole in one of them, and words scattered over a long line do not meet.  A
block matches a template if it holds ``THRESHOLD`` of its words, all telling words
and none of the others.

One pass counts in how many documents each template word stands; words are then
ordered rarest first, and a block meets a template only through

* the prefix filter: it holds one of the first ``|T| - need + 1`` words of the
  template, ``need = ceil(threshold · |T|)`` (else it misses too many), so blocks are
  formed only around such words, and an index from prefix words to templates
  names the candidates;
* the length filter: it holds at least ``need`` template words;
* the positional filter: behind the first shared word both sides have enough
  words left to reach ``need``;

and the survivors are counted exactly, so no match is lost.

Scale: the template side is a parameter of a few hundred words and becomes three
literals of the plan, whose size does not multiply with the templates; documents
are never shuffled or exploded for the join, so a hot source or a passage that
all documents share costs what any other costs.  The counts of the template words
are the only aggregate.

The base phrases are found in the raw text by one pattern.

Cases: null text counts as empty (no words, no labels, null positions, score
0); an empty table gives an empty result; equal rows get equal labels; other
columns are carried through, and must not be called ``n_words``, ``n_base``,
``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` or ``notices``
(those are replaced).
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import ALNUM, NOT_ALNUM, let, text_or_empty

THRESHOLD = 0.8
# Least size class: templates of up to so many words share windows of twice as many.
LEAST_WINDOW = 8

# Contract phrases and labels (fixed values).
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))


class Template(NamedTuple):
    """A notice: its label, wording, the words it must hold and those it must not."""
    label: str
    wording: str
    telling: str
    without: str = ""


# Notice wordings of public licenses (fixed values).
TEMPLATES = (
    Template("mit", "Released under the MIT License.", "mit"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                    "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                    "sublicense, and/or sell copies of the Software", "sublicense charge"),
    Template("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                       "except in compliance with the License. You may obtain a copy of the License at", "apache compliance"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general",
             "lesser affero"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                    "General Public License as published by the Free Software Foundation, either version 3 of the "
                    "License, or (at your option) any later version.", "gnu general", "lesser affero"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                     "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
                     "the License, or (at your option) any later version.", "gnu lesser"),
    Template("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                     "Affero General Public License as published by the Free Software Foundation, either version 3 of "
                     "the License, or (at your option) any later version.", "gnu affero"),
    Template("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU "
                     "Free Documentation License, Version 1.3 or any later version published by the Free Software "
                     "Foundation", "documentation gnu"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met", "redistribution binary"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted",
             "redistribution binary"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                    "is hereby granted, provided that the above copyright notice and this permission notice appear in "
                    "all copies.", "fee purpose"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla"),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                    "License", "eclipse"),
    Template("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution "
                     "License", "development distribution common"),
    Template("eupl", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission",
             "eupl"),
    Template("boost", "Distributed under the Boost Software License, Version 1.0.", "boost"),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the "
                     "authors be held liable for any damages arising from the use of this software.", "express implied held"),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    Template("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "sil font"),
    Template("artistic", "This program is free software; you may redistribute it under the terms of the Artistic License",
             "artistic"),
    Template("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any "
                           "purpose, without fee, and without a written agreement is hereby granted", "written agreement fee"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
                    "rights to this work", "waived neighboring"),
    Template("cc-by", "Licensed under CC BY 4.0.", "cc by", "nc sa nd"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc", "sa nd"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa", "nc nd"),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0.", "cc by nd", "nc sa"),
    Template("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa", "nd"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License",
             "creative commons attribution", "noncommercial sharealike noderivatives"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
             "creative commons sharealike", "noncommercial noderivatives"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                         "License", "creative commons noncommercial", "sharealike noderivatives"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def window_of(template: Template) -> int:
    """Size class of a template: the window of twice as many words holds any copy of it that starts in its first half."""
    window = LEAST_WINDOW
    while window < len(words_of(template.wording)):
        window *= 2
    return window


def _phrase_pattern() -> str:
    inner = "|".join(f"{NOT_ALNUM}+".join(words.split()) for _, words in PHRASES)
    return f"(?<!{ALNUM})(?i:{inner})(?!{ALNUM})"


def _words(text: Column) -> Column:
    """Words of a text; text that begins with a separator must not start with an empty word."""
    return let(F.split(text, NOT_ALNUM + "+"), lambda w: F.when(w[0] == "", F.slice(w, 2, F.size(w))).otherwise(w))


def template_frequencies(docs: DataFrame, templates: Sequence[Template], text: str = "text") -> dict[str, int]:
    """Documents of the whole corpus that hold each template word (words that stand nowhere: 0)."""
    vocabulary = sorted({w for t in templates for w in words_of(t.wording)})
    known = F.lit(vocabulary).cast("array<string>")
    # Only the order comes from these counts, so Unicode folding does no harm here.
    held = (docs.select(F.explode(F.array_intersect(_words(F.lower(text_or_empty(text))), known)).alias("word"))
                .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["word"]: r["n"] for r in held.collect()}      # at most one row per template word
    return {w: counts.get(w, 0) for w in vocabulary}


class Index:
    """Templates over ranks (rarest word first): sets, prefixes, and which templates a prefix word leads to."""

    def __init__(self, templates: Sequence[Template], frequencies: dict[str, int], threshold: float) -> None:
        extra = {w for t in templates for w in words_of(f"{t.telling} {t.without}")} - set(frequencies)
        self.order = sorted(frequencies, key=lambda w: (frequencies[w], w)) + sorted(extra)
        rank = {w: i + 1 for i, w in enumerate(self.order)}
        ranks = lambda text: sorted({rank[w] for w in words_of(text)})
        self.rows, self.leads = [], {}
        for k, t in enumerate(templates):
            whole = ranks(t.wording)
            need = math.ceil(threshold * len(whole) - 1e-9)
            prefix = whole[:len(whole) - need + 1]
            self.rows.append((t.label, window_of(t), whole, prefix, need, ranks(t.telling), ranks(t.without)))
            for r in prefix:
                self.leads.setdefault(r, []).append(k + 1)
        self.windows = sorted({row[1] for row in self.rows})

    def prefix_words(self, window: int) -> list[str]:
        return sorted({self.order[r - 1] for row in self.rows if row[1] == window for r in row[3]})

    def templates(self) -> Column:
        kind = ("array<struct<label:string,window:int,whole:array<int>,prefix:array<int>,need:int,telling:array<int>,"
                "without:array<int>>>")
        ints = lambda xs: F.lit(list(xs)).cast("array<int>") if xs else F.array().cast("array<int>")
        return F.array(*[F.struct(F.lit(a), F.lit(b), ints(c), ints(d), F.lit(e), ints(f), ints(g))
                         for a, b, c, d, e, f, g in self.rows]).cast(kind)

    def lead(self) -> Column:
        """Per rank the numbers of the templates whose prefix holds it."""
        none = F.array().cast("array<int>")
        return F.array(*[F.lit(self.leads[r]).cast("array<int>") if r in self.leads else none
                         for r in range(1, len(self.order) + 1)])


def match_block(words: Column, window: int, index: Index) -> Column:
    """Array of (label, containment) of the templates of the size class that the block of words holds."""
    listed = F.lit(index.order).cast("array<string>")
    lead, templates = index.lead(), index.templates()
    has = lambda a, b: F.size(F.array_intersect(a, b))

    def against(block: Column) -> Column:
        # Block words as ascending ranks; those outside the vocabulary cannot add to any overlap.
        candidates = F.array_distinct(F.flatten(F.transform(block, lambda r: F.element_at(lead, r))))

        def one(t: Column) -> Column:
            first = F.array_min(F.array_intersect(block, t["prefix"]))
            reachable = 1 + F.least(F.size(t["whole"]) - F.array_position(t["whole"], first),
                                    F.size(block) - F.array_position(block, first))
            overlap = has(block, t["whole"])
            return F.when(
                (t["window"] == window) & (F.size(block) >= t["need"]) & (reachable >= t["need"])
                & (overlap >= t["need"]) & (has(block, t["telling"]) == F.size(t["telling"]))
                & (has(block, t["without"]) == 0),
                F.struct(t["label"].alias("label"), (overlap / F.size(t["whole"])).alias("score")))
        return F.filter(F.transform(candidates, lambda k: one(F.element_at(templates, k))), lambda m: m.isNotNull())

    folded = F.transform(words, lambda w: F.translate(w, _UPPER, _LOWER))
    ranks = F.sort_array(F.transform(F.array_intersect(folded, listed), lambda w: F.array_position(listed, w).cast("int")))
    return let(ranks, against)


def notices_in(text: Column, index: Index) -> Column:
    """Array of (label, score, start, text): blocks that hold a notice, ``start`` their first word (from 0)."""
    everything = sorted({w for window in index.windows for w in index.prefix_words(window)})
    kind = "array<struct<label:string,score:double,start:int,text:string>>"

    def in_document(anchors: Column) -> Column:
        def of_class(words: Column, window: int) -> Column:
            mine = F.filter(anchors, lambda a: a["word"].isin(index.prefix_words(window)))
            # A block starts at every window-th word and spans two of them.
            at = F.array_distinct(F.flatten(F.transform(mine, lambda a: F.array(
                F.floor(a["at"] / window), F.floor(a["at"] / window) - 1))))
            spots = F.filter(at, lambda b: b >= 0)

            def block(b: Column) -> Column:
                own = F.slice(words, (b * window + 1).cast("int"), 2 * window)
                return let(own, lambda o: F.transform(match_block(o, window, index), lambda m: F.struct(
                    m["label"].alias("label"), m["score"].alias("score"), (b * window).cast("int").alias("start"),
                    F.array_join(o, " ").alias("text"))))
            return F.flatten(F.transform(spots, block))

        # The words as they stand are cut again only where an anchor was found.
        return F.when(F.size(anchors) == 0, F.array().cast(kind)).otherwise(
            let(_words(text), lambda w: F.concat(*[of_class(w, window) for window in index.windows])).cast(kind))

    # Unicode folding keeps word borders and finds every A-Z fold; blocks are folded exactly.
    anchors = F.filter(F.transform(_words(F.lower(text)), lambda w, i: F.when(
        w.isin(everything), F.struct(i.alias("at"), w.alias("word")))), lambda a: a.isNotNull())
    return let(anchors, in_document)


def with_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES,
                  threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and ``notices``
    (the matched blocks with label, containment, first word and text)."""
    index = Index(templates, template_frequencies(docs, templates, text), threshold)
    body = text_or_empty(text)
    phrase = F.lit(_phrase_pattern())
    word = F.lit(ALNUM + "+")
    has = body.rlike("(?i:license)")
    none = F.array().cast("array<string>")

    found = F.when(has, F.regexp_extract_all(body, phrase, F.lit(0))).otherwise(none)
    # The phrases share no word, so the text between them has every other word whole.
    between = F.when(has, F.split(body, _phrase_pattern(), -1)).otherwise(none)
    staged = (docs.withColumn("n_words", F.regexp_count(body, word).cast("long"))
                  .withColumn("_found", found).withColumn("_between", between)
                  .withColumn("notices", notices_in(body, index)))

    label = lambda m: F.when(m.rlike("^(?i:mit)"), "mit").when(m.rlike("^(?i:apache)"), "apache").otherwise("gpl")
    any_base = F.size("_found") > 0
    last_length = F.regexp_count(F.element_at("_found", -1), word)
    base = F.array_distinct(F.transform("_found", label))
    joined = lambda a: F.array_join(F.sort_array(a), ",")
    return (staged.withColumns({
                "n_base": F.size("_found").cast("long"),
                "first_word": F.when(any_base, F.regexp_count(F.element_at("_between", 1), word)).cast("long"),
                "last_word": F.when(any_base, F.col("n_words") - last_length
                                    - F.regexp_count(F.element_at("_between", -1), word)).cast("long"),
                "base_labels": joined(base),
                "labels": joined(F.array_union(base, F.transform("notices", lambda m: m["label"]))),
                "score": F.when(any_base, F.lit(1.0)).otherwise(
                    F.coalesce(F.array_max(F.transform("notices", lambda m: m["score"])), F.lit(0.0)))})
            .drop("_found", "_between"))
