"""Operator 3 [native]: license scan by an exact set-similarity join.

Blocks of text are joined with license templates: a pair is found exactly when
the block holds at least ``threshold`` of the template's distinct words. Blocks
are the lines and, for notices that are wrapped, every run of words over line
breaks that is as long as the template (counted with its repeated words). Words are ordered by how many documents hold them, rarest first. A
block can only reach a template if the two prefixes (the first size - need + 1
words, need = ceil(threshold * template size)) share a word, if the block has
at least ``need`` words of the vocabulary (length filter), and if what follows
the first shared word still suffices (positional filter); only pairs that pass
all three are verified. A word outside the templates' vocabulary can match
nothing, and ordering such words after all others changes no result, so a
block is reduced to its vocabulary words first. A run that reaches a template
holds a word of the template's prefix as well, so runs are only looked at
around such words, and only if the words about one suffice together.

The templates are a parameter of bounded size and stand in the plan as
literals, so documents are never shuffled: the join side that grows stays
where it is read, whatever share of the rows one block text has. The document
frequencies (one row for each vocabulary word) are the only thing gathered.

Cases: a null or empty text has no words and no labels; repeated rows are
scanned each; an empty table gives an empty result; extra columns are carried
only if named in ``keep``. Texts are read whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.session import table

THRESHOLD = 0.8
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, notice): the words of each notice as a set.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at www apache org licenses"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited, proprietary and confidential"),
]
MAX_TEMPLATES, MAX_VOCABULARY = 500, 5000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(str.maketrans(_UPPER, _LOWER)))


def _spaced(text: Column) -> Column:
    """Lower-cased words, each between two blanks of its own: ' mit  license '. No words: one or no blank pair."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")), F.lit(" "))


def _count_words(spaced: Column) -> Column:
    """Words in a string of '  '-separated words (blanks around it don't count)."""
    inner = F.trim(spaced)
    return F.when(F.length(inner) == 0, 0).otherwise((F.length(inner) - F.length(F.replace(inner, F.lit("  "), F.lit("")))) / 2 + 1).cast("long")


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """How many documents hold each word of the vocabulary (at most MAX_VOCABULARY rows come back)."""
    words = F.split(F.trim(_spaced(F.col(text_col))), "  ")
    found = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), words)).alias("w"))
    return {r["w"]: r["count"] for r in found.groupBy("w").count().collect()}


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """``keep``, counts and labels of each whole text, and ``matches``: array<struct<line, template, containment>>, lines from 0.

    A match of a run has the line in which the run begins: for each prefix word of the template, the first run around it with the most words.
    """
    lengths = [len(words_of(text)) for _, text in templates]
    sets = [(label, sorted(set(words_of(text)))) for label, text in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    if len(sets) > MAX_TEMPLATES or len(vocabulary) > MAX_VOCABULARY:
        raise ValueError("too many templates to stand in a plan as literals; scan with parts of them")
    frequency = document_frequencies(docs, vocabulary, text_col)
    ordered = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ordered)}
    sets = [(label, sorted(rank[w] for w in s)) for label, s in sets]
    need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for _, s in sets]
    rare = sorted({ordered[r] for (_, s), n in zip(sets, need) for r in s[: len(s) - n + 1]})

    df = docs.select(F.struct(*keep).alias("row"), F.inline(F.array(F.struct(_spaced(F.col(text_col)).alias("spaced"), F.col(text_col).alias("text")))))
    spaced = F.col("spaced")
    padded = {p: " " + "  ".join(p.split()) + " " for p in phrases}
    hits = {p: ((F.length(spaced) - F.length(F.replace(spaced, F.lit(s), F.lit("")))) / len(s)).cast("long") for p, s in padded.items()}
    n_words = _count_words(spaced)
    first = [F.when(spaced.contains(s), _count_words(F.substring_index(spaced, s, 1))) for s in padded.values()]
    last = [F.when(spaced.contains(s), n_words - _count_words(F.substring_index(spaced, s, -1)) - len(p.split())) for p, s in padded.items()]

    def match(t: int, line: Column) -> Column:
        """Containment of template t in a line (its vocabulary ranks, sorted), null if below the threshold."""
        ranks, n = sets[t][1], need[t]
        mine = F.array(*map(F.lit, ranks))
        prefix = F.slice(line, F.lit(1), F.size(line) - n + 1)
        common = F.array_intersect(mine, line)
        first_common = F.get(common, F.lit(0))
        rest = F.least(F.lit(len(ranks)) - F.array_position(mine, first_common), F.size(line) - F.array_position(line, first_common)) + 1
        passes = F.when(F.size(line) < n, False).when(~F.arrays_overlap(prefix, F.array(*map(F.lit, ranks[: len(ranks) - n + 1]))), False).when(rest < n, False).otherwise(F.size(common) >= n)
        return F.when(passes, F.size(common) / F.lit(float(len(ranks))))

    vocab = F.array(*map(F.lit, ordered))
    as_ranks = lambda ws: F.transform(F.array_intersect(vocab, ws), lambda w: (F.array_position(vocab, w) - 1).cast("int"))
    line_words = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.array_remove(F.split(F.trim(_spaced(x)), "  "), ""))
    # only texts that hold a word of some template's prefix can hold a match
    may = spaced.rlike(" (?:" + "|".join(map(re.escape, rare)) + ") ")
    df = df.select("row", "spaced", F.inline(F.array(F.struct(F.when(may, line_words).otherwise(F.array().cast("array<array<string>>")).alias("line_words")))))
    words = F.flatten("line_words")
    line_at = F.flatten(F.transform("line_words", lambda ws, k: F.array_repeat(k, F.size(ws))))
    df = df.select("row", "spaced", F.inline(F.array(F.struct(F.transform("line_words", as_ranks).alias("lines"), words.alias("words"), line_at.alias("line_at")))))
    anchors = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(rare))
    df = df.select("row", "spaced", "lines", "words", "line_at", F.inline(F.array(F.struct(F.when(F.size("lines") > 1, anchors).otherwise(F.array().cast("array<struct<i:int,w:string>>")).alias("anchors")))))

    def runs(t: int) -> Column:
        """Matches of template t in runs of its length over line breaks, one for each prefix word at most."""
        mine, size, n = [ordered[r] for r in sets[t][1]], lengths[t], need[t]
        own = F.array(*map(F.lit, mine))
        common = lambda a, k: F.size(F.array_intersect(own, F.slice("words", a + 1, F.lit(k))))

        def best(x):
            low = F.greatest(x["i"] - size + 1, F.lit(0))
            crosses = lambda a: F.get("line_at", a) != F.get("line_at", F.least(a + size, F.size("words")) - 1)
            made = F.transform(F.filter(F.sequence(low, x["i"]), crosses), lambda a: F.struct(common(a, size).alias("c"), (-a).alias("a")))
            return F.when(common(low, 2 * size - 1) >= n, F.array_max(made))

        near = F.filter("anchors", lambda x: x["w"].isin(mine[: len(mine) - n + 1]))
        found = F.filter(F.transform(near, best), lambda m: m["c"] >= n)
        return F.array_distinct(F.transform(found, lambda m: F.struct(F.get("line_at", -m["a"]).alias("line"), F.lit(t).alias("template"), (m["c"] / F.lit(float(len(mine)))).alias("containment"))))

    pairs = F.filter(
        F.flatten(F.transform("lines", lambda line, k: F.array(*(F.struct(k.alias("line"), F.lit(t).alias("template"), match(t, line).alias("containment")) for t in range(len(sets)))))),
        lambda x: x["containment"].isNotNull(),
    )
    pairs = F.concat(pairs, F.when(F.size("anchors") > 0, F.concat(*(runs(t) for t in range(len(sets))))).otherwise(F.array().cast("array<struct<line:int,template:int,containment:double>>")))
    names = F.array(*(F.lit(label) for label, _ in sets))
    base = F.array(*(F.when(spaced.contains(s), F.lit(phrases[p])) for p, s in padded.items()))
    base = F.array_sort(F.array_distinct(F.array_compact(base)))
    df = df.select(
        "row",
        n_words.alias("n_words"),
        sum(hits.values(), F.lit(0).cast("long")).alias("n_base"),
        F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"),
        base.alias("base"),
        F.inline(F.array(F.struct(pairs.alias("matches")))),
    )
    own = F.transform("matches", lambda x: F.get(names, x["template"]))
    return df.select(
        "row.*",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0))).alias("score"),
        "matches",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return scan(table(spark, sf_dir, "documents")).drop("matches")


def oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda xs: "[" + ", ".join(map(quote, xs)) + "]"
    templates = ", ".join(f"({i}, {quote(label)}, {listed(sorted(set(words_of(text))))})" for i, (label, text) in enumerate(TEMPLATES))
    places = []
    for p, label in PHRASES.items():
        ws = p.split()
        test = " AND ".join(f"w[i + {k + 1}] = {quote(x)}" for k, x in enumerate(ws))
        places.append(f"SELECT doc_id, i, {quote(label)} AS label FROM at_word WHERE {test}")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all({low('text')}, '{pattern}') AS w FROM d),
at_word AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM words),
places AS ({' UNION ALL '.join(places)}),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS base FROM places GROUP BY doc_id),
templates(t, label, words) AS (VALUES {templates}),
blocks AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block FROM d),
tokens AS (SELECT doc_id, list_distinct(regexp_extract_all({low('block')}, '{pattern}')) AS b FROM blocks WHERE length(block) > 0),
found AS (SELECT doc_id, label, len(list_intersect(words, b)) / len(words)::DOUBLE AS c FROM tokens, templates WHERE len(list_intersect(words, b)) >= greatest(1, ceil({THRESHOLD} * len(words) - 1e-9))),
best AS (SELECT doc_id, list(DISTINCT label) AS own, max(c) AS c FROM found GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(c, 0.0))::DOUBLE AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id)"""
