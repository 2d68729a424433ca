"""License scans by an exact set-similarity join of text blocks with licence templates (DataFrame functions only).

A block is a line of the lower-cased text, a template the word set of a licence notice. A block has a template's label when
it holds at least ``CONTAINMENT`` of its words. With all words in one order, the globally rarest first (counted over
the blocks of the whole corpus), a block that holds ``a`` of a template's ``t`` words shares a word among its own first
``|b| - a + 1`` and the template's first ``t - a + 1`` (prefix filter), has at least ``a`` words (length filter), and what
follows the first shared word in both must suffice (positional filter). Only words of the templates matter, so blocks are
cut down to them first. What remains is verified by the intersection itself.

A notice may also be wrapped over lines. So a template's label goes as well to texts of several lines in which, whatever the line
ends, some ``REACH`` times as many consecutive words as the notice has hold ``CONTAINMENT`` of its words, and in the notice's
order: as many of its words in a row as are left when the words that may be missing are taken out of it. Any word order within
a line and the notice's order across lines are both part of the definition. The words of the whole text go through the same join as
a further block; only what is left of that is looked at window by window.

Beside the templates, the operator reports where the three base phrases stand word by word.

Defined cases: null and empty texts have no words, null places, empty labels and score 0; each row is scanned by itself, so
repeated rows give repeated results; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm.common import let, store, table

CONTAINMENT = 0.9
#: Words of a window, over the words of the notice that is looked for in it.
REACH = 2
#: Phrases that are looked up word by word, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices as their licences give them (fixed values).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KELVIN = "K"


#: Block number of a whole text; its lines are numbered from 0.
_WHOLE = -1


def template_words(text: str) -> list[str]:
    return sorted(set(template_sequence(text)))


def template_sequence(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def lowered(text: Column) -> Column:
    """A-Z in lower case. The one other letter whose lower case is in a-z is put out of the way; the case of
    letters beyond a-z has no part in words or templates."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit("ß")))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, _BETWEEN), "")


def _least(size: int, containment: float) -> int:
    return math.ceil(size * containment - 1e-9)


def least_in_order(text: str, containment: float) -> int:
    """Words of the notice's sequence that are left at least, whichever words of it are missing at ``containment``."""
    times = sorted(Counter(template_sequence(text)).values(), reverse=True)
    return sum(times[len(times) - _least(len(times), containment):])


def _places(w: Column, phrase: str) -> Column:
    """Starts of the phrase in the word array."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        found = F.get(w, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            found = found & F.coalesce(F.get(w, i + j) == p, F.lit(False))
        return found
    return F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)


def prepared(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: word count, base places, the blocks cut down to the templates' words, and for texts of several
    lines the places of these words in the text (``spots``)."""
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    fewest = min(_least(len(template_words(t)), containment) for _, t in templates)
    low = docs.select("doc_id", lowered(F.col("text")).alias("low"))
    # the word array is made only where each phrase's first or last word may stand
    maybe = F.lit(False)
    for phrase, _ in BASE:
        has = F.lit(True)
        for part in phrase.split(" "):
            has = has & F.col("low").contains(part)
        maybe = maybe | has
    none = F.array().cast("array<int>")
    found = let(_words(F.col("low")), lambda w: F.array(*[
        F.when(F.size(w) > 0, _places(w, phrase)).otherwise(none) for phrase, _ in BASE]))
    out = low.withColumn("at", F.when(maybe, found).otherwise(F.array(*[none] * len(BASE))))
    starts = F.flatten("at")
    cut = F.transform(F.split("low", "[\n\r]"), lambda line: F.array_distinct(
        F.filter(F.split(line, _BETWEEN), lambda x: x.isin(vocabulary))))
    spots = F.filter(F.transform(F.split("low", _BETWEEN), lambda x, i: F.struct(i.alias("at"), x.alias("word"))),
                     lambda x: x["word"].isin(vocabulary))
    return out.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"), F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.size(F.col("at")[i]) > 0, F.lit(x)) for i, (_, x) in enumerate(BASE)])).alias("base"),
        F.filter(cut, lambda b: F.size(b) >= fewest).alias("blocks"),
        F.when(F.col("low").rlike("[\n\r]"), spots).alias("spots"))


def template_matches(found: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(row, block, template, label, containment) of every block of ``prepared`` and template at or above the threshold; the
    words of a text of several lines are its block ``_WHOLE``."""
    spark: SparkSession = found.sparkSession
    fewest = min(_least(len(template_words(t)), containment) for _, t in templates)
    whole = (found.where("spots is not null")
             .select("row", F.lit(_WHOLE).alias("block"), F.array_distinct("spots.word").alias("words"))
             .where(F.size("words") >= fewest))
    blocks = found.select("row", F.posexplode("blocks").alias("block", "words")).unionByName(whole)
    # the global order: as many rows as the templates have words, whatever the corpus
    counts = dict(blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect())
    vocabulary = sorted({w for _, t in templates for w in template_words(t)}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    rows = []
    for number, (label, text) in enumerate(templates):
        t = sorted(rank[w] for w in template_words(text))
        least = _least(len(t), containment)
        rows += [(number, label, t, least, place, t[place]) for place in range(len(t) - least + 1)]
    heads = spark.createDataFrame(rows, "template int, label string, t array<int>, least int, t_place int, word int")
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    ordered = blocks.select("row", "block", F.array_sort(F.transform("words", lambda w: ranks[w])).alias("b"))
    prefix = ordered.select("row", "block", "b", F.size("b").alias("n"), F.posexplode(
        F.slice("b", F.lit(1), F.size("b") - F.lit(fewest - 1))).alias("place", "word"))
    # the templates are a fixed list, so their side of the join is small at every scale
    met = prefix.join(F.broadcast(heads), "word").where(
        (F.col("n") >= F.col("least"))
        & (F.col("place") <= F.col("n") - F.col("least"))
        & (F.least(F.col("n") - F.col("place"), F.size("t") - F.col("t_place")) >= F.col("least")))
    pairs = met.dropDuplicates(["row", "block", "template"])
    held = F.size(F.array_intersect("b", "t"))
    return pairs.select("row", "block", "template", "label", (held / F.size("t")).alias("containment"), held.alias("held"), "least"
                        ).where("held >= least").drop("held", "least")


def wrapped_matches(found: DataFrame, matches: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(row, label, containment) of the templates that stand in a window of words, in order, among the whole texts in ``matches``."""
    spark: SparkSession = found.sparkSession
    rows = []
    for number, (_, text) in enumerate(templates):
        notice, least = template_sequence(text), least_in_order(text, containment)
        # words in order begin with one that so few others stand before
        rows.append((number, notice, sorted(set(notice[:len(notice) - least + 1])), least,
                     _least(len(set(notice)), containment)))
    notices = spark.createDataFrame(rows, "template int, notice array<string>, heads array<string>, in_order int, least int")
    # a template that a line has in full can't be found any better
    open_pairs = (matches.groupBy("row", "template", "label")
                  .agg(F.min("block").alias("block"), F.max(F.when(F.col("block") != _WHOLE, F.col("containment"))).alias("best"))
                  .where((F.col("block") == _WHOLE) & (F.coalesce("best", F.lit(0.0)) < 1.0)))
    spots = open_pairs.join(F.broadcast(notices), "template").join(found.select("row", "spots"), "row").withColumn(
        "spots", F.filter("spots", lambda x: F.array_contains("notice", x["word"])))
    length = F.size("notice")
    starts = F.filter(F.transform("spots", lambda x, i: F.struct(x.alias("spot"), (i + 1).alias("i"))),
                      lambda x: F.array_contains("heads", x["spot"]["word"]))
    windows = F.transform(starts, lambda s: F.transform(
        F.filter(F.slice("spots", s["i"], length * REACH), lambda x: x["at"] < s["spot"]["at"] + length * REACH),
        lambda x: x["word"]))
    full = spots.select("row", "label", "notice", "in_order", F.explode(F.filter(
        windows, lambda w: F.size(F.array_distinct(w)) >= F.col("least"))).alias("window"))
    return full.where(_in_order("window", "notice") >= F.col("in_order")).select(
        "row", "label", (F.size(F.array_distinct("window")) / F.size(F.array_distinct("notice"))).alias("containment"))


def _in_order(window: str, notice: str) -> Column:
    """Length of the longest common subsequence, by rows: at j the length with the first j words of the notice."""
    places = F.sequence(F.lit(1), F.size(notice))

    def row(last: Column, word: Column) -> Column:
        here = F.filter(places, lambda i: F.get(F.col(notice), i - 1) == word)
        # ``last`` never falls, so of the places up to j where the word stands the last one is the best
        return let(here, lambda at: F.transform(last, lambda x, j: F.greatest(x, F.coalesce(
            F.get(last, F.array_max(F.filter(at, lambda i: i <= j)) - 1) + 1, F.lit(0)))))
    return F.element_at(F.aggregate(window, F.array_repeat(F.lit(0), F.size(notice) + 1), row), -1)


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best containment found)."""
    found = store(prepared(docs, templates, containment), "license-blocks")
    matches = store(template_matches(found, templates, containment), "license-matches")
    hits = (matches.where(F.col("block") != _WHOLE).select("row", "label", "containment")
            .unionByName(wrapped_matches(found, matches, templates, containment)).groupBy("row")
            .agg(F.collect_set("label").alias("by_template"), F.max("containment").alias("best")))
    both = F.array_sort(F.array_union("base", F.coalesce("by_template", F.array().cast("array<string>"))))
    return found.drop("blocks", "spots").join(hits, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def op3_license_scan(spark, sf_dir) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    az = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    notices = ", ".join(f"('{label}', {template_words(t)!r}, {_least(len(template_words(t)), CONTAINMENT)})"
                        for label, t in TEMPLATES)
    places = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, i - 1 AS spot FROM d, unnest(range(1, len(w) + 1)) u(i) "
        f"WHERE w[i:i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in BASE)
    return rf"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, {az} AS t FROM documents),
d AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM low),
notices(label, tw, least) AS (VALUES {notices}),
places AS ({places}),
base AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
lines AS (SELECT r, list_distinct(regexp_extract_all(unnest(string_split_regex(t, '[\n\r]')), '{WORD}')) AS b FROM d),
hits AS (SELECT r, label, len(list_intersect(b, tw)) / len(tw) AS c FROM lines, notices
         WHERE len(list_intersect(b, tw)) >= least),
best AS (SELECT r, max(c) AS c FROM hits GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM (SELECT r, label FROM places UNION ALL SELECT r, label FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best.c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN every USING (r)
"""


ORACLE_SQL = _sql()
