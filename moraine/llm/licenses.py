"""License scans by diagonal voting.  DataFrame functions only.

Templates are short phrases and longer notices, as words.  Every rolling word k-gram of a text is hashed and joined with the
templates' k-gram hashes (k is 2 for phrases, 4 for notices); the words of a hit are compared at once, so hash collisions fall away.
A hit at text position p and template position t votes for the diagonal p - t.  Votes are aggregated for each (text, template,
diagonal).  A phrase stands where a diagonal has a vote for each of its k-grams: its words one after another.  For notices
neighbouring diagonals are merged, as a word added or left out moves the rest to the next one: sorted diagonals belong to one span while each is within
``BAND`` of the one before.  A hit elsewhere in the text votes for a diagonal of its own and leaves the span alone.  A span is verified by
the share of the template's words that its votes cover; ``COVER`` or more gives the template's label.

The templates are a parameter: a DataFrame of (text, label, is_base), by default the fixed lists below.  They are broadcast if they have ``BROADCAST`` k-grams at
most, which is counted first, else joined like any table.  Texts are not shuffled, only hits and row keys are.

Defined results: null and empty texts have no words and no places; templates with fewer words than k, or null ones, are ignored; of a template
given twice one counts; repeated rows stay repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm._common import Scratch
from moraine.llm.tokens import count_words, lowered, positions, raw_words, text_key

#: fixed values: base phrases and their labels
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: fixed values: openings of well-known public license notices, and their labels
NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "apache"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
]
PHRASE_K, NOTICE_K = 2, 4
BAND, COVER = 3, 0.6
BROADCAST = 100_000  # k-grams of templates, each some 100 bytes


def template_rows() -> list[tuple[int, str, bool, int, list[str]]]:
    """(template, label, is_base, k, words) of all templates."""
    cut = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    rows = [(label, True, PHRASE_K, cut(t)) for t, label in PHRASES] + [(label, False, NOTICE_K, cut(t)) for t, label in NOTICES]
    return [(i, *r) for i, r in enumerate(rows)]


def fixed_templates(spark) -> DataFrame:
    """(text, label, is_base) of PHRASES and NOTICES."""
    return spark.createDataFrame([(t, label, base) for base, part in ((True, PHRASES), (False, NOTICES)) for t, label in part], "text string, label string, is_base boolean")


def template_table(templates: DataFrame) -> DataFrame:
    """(template, label, is_base, k, size, words): a number for each distinct template."""
    k = F.when(F.col("is_base"), PHRASE_K).otherwise(NOTICE_K)
    rows = templates.where("label IS NOT NULL AND is_base IS NOT NULL").select("label", "is_base", k.alias("k"), lowered(raw_words(F.col("text"))).alias("words"))
    rows = rows.where(F.size("words") >= F.col("k")).distinct()
    return rows.select(F.xxhash64("label", "is_base", "words").alias("template"), "label", "is_base", "k", F.size("words").alias("size"), "words")


def _grams(table: DataFrame, k: int) -> DataFrame:
    """(hash, hits): for each k-gram hash of the templates with this k, where it stands: array of (template, t, words)."""
    rows = table.where(F.col("k") == k).select("template", "words", F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("t"))
    rows = rows.select("template", "t", F.slice("words", F.col("t") + 1, k).alias("gram"))
    h = F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(k)])
    return rows.groupBy(h.alias(f"h{k}")).agg(F.sort_array(F.collect_list(F.struct("template", "t", "gram"))).alias(f"hits{k}"))


def _lower(text):
    """Lower case by which the same words become ASCII words as by lower-casing A-Z alone: the two other characters whose lower case
    begins with an ASCII letter are replaced before.  Words with characters beyond ASCII match no template either way."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u03ba")), F.lit("\u0130"), F.lit("\u03ba")))


def find_hits(docs: DataFrame, table: DataFrame, text_col: str = "text", small: bool = True) -> DataFrame:
    """(key, template, p, t): each place where a text's k-gram is a template's, once for each distinct text."""
    at = positions(docs, text_col, _lower)
    for k in (PHRASE_K, NOTICE_K):
        at = at.withColumn(f"h{k}", F.xxhash64(*[F.get("words", F.col("pos") + i) for i in range(k)]))
    for k in (PHRASE_K, NOTICE_K):
        grams = _grams(table, k)
        at = at.join(F.broadcast(grams) if small else grams, f"h{k}", "left")
    none = F.array().cast("array<struct<template:bigint,t:int,gram:array<string>>>")
    hits = F.concat(*[F.coalesce(f"hits{k}", none) for k in (PHRASE_K, NOTICE_K)])
    at = at.where(" OR ".join(f"hits{k} IS NOT NULL" for k in (PHRASE_K, NOTICE_K))).select("key", "pos", "words", F.explode(hits).alias("hit"))
    same = F.slice("words", F.col("pos") + 1, F.size("hit.gram")) == F.col("hit.gram")
    return at.where(same).select("key", "hit.template", F.col("pos").alias("p"), "hit.t").distinct()


def count_votes(hits: DataFrame) -> DataFrame:
    """(key, template, diagonal, votes: sorted array of the template positions that voted)."""
    return hits.groupBy("key", "template", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.array_sort(F.collect_set("t")).alias("votes"))


def find_spans(votes: DataFrame, table: DataFrame, small: bool = True) -> DataFrame:
    """(key, template, label, is_base, first, last, share): base phrases as they stand, and verified spans of notices."""
    facts = table.select("template", "label", "is_base", "k", "size")
    votes = votes.join(F.broadcast(facts) if small else facts, "template")
    phrases = votes.where((F.col("is_base")) & (F.size("votes") == F.col("size") - F.col("k") + 1))
    phrases = phrases.select("key", "template", "label", "is_base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("share"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    rest = votes.where("NOT is_base").withColumn("apart", (F.col("diagonal") - F.lag("diagonal").over(order) > BAND).cast("int"))
    rest = rest.withColumn("span", F.sum(F.coalesce("apart", F.lit(0))).over(order))
    words = F.flatten(F.collect_list(F.flatten(F.transform("votes", lambda t: F.sequence(t, t + F.col("k") - 1)))))
    first, last = F.min(F.col("diagonal") + F.array_min("votes")), F.max(F.col("diagonal") + F.array_max("votes") + F.col("k") - 1)
    spans = rest.groupBy("key", "template", "label", "is_base", "size", "span").agg(first.alias("first"), last.alias("last"), F.size(F.array_distinct(words)).alias("covered"))
    spans = spans.select("key", "template", "label", "is_base", "first", "last", (F.col("covered") / F.col("size")).alias("share")).where(F.col("share") >= COVER)
    return phrases.unionByName(spans)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, n_words, spans (array of template, label, is_base, first, last, share)."""
    scratch = Scratch(docs.sparkSession, "licenses")
    table = scratch.keep(template_table(fixed_templates(docs.sparkSession) if templates is None else templates))
    small = (table.agg(F.sum("size")).first()[0] or 0) <= BROADCAST
    votes = scratch.keep(count_votes(find_hits(docs, table, text_col, small)))
    spans = scratch.keep(find_spans(votes, table, small))
    cols = ["template", "label", "is_base", "first", "last", "share"]
    by = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("spans"))
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), count_words(F.col(text_col)).alias("n_words"))
    return rows.join(by, "key", "left").select("id", "n_words", F.coalesce("spans", F.array().cast(by.schema["spans"].dataType)).alias("spans"))
