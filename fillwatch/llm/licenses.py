"""Operator 5: licence scan with a positional index of rare licence words."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwatch.llm.common import ascii_lower, materialise

#: Fixed by the contract: label and the words that must stand consecutively.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: The method's own labels: the text that a notice is compared with, and the mandatory key phrase in it.
MORE = {
    "apache": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache license"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    "cc": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons"),
    "copyright": ("Copyright (c)", "copyright c"),
    "gnu": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "gnu general public license"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    "lesser-gpl": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license"),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "permission is hereby granted free of charge"),
    "mit-name": ("MIT License", "mit license"),
    "mozilla": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla public license"),
    "public-domain": ("This is free and unencumbered software released into the public domain", "public domain"),
    "spdx": ("SPDX-License-Identifier", "spdx license identifier"),
    "warranty": ("the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", "without warranty of any kind"),
}
#: Function words, which are indexed where a key phrase has them only.
COMMON = ["a", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "following", "for", "if", "in", "including", "is", "it", "may", "not", "of", "one", "or", "that", "the", "this", "to", "under", "use", "version", "was", "with", "you"]
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; null and empty texts have none."""
    return F.filter(F.split(ascii_lower(text), NOT_WORD), lambda w: w != "")


class Template(NamedTuple):
    """The words of a notice ("" where a word isn't indexed), where its key phrase starts, and how long that is."""

    words: list[str]
    key: int
    size: int


def template(text: str, phrase: str) -> Template:
    words, key = ([w for w in re.split(NOT_WORD, x.lower()) if w] for x in (text, phrase))
    at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    return Template([w if w not in COMMON or at <= i < at + len(key) else "" for i, w in enumerate(words)], at, len(key))


def templates(base: dict[str, str], more: dict[str, tuple[str, str]]) -> dict[str, Template]:
    return {k: template(v, v) for k, v in base.items()} | {k: template(*v) for k, v in more.items()}


def vocabulary_of(every: dict[str, Template]) -> list[str]:
    return sorted({w for t in every.values() for w in t.words} - {""})


def occurrences(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, hits): the positions of licence words in each text, in order. One narrow pass over the texts."""
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_array(F.col(text_col)).alias("words"))
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.cast("long").alias("p"), w.alias("w")))), lambda x: x.isNotNull())
    return words.select("doc_id", F.size("words").cast("long").alias("n_words"), at.alias("hits"))


def frequencies(hits: DataFrame) -> tuple[int, dict[str, int]]:
    """Documents in all, and documents that have each licence word (as many rows as the templates have words)."""
    seen = hits.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return hits.count(), {r.w: r.n for r in seen.collect()}


def alignments(t: Template, idf: dict[str, float]) -> Column:
    """Where a template may lie in a text: (place of its key phrase, whether that stands there, share of the template's weight that does).

    The rarest word of the key phrase is looked up in the text's positional index. Each of its places fixes the
    template's place; the postings of the template's other words are intersected by relative position. hits is in text
    order and holds each word once a place, so those that can agree are among as many hits as the template has words.
    """
    span = range(t.key, t.key + t.size)
    anchor = max(span, key=lambda j: (idf[t.words[j]], -j))
    words, weights = F.array(*map(F.lit, t.words)), F.array(*[F.lit(idf[w] if w else 0.0) for w in t.words])
    whole = sum(idf[w] for w in t.words if w)

    def place(x: Column, k: Column) -> Column:
        start = x["p"] - anchor
        near = F.slice("hits", F.greatest(k - anchor, F.lit(0)) + 1, len(t.words) + 1)
        agree = F.filter(F.transform(near, lambda h: F.when(F.get(words, (h["p"] - start).cast("int")) == h["w"], (h["p"] - start).cast("int"))), lambda o: o.isNotNull())
        key = F.size(F.filter(agree, lambda o: (o >= t.key) & (o < t.key + t.size))) == t.size
        share = F.aggregate(agree, F.lit(0.0), lambda a, o: a + F.get(weights, o)) / F.lit(whole)
        return F.when(x["w"] == t.words[anchor], F.struct((start + t.key).alias("p"), key.alias("key"), share.alias("share")))

    return F.filter(F.transform("hits", place), lambda x: x.isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, more: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    Inverse document frequencies of the licence words come from all texts; see alignments for the search. A label counts
    where its key phrase stands; base places are those of the base labels. score is the largest share of a template's
    IDF weight that stands at its relative positions (1: all of it), 0 where no key phrase's rarest word stands. Null and
    empty texts have no words, no labels and score 0. Null ids and repeated rows pass through; other columns are
    ignored; an empty table gives an empty result.
    """
    base, more = BASE if base is None else base, MORE if more is None else more
    every = templates(base, more)
    vocabulary = vocabulary_of(every)
    hits = materialise(occurrences(docs, vocabulary, id_col, text_col), "licence")
    total, df = frequencies(hits)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    found = hits.select("*", *[alignments(t, idf).alias(f"at_{i}") for i, t in enumerate(every.values())])
    at = {k: F.col(f"at_{i}") for i, k in enumerate(every)}
    there = {k: F.filter(c, lambda x: x["key"]) for k, c in at.items()}
    places = F.flatten(F.array(*[F.transform(there[k], lambda x: x["p"]) for k in base])) if base else F.array().cast("array<long>")
    label = lambda keys: F.array_join(F.filter(F.array(*[F.when(F.size(there[k]) > 0, F.lit(k)) for k in sorted(keys)]), lambda x: x.isNotNull()), ",") if keys else F.lit("")
    score = F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(F.array_max(F.transform(c, lambda x: x["share"])), F.lit(0.0)) for c in at.values()])
    out = found.withColumn("base", places)
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").alias("first_word"), F.array_max("base").alias("last_word"),
        label(base).alias("base_labels"), label(every).alias("labels"), F.least(F.lit(1.0), F.round(score, 6)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    every = templates(BASE, MORE)
    cols, label_of = [], {}
    for i, (k, t) in enumerate(every.items()):
        key = t.words[t.key : t.key + t.size]
        rarity = "[" + ", ".join(f"idf['{w}']" for w in key) + "]"
        first = f"list_position({rarity}, list_max({rarity}))"  # of the key phrase's rarest word, from 1
        share = f"list_sum(list_transform(range(1, {len(t.words) + 1}), lambda j: CASE WHEN i - {t.key} - {first} + j >= 1 AND w[i - {t.key} - {first} + j] = {t.words!r}[j] THEN idf[w[i - {t.key} - {first} + j]] ELSE 0.0 END))"
        whole = " + ".join(f"idf['{w}']" for w in t.words if w)
        cols.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] = {key!r}[{first}]), lambda i: {{'p': i - {first}, 'key': list_slice(w, i - {first} + 1, i - {first} + {t.size}) = {key!r}, 'share': {share} / ({whole})}}) AS at_{i}")
        label_of[k] = f"len(list_filter(at_{i}, lambda x: x.key))"
    label = lambda keys: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {label_of[k]} > 0 THEN '{k}' END" for k in sorted(keys)) + "], lambda x: x IS NOT NULL), ',')"
    b = "list_concat(list_concat({}, {}), {})".format(*[f"list_transform(list_filter(at_{i}, lambda x: x.key), lambda x: x.p)" for i in range(len(BASE))])
    best = ", ".join(f"coalesce(list_max(list_transform(at_{i}, lambda x: x.share)), 0.0::DOUBLE)" for i in range(len(every)))
    return rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT unnest({vocabulary_of(every)!r}) AS x), c AS (SELECT count(*) AS total FROM t),
f AS (SELECT x, (SELECT count(*) FROM t WHERE list_contains(w, x)) AS n FROM v),
i AS (SELECT map_from_entries(list({{'k': x, 'v': ln((1 + total) / (1 + n)) + 1}})) AS idf FROM f, c),
s AS (SELECT doc_id, w, {", ".join(cols)} FROM t, i), o AS (SELECT *, {b} AS places FROM s)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
 {label(BASE)} AS base_labels, {label(every)} AS labels, least(1.0::DOUBLE, round(greatest({best}), 6)) AS score FROM o
"""


ORACLE = _oracle()
