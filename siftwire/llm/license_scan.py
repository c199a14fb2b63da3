"""License scans: phrases of licences, and an exact set-similarity join of text blocks with licence templates.

Base labels come from phrases whose words stand consecutively. The method adds the labels of all templates
that a text block contains to at least a given share of the template's distinct tokens. Blocks are the lines
of a text and the paragraphs (lines up to an empty one). The join is exact: the tokens of the templates have
one global order, rare in the corpus first, and so have the tokens that a block shares with any template. A block
that holds enough of a template's tokens must have enough tokens (length filter), must hold one of the template's first
``size - needed + 1`` tokens (prefix filter), and from the first shared token on, enough tokens must remain on both
sides, in the template and in the block (positional filter). What passes is verified by counting the common tokens.

Every block and template that meet the threshold count. Some templates hold all tokens of another label's, so
that the wider notice meets both and gets both labels.

Only DataFrame functions are used. Templates are a fixed list given by the caller, so the index of their
prefixes has a known size and is broadcast; texts are never shuffled, only the labels that were found.

Defined results: a null text counts as empty; a text without words has no labels and null places; A-Z are
lower-cased, no other letter; equal rows get equal results, and ids may be null or repeat. Existing columns
of the output names are replaced, all others pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words: ASCII digits, lower-case ASCII letters and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters for Spark, named one by one: Java matches them many times faster than what a negated class leaves.
SPARK_WORD = r"[0-9a-z\x80-\x{10FFFF}]+"

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Short notices in the usual wording of each licence, by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
}
INDEX = "token string, label string, template array<string>, needed int, left int"
_OUTPUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def ascii_lower(text: Column) -> Column:
    """Lower case in which no other character becomes an ASCII letter or changes the number of words.

    The two letters whose lower case holds an ASCII letter, the Kelvin sign and the dotted capital I, are
    read as another letter beyond ASCII first.
    """
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")), F.lit("İ"), F.lit("Å")))


def words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(SPARK_WORD), F.lit(0))


def _tokens(text: str) -> list[str]:
    return sorted(set(re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))))


def template_index(docs: DataFrame, templates: Mapping[str, list[str]], containment: float) -> tuple[list[str], list[tuple]]:
    """All tokens of the templates in order, and a row for each template and prefix token: token, label, tokens, needed, left.

    The order of tokens is that of their number of occurrences in the whole corpus; only the templates'
    own tokens are counted, so what comes back has a fixed size. ``left`` is the number of template tokens
    from this one on.
    """
    spark = docs.sparkSession
    sets = [(label, _tokens(text)) for label, texts in sorted(templates.items()) for text in texts]
    vocabulary = sorted({t for _, tokens in sets for t in tokens})
    asked = F.broadcast(spark.createDataFrame([(t,) for t in vocabulary], "token string"))
    worded = docs.select(words(ascii_lower(F.col("text"))).alias("words"))
    count = {r["token"]: r["count"] for r in worded.select(F.explode_outer("words").alias("token")).join(asked, "token").groupBy("token").count().collect()}
    order = sorted(vocabulary, key=lambda t: (count.get(t, 0), t))
    rows = []
    for label, tokens in sets:
        ordered = [t for t in order if t in tokens]
        needed = max(1, math.ceil(containment * len(ordered) - 1e-9))
        rows += [(t, label, ordered, needed, len(ordered) - i) for i, t in enumerate(ordered[: len(ordered) - needed + 1])]
    return order, rows


def _phrase_places(word: Column, phrases: Mapping[str, str]) -> Column:
    """(at, label) of every place where a phrase's words stand consecutively."""
    parts = [(p.split(), label) for p, label in phrases.items()]

    def hits(i: Column) -> Column:
        found = [
            F.when(_all([F.get(word, i + k) == w for k, w in enumerate(p)]), F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))
            for p, label in parts
        ]
        return F.array_compact(F.array(*found))

    some = None
    for p, _ in parts:
        has = F.array_contains(word, p[-1])
        some = has if some is None else some | has
    empty = F.array().cast("array<struct<at:bigint,label:string>>")
    firsts = F.array(*(F.lit(x) for x in sorted({p[0] for p, _ in parts})))
    starts = F.filter(F.sequence(F.lit(0), F.size(word) - 1), lambda i: F.array_contains(firsts, F.get(word, i)))
    return F.when(some, F.flatten(F.transform(starts, hits))).otherwise(empty)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def template_candidates(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, containment: float = 0.95, positional: bool = True) -> DataFrame:
    """(text_key, tokens, label, template, needed): blocks and templates that no filter rules out.

    ``tokens`` are those that the block shares with any template, in the global order.
    """
    order, rows = template_index(docs, templates, containment)
    index = docs.sparkSession.createDataFrame(rows, INDEX)
    lowered = docs.select(ascii_lower(F.col("text")).alias("text"))
    # Lines, and paragraphs of more than one line.
    paragraphs = F.filter(F.split("text", r"\n[\x20\x09-\x0D]*\n"), lambda x: F.contains(x, F.lit("\n")))
    blocks = lowered.select(text_key("text").alias("text_key"), F.explode_outer(F.concat(F.split("text", "\n"), paragraphs)).alias("block"))
    tokens = blocks.select("text_key", F.array_distinct(words(F.col("block"))).alias("tokens"))
    met = tokens.select("text_key", "tokens", F.explode_outer("tokens").alias("token")).join(F.broadcast(index), "token").where(F.size("tokens") >= F.col("needed"))
    # Few rows are left here. The intersection stands in the order of its first list.
    met = met.withColumn("tokens", F.array_intersect(F.array(*map(F.lit, order)), "tokens"))
    if positional:
        # The token may not be the first shared one, but for the first one this holds.
        met = met.where(F.least(F.col("left").cast("long"), F.size("tokens") - F.array_position("tokens", F.col("token")) + 1) >= F.col("needed"))
    return met.select("text_key", "tokens", "label", "template", "needed")


def template_labels(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, containment: float = 0.95) -> DataFrame:
    """(text_key, label, score): the templates found in each distinct text, by the text's 128-bit key.

    ``score`` is the largest share of the label's template tokens that one block holds.
    """
    common = F.size(F.array_intersect("tokens", "template"))
    passed = template_candidates(docs, templates, containment).where(common >= F.col("needed"))
    return passed.groupBy("text_key", "label").agg(F.max(common / F.size("template")).alias("score"))


def text_key(lowered: Column | str) -> Column:
    return F.md5(lowered)


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, list[str]] = TEMPLATES, containment: float = 0.95) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    ``score`` is 1 where a base phrase was found, else the largest containment of a template, else 0.
    """
    keep = [c for c in docs.columns if c not in _OUTPUT]
    found = template_labels(docs, templates, containment).groupBy("text_key").agg(F.sort_array(F.collect_set("label")).alias("more"), F.max("score").alias("share"))
    worded = docs.select(*keep, ascii_lower(F.col("text")).alias("__lowered")).withColumn("__words", words(F.col("__lowered")))
    placed = worded.select(*keep, text_key("__lowered").alias("__key"), F.size("__words").cast("long").alias("n_words"), _phrase_places(F.col("__words"), phrases).alias("__places"))
    joined = placed.join(found, placed["__key"] == found["text_key"], "left")
    base = F.array_distinct(F.transform("__places", lambda x: x["label"]))
    return joined.select(
        *keep,
        "n_words",
        F.size("__places").cast("long").alias("n_base"),
        F.array_min(F.transform("__places", lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform("__places", lambda x: x["at"])).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("__places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
