"""License scans: exact set-similarity (containment) join of text blocks with templates.

Templates are paragraphs of public licenses and their usual notices.  A text
block is any run of ``stretch`` times as many consecutive words as the template
has, wherever lines and comment signs break it; it meets the template when it has
at least ``threshold`` of the template's distinct words.  Template words are
ordered by how many documents of the corpus have them, rarest first.  A block
that meets a template of ``s`` words has ``need = ceil(threshold * s)`` of them,
hence at least one of the ``s - need + 1`` rarest, the template's prefix; take
the rarest that it has, at place ``p`` of the order.  So

* words outside all prefixes start no comparison (prefix filter); most texts have none;
* the block lies in a core around that word: at most a block's length to each
  side, and up to the next word that is rarer still;
* a core with fewer than ``need`` template words is left (length filter), and so
  is a place with fewer than ``need`` words from it on (positional filter);
* the blocks of the cores that stay are compared exactly.

Besides, places where a known phrase's words stand consecutively give base
labels.  All is built-in DataFrame expressions, in the document's own row: the
only shuffle is that of the word counts, as many rows as there are template words.

Defined results: null text is empty (no words, no labels, score 0); empty
``labels`` are the empty string; repeated rows each get their own result; an
empty table gives an empty one.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES: dict[str, str] = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Paragraphs and notices of public licenses, by label.
TEMPLATES: Sequence[tuple[str, str]] = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution."),
)


def template_words(text: str) -> list[str]:
    """The words of a template, by the same rule as :func:`words`."""
    return [w for w in re.split(SEPARATOR, text.translate(str.maketrans(UPPER, LOWER))) if w]


def words(text: Column) -> Column:
    """A-Z lower-cased, split at ASCII other than letters and digits."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATOR), "")


def constant(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_frequencies(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """Documents of the whole table that have each vocabulary word; as many rows as the vocabulary."""
    present = docs.select(F.explode(F.array_intersect(words(F.col(text_col)), constant(vocabulary))).alias("w"))
    counted = {r["w"]: r["n"] for r in present.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def _stands_at(tokens: Column, parts: list[str]) -> Callable[[Column], Column]:
    def fits(i: Column) -> Column:
        return functools.reduce(lambda a, b: a & b, [F.get(tokens, i + j) == F.lit(part) for j, part in enumerate(parts)])

    return fits


def phrase_places(tokens: Column, phrases: Mapping[str, str]) -> tuple[Column, dict[str, Column]]:
    """Start positions of all phrases, as one array, and whether each label's phrases occur."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    has = {p: joined.contains(f" {p} ") for p in phrases}
    places = F.array().cast("array<int>")
    for phrase, here in has.items():
        parts = phrase.split(" ")
        starts = F.sequence(F.lit(0), F.size(tokens) - len(parts))
        fits = F.filter(starts, _stands_at(tokens, parts))
        places = F.concat(places, F.when(here, fits).otherwise(F.array().cast("array<int>")))
    by_label = {}
    for phrase, label in phrases.items():
        by_label[label] = by_label[label] | has[phrase] if label in by_label else has[phrase]
    return places, by_label


class TemplateIndex:
    """Templates in global frequency order with their prefixes and the length of their blocks."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float, frequencies: Mapping[str, int], stretch: float = 1.5):
        self.rows = []
        for label, text in templates:
            parts = template_words(text)
            ordered = sorted(set(parts), key=lambda w: (frequencies.get(w, 0), w))
            if ordered:
                need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
                self.rows.append({"label": label, "ordered": ordered, "need": need, "width": math.ceil(stretch * len(parts) - 1e-9)})

    def prefixes(self) -> list[dict]:
        """Every (word, template, place in its order) from which on the template has enough words."""
        return [{"w": w, "t": t, "p": p} for t, row in enumerate(self.rows) for p, w in enumerate(row["ordered"]) if len(row["ordered"]) - p >= row["need"]]


def _constant_table(rows: Sequence[dict], kind: str) -> Column:
    quoted = json.dumps(rows).replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"from_json('{quoted}', 'array<struct<{kind}>>')")  # folded to a literal


def template_matches(tokens: Column, index: TemplateIndex) -> Column:
    """array<struct<template, label, containment>>: the blocks of a text that meet a template, the best of each core.

    The templates and their prefixes are constants that do not grow with the data.
    """
    if not index.rows:
        return F.array().cast("array<struct<template:int,label:string,containment:double>>")
    starts = index.prefixes()
    prefix_table = _constant_table(starts, "w:string,t:int,p:int")
    template_table = _constant_table(index.rows, "label:string,ordered:array<string>,need:int,width:int")
    anchors = F.filter(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda a: a["w"].isin(sorted({x["w"] for x in starts})))
    met = lambda a: F.transform(F.filter(prefix_table, lambda x: x["w"] == a["w"]), lambda x: F.struct(a["at"].alias("at"), x["t"].alias("t"), x["p"].alias("p"), F.get(template_table, x["t"]).alias("row")))
    places = F.flatten(F.transform(anchors, met))

    def core(x: Column) -> Column:
        """The words around the place up to the next rarer ones, and its own place among them."""
        rarer, reach = F.slice(x["row"]["ordered"], F.lit(1), x["p"]), x["row"]["width"] - 1
        before = F.slice(tokens, F.greatest(x["at"] - reach, F.lit(0)) + 1, F.least(reach, x["at"]))
        after = F.slice(tokens, x["at"] + 2, reach)
        bar = F.coalesce(F.array_max(F.transform(before, lambda w, i: F.when(F.array_contains(rarer, w), i + 1))), F.lit(0))
        end = F.coalesce(F.array_min(F.transform(after, lambda w, i: F.when(F.array_contains(rarer, w), i))), F.size(after))
        left = F.slice(before, bar + 1, F.size(before))
        return F.struct(x["t"].alias("t"), x["row"].alias("row"), F.size(left).alias("at"), F.concat(left, F.slice(tokens, x["at"] + 1, F.lit(1)), F.slice(after, F.lit(1), end)).alias("words"))

    cores = F.filter(F.transform(places, core), lambda c: F.size(F.array_intersect(c["words"], c["row"]["ordered"])) >= c["row"]["need"])

    def best(c: Column) -> Column:
        """The most of a template's words in one block that has the place: blocks start at template words."""
        begins = F.filter(F.sequence(F.lit(0), c["at"]), lambda i: (c["at"] - i < c["row"]["width"]) & F.array_contains(c["row"]["ordered"], F.get(c["words"], i)))
        return F.array_max(F.transform(begins, lambda i: F.size(F.array_intersect(F.slice(c["words"], i + 1, c["row"]["width"]), c["row"]["ordered"]))))

    found = F.transform(cores, lambda c: F.struct(c["t"].alias("template"), c["row"]["label"].alias("label"), F.size(c["row"]["ordered"]).alias("s"), c["row"]["need"].alias("need"), best(c).alias("common")))
    return F.transform(F.filter(found, lambda m: m["common"] >= m["need"]), lambda m: F.struct(m["template"].alias("template"), m["label"].alias("label"), (m["common"] / m["s"]).alias("containment")))


def scan_licenses(docs: DataFrame, *, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, stretch: float = 1.5) -> DataFrame:
    """License labels of every document of (doc_id, text)."""
    vocabulary = sorted({w for _, text in templates for w in template_words(text)})
    index = TemplateIndex(templates, threshold, word_frequencies(docs, vocabulary), stretch)
    rows = docs.select("doc_id", words(F.col("text")).alias("_t"))
    places, by_label = phrase_places(F.col("_t"), phrases)
    base = F.array_compact(F.array(*[F.when(here, F.lit(label)) for label, here in by_label.items()]))
    rows = rows.select("doc_id", F.size("_t").cast("long").alias("n_words"), places.alias("_at"), base.alias("_base"), template_matches(F.col("_t"), index).alias("_met"))
    labels = F.array_union("_base", F.transform("_met", lambda m: m["label"]))
    score = F.coalesce(F.array_max(F.transform("_met", lambda m: m["containment"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("_at").cast("long").alias("n_base"), F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct("_base")), ",").alias("base_labels"), F.array_join(F.sort_array(F.array_distinct(labels)), ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(score).alias("score"),
    )
