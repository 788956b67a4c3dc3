"""Licence scan by Dice coefficient over word bigrams (native).

Lines, and paragraphs of several lines, are normalised to lower-case words and
compared with licence templates: Dice = 2 * common / (own + template's) over
sets of word bigrams. A template is only compared where its number of bigrams
leaves that coefficient in reach, and a passage only where it has one of the
templates' bigrams at all.

What matches no template as a whole is searched for notices inside it: each
span of words of a template's size that begins with one of its bigrams is
compared in the same way, wherever lines and paragraphs end, with ``TEMPLATES``
and with ``NOTICES`` (usual wordings, standard headers, whole short licences).
Of spans that overlap the one with most bigrams in common counts, then the most
similar, so a longer licence isn't taken for a shorter one that it contains.

Templates are stated, bounded lists that are part of the plan.

Defined results: null and empty texts, and passages of one word, match
nothing; a passage takes its best template (of equal ones the first by name);
a span inside other text is given as its words;
rows that repeat a ``doc_id`` share their hits. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm._store import materialise, once

SIMILAR = 0.8
#: Notices by which licences are granted.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)


def _header(name: str, version: str) -> str:
    return f"you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: Further wordings by licence; looked for inside other text.
NOTICES = {
    "AGPL-3.0": [_header("GNU Affero General Public License", "3"), "licensed under the GNU Affero General Public License v3.0", "licensed under the AGPL-3.0 license"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "licensed under the Apache License 2.0",
        "licensed under the Apache 2.0 license",
        "released under the Apache License, Version 2.0",
    ],
    "BSD-2-Clause": [_BSD, "licensed under the BSD 2-Clause License"],
    "BSD-3-Clause": [_BSD + _BSD_3, "licensed under the BSD 3-Clause License"],
    "CC-BY-4.0": ["licensed under CC BY 4.0", "licensed under the Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "GPL-2.0": [_header("GNU General Public License", "2"), "licensed under the GNU General Public License v2.0", "licensed under the GPL-2.0 license"],
    "GPL-3.0": [_header("GNU General Public License", "3"), "licensed under the GNU General Public License v3.0", "licensed under the GPL-3.0 license"],
    "ISC": ["licensed under the ISC License"],
    "LGPL-2.1": [_header("GNU Lesser General Public License", "2.1")],
    "LGPL-3.0": [_header("GNU Lesser General Public License", "3")],
    "MIT": [_MIT, "licensed under the MIT License", "distributed under the MIT License", "available under the MIT License", "released under the MIT License"],
    "MPL-2.0": ["licensed under the Mozilla Public License 2.0", "licensed under the Mozilla Public License, Version 2.0"],
}
#: Words of any text; passages aren't looked for by these if others do.
COMMON = frozenset("a all and any are as be by can for general has have in is it of on or that the this to under with work".split())
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def keywords(listed: list[tuple[str, list[str]]], similar: float) -> list[str]:
    """Words one of which any matching passage has: a match shares at least
    similar / (2 - similar) of a template's bigrams, and fewer than that are
    free of these words."""
    chosen: list[str] = []
    for _, bigrams in listed:
        need = math.ceil(similar / (2 - similar) * len(bigrams))
        for word in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (w in COMMON, -len(w), w)):
            if sum(not any(w in chosen for w in b.split()) for b in bigrams) < need:
                break
            if word not in chosen:
                chosen.append(word)
    return chosen


def _having(rows: DataFrame, column: str, listed: list[str]) -> DataFrame:
    """Rows whose text has one of the words; it is folded once for all tests."""
    held = once(rows, __folded=F.lower(column))
    folded = F.col("__folded")
    tests = [folded.contains(w) for w in listed if len(w) > 3]
    if short := [w for w in listed if len(w) <= 3]:
        edge = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
        tests.append(folded.rlike(f"(?:^|{edge})(?:{'|'.join(short)})(?:{edge}|$)"))
    return held.where(functools.reduce(lambda a, b: a | b, tests)).drop("__folded")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def passages(text: Column) -> Column:
    """Lines, and paragraphs (set apart by blank lines) of several lines."""
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: p.contains("\n"))
    return F.concat(F.split(text, "\n"), paragraphs)


def _bigrams(w: str) -> Column:
    """Bigrams of an array of words, in order."""
    return F.expr(f"filter(transform({w}, (x, i) -> concat(x, ' ', get({w}, i + 1))), b -> b IS NOT NULL)")


def numbers(bigrams: list[str]) -> list[str]:
    """The words of a template that are numbers: its version, above all."""
    return sorted({w for b in bigrams for w in b.split(" ") if any(c.isdigit() for c in w)})


def _whole(some: DataFrame, listed: list[tuple[str, list[str]]], similar: float) -> DataFrame:
    """``row, doc_id, passage, license, dice`` of whole lines and paragraphs."""
    sizes = [len(b) for _, b in listed]
    low, high = min(sizes) * similar / (2 - similar), max(sizes) * (2 - similar) / similar
    cut = _having(some.select("row", "doc_id", F.explode(passages(F.col("text"))).alias("passage")), "passage", keywords(listed, similar))
    # words repeat, so a passage has up to as many bigrams as words less one
    cut = once(cut, w=words(F.col("passage"))).where(F.size("w") > low)
    every = sorted({b for _, bigrams in listed for b in bigrams})
    own = once(cut, bigrams=F.array_distinct(_bigrams("w"))).where(F.arrays_overlap("bigrams", F.array(*map(F.lit, every))) & F.size("bigrams").between(low, high))
    strings = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    choices = F.array(*[F.struct(F.lit(name).alias("license"), strings(bigrams).alias("b"), strings(numbers(bigrams)).alias("v")) for name, bigrams in listed])
    n = F.size("bigrams")
    reach = F.filter(choices, lambda t: (2.0 * F.least(n, F.size(t["b"])) >= similar * (n + F.size(t["b"]))) & (F.size(F.array_except(t["v"], F.col("w"))) == 0))
    scored = F.transform(reach, lambda t: F.struct((-2.0 * F.size(F.array_intersect("bigrams", t["b"])) / (n + F.size(t["b"]))).alias("minus"), t["license"].alias("license")))
    found = once(own, best=F.array_min(scored)).where(F.col("best.minus") <= -similar)
    return found.select("row", "doc_id", "passage", "best.license", (-F.col("best.minus")).alias("dice"))


def _inside(some: DataFrame, whole: DataFrame, listed: list[tuple[str, list[str], int]], similar: float) -> DataFrame:
    """``doc_id, passage, license, dice`` of spans in the text that is left
    once the lines and paragraphs that match as a whole are taken out. A
    template is given with its number of words."""
    gone = whole.groupBy("row").agg(F.collect_set("passage").alias("gone"))
    mark = "\uffff"  # a word of no template in place of what is taken out
    stays = lambda parts: F.transform(parts, lambda p: F.when(F.coalesce(F.array_contains("gone", p), F.lit(False)), mark).otherwise(p))
    left = some.join(gone, "row", "left")
    left = left.withColumn("text", F.array_join(stays(F.split("text", r"\n[ \t\r]*\n")), "\n\n"))
    left = left.withColumn("text", F.array_join(stays(F.split("text", "\n")), "\n"))
    left = materialise(left.select("row", "doc_id", words(F.col("text")).alias("w")), "left")
    rows = [(k, name, b, len(bigrams), n - 1, math.ceil(similar / (2 - similar) * len(bigrams))) for k, (name, bigrams, n) in enumerate(listed) for b in bigrams]
    known = some.sparkSession.createDataFrame(rows, "k int, license string, b string, own int, span int, need int")
    each = left.select("row", F.posexplode(_bigrams("w")).alias("at", "b")).join(F.broadcast(known), "b")  # a bounded list
    hits = each.groupBy("row", "k", "license", "own", "span", "need").agg(F.sort_array(F.collect_list("at")).alias("at")).where("size(at) >= need")
    # a span has at least the bigrams that a match needs
    starts = hits.withColumn("at", F.expr("filter(at, (p, i) -> get(at, i + need - 1) < p + span)")).where("size(at) > 0")
    digits = F.filter(F.flatten(F.transform("t", lambda b: F.split(b, " "))), lambda w: w.rlike("[0-9]"))
    templates = known.groupBy("k").agg(F.collect_list("b").alias("t")).withColumn("v", F.array_distinct(digits))
    begun = starts.join(F.broadcast(templates), "k").select("row", "license", "own", "span", "t", "v", F.explode("at").alias("at")).join(left, "row")
    spans = once(begun, words=F.expr("slice(w, at + 1, span + 1)"))
    spans = once(spans.drop("w"), g=F.array_distinct(_bigrams("words")))
    spans = once(spans, common=F.size(F.array_intersect("g", "t")))
    spans = once(spans, dice=2.0 * F.col("common") / (F.size("g") + F.col("own"))).where(F.col("dice") >= similar)
    # One licence's text in another version isn't that licence.
    spans = spans.where(F.size(F.array_except("v", "words")) == 0)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("common")).alias("fewer"), (-F.col("dice")).alias("minus"), (-F.col("span")).alias("short"), "license", "at", (F.col("at") + F.col("span")).alias("last"), F.array_join("words", " ").alias("passage"))))
    best = spans.groupBy("row", "doc_id").agg(ranked.alias("ranked"))
    chosen = F.expr("aggregate(ranked, slice(ranked, 1, 0), (acc, x) -> CASE WHEN exists(acc, y -> y.at <= x.last AND x.at <= y.last) THEN acc ELSE concat(acc, array(x)) END)")
    return best.select("doc_id", F.explode(chosen).alias("c")).select("doc_id", "c.passage", "c.license", (-F.col("c.minus")).alias("dice"))


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, similar: float = SIMILAR, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """``doc_id, passage, license, dice`` for each passage that matches."""
    listed = sorted((name, template_bigrams(text)) for name, text in templates.items())
    inner = [(name, text) for name, text in templates.items()] + [(name, text) for name, texts in notices.items() for text in texts]
    counted = [(name, template_bigrams(text), len("".join(c if c.isalnum() else " " for c in text).split())) for name, text in inner]
    pivots = keywords([(name, bigrams) for name, bigrams, _ in counted], similar)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    some = materialise(_having(rows, "text", pivots).withColumn("row", F.monotonically_increasing_id()), "licensed")
    whole = materialise(_whole(some, listed, similar), "whole")
    return whole.drop("row").unionByName(_inside(some, whole, counted, similar))
