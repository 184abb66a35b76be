"""License scans by sparse TF-IDF cosine (operator 6), DataFrame functions only.

Words are runs of a-z, digits and dots between digits, in lower case.  Texts and templates are vectors over the templates'
words, weighed by term frequency times ln((1 + texts) / (1 + texts with the word)) + 1, counted over all texts; every
other word of a text is an axis of its own that weighs as a word of no text.  Compared with a template
are: a file's header (up to its first empty line); the whole file, where it has at most
``FILE`` (4) times the template's words; and, so that a notice counts whatever else stands around it and however it is
wrapped, the windows of the template's length that hold a word the template must share: of templates of up to 31
words all of them, of longer ones those that begin at a multiple of a sixteenth of their length, or where such a word has its place.
A unit whose cosine with a template is ``threshold`` (0.6) or more, and that shares a word with it which at
most half of the licenses have, names that template's license; a file's license is its best one's (ties: the least name).

The search leaves nothing out: a unit at the threshold shares words that hold threshold**2 of the template's
squared norm, and one of its heaviest words, without which the others' norm is below the threshold; texts
and windows without these are not scored.

A file that names none inherits from the nearest ancestor directory that has a license: that of
a license file in it.  A license file is named LICENSE, LICENCE or COPYING, or half of
its words or more are its notice; named files go before others, then the license that more files
name, then the least name.  Directories are
joined by path: each file's ancestors are listed and equi-joined with the
directories that have a license, and the longest wins.

Cosines are computed within a row, so no text or word is shuffled; texts are read twice, once to count. The driver sees one
count for each word of the templates, and the literal tables grow with the templates alone.

Cases.  Null and empty texts name no license.  A null path has no directory.  Repeated rows
give one row each.  Empty tables are fine.  Other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD, FILE = 0.6, 4
WORD = "[a-z0-9]+(?:\\.[0-9]+)*"

#: Templates: fixed values, short standard notices, headers, whole licence texts, titles and SPDX lines.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
SPDX = ["Apache-2.0", "MIT", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]
TEMPLATES += [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
        USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
        the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
]
LOWER = {k: k + 32 for k in range(65, 91)}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def telling(templates: list[tuple[str, list[str]]]) -> list[str]:
    """Words that at most half of the licenses have."""
    names = {name for name, _ in templates}
    of = Counter(w for name in names for w in {w for n, ws in templates if n == name for w in ws})
    return sorted(w for w, k in of.items() if 2 * k <= max(2, len(names)))


def weighed(templates: list[tuple[str, list[str]]], vocabulary: list[str], seen: dict[str, int], n: int, threshold: float) -> tuple[list[dict], list[float]]:
    """The templates as vectors over the vocabulary's numbers (from 1; 0 is any other word), and the words' idf."""
    idf = [math.log((1 + n) / (1 + seen.get(w, 0))) + 1 for w in ["", *vocabulary]]
    number, tells, out = {w: k + 1 for k, w in enumerate(vocabulary)}, set(telling(templates)), []
    for name, ws in templates:
        x = [0.0] * len(idf)
        for w in ws:
            x[number[w]] += idf[number[w]]
        order = sorted({number[w] for w in ws}, key=lambda k: (-x[k], k))
        square, rest, must = sum(v * v for v in x), sum(v * v for v in x), []
        while order and rest >= threshold**2 * square * (1 - 1e-9):
            must.append(order.pop(0))
            rest -= x[must[-1]] ** 2
        places = [{"w": number[w], "at": k} for k, w in enumerate(ws) if number[w] in must]
        out.append({"license": name, "n": len(ws), "x": x, "norm": math.sqrt(square), "must": must, "step": max(1, len(ws) // 16), "places": places, "tells": [w in tells for w in ["", *vocabulary]]})
    return out, idf


def cosine(unit: Column, template: Column, idf: Column) -> Column:
    """The cosine of an array of word numbers and a template; null if they share no telling word."""
    dot = F.aggregate(unit, F.lit(0.0), lambda s, w: s + F.get(idf, w) * F.get(template["x"], w))
    often = lambda w: F.size(F.filter(unit, lambda v: v == w))
    own = F.aggregate(F.array_distinct(F.filter(unit, lambda w: w > 0)), F.lit(0.0), lambda s, w: s + F.pow(often(w) * F.get(idf, w), F.lit(2.0)))
    other = F.size(F.filter(unit, lambda w: w == 0)) * F.pow(F.get(idf, F.lit(0)), F.lit(2.0))
    shares = F.exists(unit, lambda w: (F.get(template["x"], w) > 0) & F.get(template["tells"], w))
    return F.when(shares, dot / (F.sqrt(own + other) * template["norm"]))


def best(numbers: Column, distinct: Column, header: Column, template: Column, idf: Column, threshold: float) -> Column:
    """``(c, part)``: the greatest cosine of a text's units with a template, and the unit's share of the text."""
    enough = F.aggregate(distinct, F.lit(0.0), lambda s, w: s + F.pow(F.get(template["x"], w), F.lit(2.0))) >= F.pow(template["norm"] * threshold, F.lit(2.0)) * (1 - 1e-9)
    whose = lambda value: F.filter(F.transform(numbers, lambda w, k: F.when(F.array_contains(template["must"], w), value(w, k))), lambda k: k.isNotNull())
    over = lambda k: F.filter(F.sequence(F.greatest(k - template["n"] + 1, F.lit(0)), k), lambda s: s % template["step"] == 0)
    placed = lambda w, k: F.transform(F.filter(template["places"], lambda p: p["w"] == w), lambda p: F.greatest(k - p["at"], F.lit(0)))
    starts = F.array_distinct(F.flatten(whose(lambda w, k: F.concat(over(k), placed(w, k)))))
    scored = lambda unit: F.struct(cosine(unit, template, idf).alias("c"), (F.size(unit) / F.size(numbers)).alias("part"))
    units = F.transform(starts, lambda k: F.slice(numbers, k + 1, template["n"]))
    whole = F.filter(F.array(F.slice(numbers, F.lit(1), header), numbers), lambda u: (F.size(u) > 0) & (F.size(u) <= FILE * template["n"]))
    return F.when(enough, F.array_max(F.filter(F.transform(F.concat(units, whole), scored), lambda u: u["c"] >= threshold)))


def parent(path: Column) -> Column:
    """The directory of a path, with its slash; empty where there is none."""
    return F.regexp_extract(path, "^(.*/)[^/]*$", 1)


def ancestors(directory: Column) -> Column:
    """The directory and all above it."""
    names = F.split(directory, "/")
    ends = F.sequence(F.lit(1), F.greatest(F.size(names) - 1, F.lit(1)))
    return F.array_distinct(F.transform(ends, lambda k: F.concat(F.array_join(F.slice(names, F.lit(1), k), "/"), F.lit("/"))))


def scan(files: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``files``: id, path, license, cosine of its own notice, inherited_from (a directory)."""
    given = TEMPLATES if templates is None else [tuple(r) for r in templates.select("license", "text").collect()]
    known = [(name, ws) for name, text in given if (ws := re.findall(WORD, (text or "").translate(LOWER)))]
    vocabulary = sorted({w for _, ws in known for w in ws})
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    numbered, t = literal(vocabulary, "array<string>"), F.col("t")
    read = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    held = F.array_intersect(words(t), numbered)
    # one pass counts, and sends a count for each word of the templates; one scores
    counts = {r["w"]: r["count"] for r in read.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").count().collect()}
    n = counts.pop("", 0)  # every text has the empty word
    vectors, idf = weighed(known, vocabulary, counts, n, threshold)
    musts = literal(sorted({vocabulary[k - 1] for v in vectors for k in v["must"]}), "array<string>")
    kind = "array<struct<license:string,n:int,x:array<double>,norm:double,must:array<int>,step:int,places:array<struct<w:int,at:int>>,tells:array<boolean>>>"
    header = F.size(words(F.element_at(F.split(t, "\\n[ \\t\\r]*\\n", 2), 1)))
    numbers = F.transform(words(t), lambda w: F.array_position(numbered, w).cast("int"))
    one = lambda ns, few, size, x: lambda p: F.struct(best(ns, few, size, p, x, threshold).alias("b"), p["license"].alias("license"))
    scored = lambda ns: bound(F.array_distinct(ns), lambda few: bound(header, lambda size: bound(literal(idf, "array<double>"), lambda x: F.transform(literal(vectors, kind), one(ns, few, size, x)))))
    every = F.when(F.arrays_overlap(held, musts), F.filter(bound(numbers, scored), lambda m: m["b"].isNotNull()))
    rows = common.cut(read.select("id", "path", F.monotonically_increasing_id().alias("row"), every.alias("found")))
    found = rows.where(F.size("found") > 0).select("row", "path", "found")
    least = F.array_min(F.transform("found", lambda m: F.struct((-F.round(m["b"]["c"], 9)).alias("c"), m["license"].alias("license"), (-m["b"]["part"]).alias("part"))))
    own = common.cut(found.withColumn("b", least).select("row", "path", (-F.col("b.part")).alias("part"), F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine")))

    named = F.coalesce(F.upper(F.regexp_extract("path", "([^/]*)$", 1)).rlike("^(LICENSE|LICENCE|COPYING)"), F.lit(False))
    votes = own.withColumn("d", parent(F.col("path"))).where((F.col("d") != "") & (named | (F.col("part") >= 0.5))).groupBy("d", "license").agg(F.count("*").alias("n"), F.max(named).alias("file"))
    chosen = votes.groupBy("d").agg(F.min(F.struct((~F.col("file")).alias("f"), (-F.col("n")).alias("n"), "license")).alias("b")).select("d", F.col("b.license").alias("given"))

    slim = rows.select("id", "path", "row").withColumn("_d", parent(F.col("path")))
    dirs = slim.where("_d <> ''").select("_d").distinct()
    above = dirs.select("_d", F.explode(ancestors(F.col("_d"))).alias("d")).join(chosen, "d")
    nearest = above.groupBy("_d").agg(F.max(F.struct(F.length("d"), "d", "given")).alias("b")).select("_d", "b.d", "b.given")
    told = slim.join(own.select("row", "license", "cosine"), "row", "left").join(nearest, "_d", "left")
    return told.select(
        F.col("id").alias(id_col), "path", F.coalesce("license", "given").alias("license"), "cosine",
        F.when(F.col("license").isNull(), F.col("d")).alias("inherited_from"),
    )
