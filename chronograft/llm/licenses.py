"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Each run of one to ``LINES`` neighbouring lines of a text is a possible header, so that wrapped notices are met whole,
and the whole of a licence file is one unit more. A unit is compared with every template by the cosine of their
TF-IDF vectors. Document frequencies of all words, the templates' and others, are counted over all documents, so that
a unit's score hangs on what its words are worth and not on the size of the corpus.

Only units that can reach the threshold are scored: template words are ordered by document frequency, and of
each template the commonest words that together stay below the threshold can't carry a match alone. A
unit has to hold one of the others (``anchors``). This is exact, not a heuristic.

A licence file is a file of that name, or one that holds a unit with half of its words or more. A file
without a licence of its own takes that of the nearest directory above it with a licence file, by
joining each directory of its path; the root, which every path has, is one row and met by broadcast.

Defined cases: null or empty text has no licence of its own; a null path has no directory and inherits
nothing; of equal scores the first licence by name wins; of several licence files of a directory the
best-scoring, then first by path; repeated rows are scanned each; texts of any length are read whole, their windows
where a line holds an anchor; an empty table gives none. Only the three named columns are read, so others may
have any names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronograft.llm.text import LOWER, UPPER
from chronograft.storage import keep

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by "
    "the Free Software Foundation, either version {1} of the License, or any later version."
)
#: Customary notices and, where they are short, texts of well-known public licences.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _GNU.format("Affero", 3), "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD, "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
                     "Licensed under the BSD 3-Clause License.", _BSD + _BSD3, "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _GNU.format("", 2), "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format("", 3), "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", _GNU.format("Lesser", "2.1"), "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("Lesser", 3), "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            _MIT, _MIT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
            "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}

THRESHOLD = 0.7
#: Lines of the longest window.
LINES = 6
FILE_NAME = r"(?i)^(un)?licen[cs]e|^copying|^notice"
_GAP = r"[^a-z0-9]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _GAP, -1), lambda w: w != "")


def template_words() -> list[tuple[str, int, dict[str, int]]]:
    """(licence, number, word counts) of each template."""
    out = []
    for name, notices in TEMPLATES.items():
        for i, notice in enumerate(notices):
            words = [w for w in re.split(_GAP, notice.lower()) if w]
            out.append((name, i, {w: words.count(w) for w in set(words)}))
    return out


def weights(n_docs: int, frequency: dict[str, int]) -> dict[str, float]:
    """Inverse document frequency of each template word."""
    return {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) + 1.0 for _, _, t in template_words() for w in t}


def anchors(idf: dict[str, float], threshold: float = THRESHOLD) -> list[str]:
    """Words of which a unit has to hold one if it is to reach the threshold with any template."""
    heavy = set()
    for _, _, t in template_words():
        vector = sorted((idf[w], w, (c * idf[w]) ** 2) for w, c in t.items())
        limit, light = threshold**2 * sum(x for _, _, x in vector), 0.0
        for _, w, x in vector:
            light += x
            if light >= limit * (1 - 1e-9):
                heavy.add(w)
    return sorted(heavy)


def _scored(units: DataFrame, idf: dict[str, float], frequency: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    """(rid, unit, n_words, licence, score) of the units (rid, unit, words) that reach the threshold."""
    spark = units.sparkSession
    rows = []
    for name, number, t in template_words():
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in t.items()))
        rows += [(name, number, w, c * idf[w] / norm) for w, c in sorted(t.items())]
    template = spark.createDataFrame(rows, "licence string, number int, word string, weight double")
    tf = units.select("rid", "unit", F.size("words").alias("n_words"), F.explode("words").alias("word"))
    tf = tf.groupBy("rid", "unit", "n_words", "word").agg(F.count("*").alias("tf"))
    worth = frequency.select("word", (F.log((1 + F.lit(n_docs)) / (1 + F.col("n"))) + 1).alias("idf"))
    v = tf.join(worth, "word").withColumn("x", F.col("tf") * F.col("idf"))
    norm = v.groupBy("rid", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    # the templates are constants of this module, under two thousand rows
    dot = v.join(F.broadcast(template), "word").groupBy("rid", "unit", "n_words", "licence", "number").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dot.join(norm, ["rid", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    best = scored.where(F.col("score") >= threshold).groupBy("rid", "unit", "n_words").agg(
        F.max(F.col("score")).alias("score"), F.min_by("licence", F.struct(-F.col("score"), F.col("licence"))).alias("licence"))
    return best


def _windows(lines: Column, anchor: Column) -> Column:
    """(unit, text) of every run of up to LINES lines that holds a line with an anchor."""
    at = F.filter(F.transform(lines, lambda x, i: F.when(anchor(x), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(
        F.sequence(F.greatest(i - (LINES - 1), F.lit(0)), i), lambda s: F.struct(s.alias("s"), (i - s + 1).alias("least"))))))
    runs = F.array_distinct(F.flatten(F.transform(starts, lambda x: F.transform(F.sequence(x["least"], F.lit(LINES)), lambda n: F.struct(x["s"].alias("s"), n.alias("n"))))))
    whole = F.filter(runs, lambda x: x["s"] + x["n"] <= F.size(lines))
    return F.transform(whole, lambda x: F.struct((x["s"] * LINES + x["n"] - 1).alias("unit"), F.array_join(F.slice(lines, x["s"] + 1, x["n"]), " ").alias("text")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, own_licence, own_score, licence, inherited_from) of each input row."""
    text = F.col(f"`{text_col}`").cast("string")
    held = docs.select(F.explode(F.array_distinct(_words(text))).alias("word"))
    # counted by map-side partials, a row a word
    frequency = keep(held.groupBy("word").agg(F.count("*").alias("n")), "words")
    vocabulary = sorted({w for _, _, t in template_words() for w in t})
    known = {r[0]: r[1] for r in frequency.where(F.col("word").isin(vocabulary)).collect()}  # as many rows as the templates have words
    n_docs = docs.count()
    idf = weights(n_docs, known)
    heavy = anchors(idf, threshold)
    pattern = r"(?<![a-z0-9])(?:" + "|".join(heavy) + r")(?![a-z0-9])"

    base = F.element_at(F.split(F.col(f"`{path_col}`"), "/"), -1)
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{path_col}`").cast("string").alias("path"),
        F.coalesce(base.rlike(FILE_NAME), F.lit(False)).alias("named"), F.size(_words(text)).alias("n_all"),
        _windows(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.translate(x, UPPER, LOWER).rlike(pattern)).alias("windows"),
        F.when(base.rlike(FILE_NAME), text).alias("file"))
    # what may be a notice, and no more of the text
    rows = keep(rows, "notices")
    lines = rows.where(F.size("windows") > 0).select("rid", F.explode("windows").alias("w")).select("rid", "w.unit", _words(F.col("w.text")).alias("words"))
    files = rows.where("file is not null").select("rid", F.lit(-1).alias("unit"), _words(F.col("file")).alias("words"))
    found = _scored(lines.union(files.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in heavy])))), idf, frequency, n_docs, threshold)
    own = found.groupBy("rid").agg(
        F.max("score").alias("own_score"), F.min_by("licence", F.struct(-F.col("score"), F.col("licence"))).alias("own_licence"),
        F.max(F.when(F.col("unit") >= 0, F.col("n_words")).otherwise(0)).alias("n_notice"))
    each = keep(rows.select("rid", "id", "path", "named", "n_all").join(own, "rid", "left"), "licences")

    folder = F.regexp_replace("path", "/?[^/]*$", "")
    is_file = F.col("own_licence").isNotNull() & (F.col("named") | (2 * F.col("n_notice") >= F.col("n_all")))
    dirs = each.where(is_file & F.col("path").isNotNull()).groupBy(folder.alias("dir")).agg(
        F.min_by("own_licence", F.struct(-F.col("own_score"), F.col("path"), F.col("own_licence"))).alias("dir_licence"))
    up = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(up)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(up, 1, i), "/").alias("dir")))
    wants = each.where(F.col("own_licence").isNull() & F.col("path").isNotNull())
    # paths are shared by many files: a directory's answer is found once, then joined to its files
    asked = wants.select(folder.alias("folder"), above.alias("above")).distinct().select("folder", F.explode("above").alias("a")).select("folder", "a.depth", "a.dir")
    dirs = keep(dirs, "licence-dirs")
    below = asked.where("depth > 0").join(dirs, "dir")
    root = asked.where("depth = 0").join(F.broadcast(dirs.where("dir = ''")), "dir")
    nearest = below.unionByName(root).groupBy(F.col("folder").alias("at")).agg(F.max_by(F.struct("dir", "dir_licence"), "depth").alias("got"))
    # written, so that its size is known before rows are dealt by directory to meet it
    nearest = keep(nearest, "nearest")
    out = each.withColumn("folder", F.when(F.col("own_licence").isNull(), folder)).join(nearest, F.col("folder") == F.col("at"), "left")
    return out.select(
        F.col("id").alias(id_col), "path", "own_licence", "own_score",
        F.coalesce("own_licence", F.col("got.dir_licence")).alias("licence"), F.col("got.dir").alias("inherited_from"))
