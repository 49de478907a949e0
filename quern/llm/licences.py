"""Licence scans in DataFrame functions only.

Every line and sentence of a whole text that names a licence is a candidate for
notices and SPDX identifiers; its blocks, the comment at its top and the whole
text, of any length, are candidates for standard headers and licence texts, each
kind with weights of its own. Candidates and templates are sparse TF-IDF
vectors: term counts times  ln((1 + N) / (1 + df)) + 1  with df counted over the
N templates, words outside them weighing as with df 0. A file has the licence of
the template of the highest cosine of any candidate, if that is at least a
threshold; among equals the first by name.

A file without a licence of its own inherits that of its nearest ancestor
directory: directories get the licence of the licence files in them (named
LICENSE, LICENCE, COPYING or UNLICENSE), the most frequent one, first by name
among equals. Where paths have no names, a file stands as a licence file if its
whole text is as near to a template, whatever its length. Directories are first reduced to distinct ones; these are joined
by the paths of their ancestors, and the files with the directories, so a
directory of a third of all files is one row until the last join, which
adaptive execution splits.

Nulls are empty texts without a licence. A file of null path inherits nothing.
Repeated rows are judged and returned each, and count each among the files of a
directory; an empty table gives an empty one. Time grows with a text's length.
Templates are a parameter and go to the workers as literals; at most
``MAX_CELLS`` numbers (templates times their words), more are refused.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import _io

THRESHOLD = 0.6
#: Least cosine of headers and texts, which are long and alike in their legal words.
LONG_THRESHOLD = 0.75
MAX_CELLS = 1 << 22

# Notices by which licences are declared.
TEMPLATES = {
    "AGPL-3.0": "This program is free software under the terms of the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Use of this source code is governed by a BSD style license, the BSD 2-Clause Simplified License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD style license, the BSD 3-Clause New or Revised License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, the Creative Commons Attribution ShareAlike 4.0 License.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "Elastic-2.0": "Licensed under the Elastic License 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain, the Unlicense.",
}

_FOLDER = Path(__file__).parent / "licence_texts"
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."

# Identifiers, the standard headers, and the texts of licences (in licence_texts where they are long).
IDENTIFIERS = {n: [f"SPDX-License-Identifier: {n}"] + [f"SPDX-License-Identifier: {n}-{x}" for x in ("only", "or-later") if "GPL" in n] for n in TEMPLATES}
HEADERS = {
    "AGPL-3.0": _GNU.format("Affero General Public License", 3),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0": _GNU.format("General Public License", 2),
    "GPL-3.0": _GNU.format("General Public License", 3),
    "LGPL-3.0": _GNU.format("Lesser General Public License", 3),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
# The titles that stand over the texts, and the clause that texts of one family begin with.
TITLES = {
    "AGPL-3.0": "GNU Affero General Public License Version 3, 19 November 2007",
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "Elastic-2.0": "Elastic License 2.0",
    "GPL-2.0": "GNU General Public License Version 2, June 1991",
    "GPL-3.0": "GNU General Public License Version 3, 29 June 2007",
    "ISC": "ISC License",
    "LGPL-3.0": "GNU Lesser General Public License Version 3, 29 June 2007",
    "MIT": "MIT License",
    "MPL-2.0": "Mozilla Public License Version 2.0",
}
# a header's paragraphs may be apart: the one that names the licence is a template too
HEADERS = {n: [t] + ([t.split(" This program is distributed")[0]] if "This program" in t else [t.split(" Unless required")[0]] if "Unless" in t else []) for n, t in HEADERS.items()}
for _name, _title in TITLES.items():
    HEADERS[_name] = [*HEADERS.get(_name, []), _title]
HEADERS["BSD-2-Clause"].append(_BSD)
TEXTS = {f.stem: [f.read_text()] for f in sorted(_FOLDER.glob("*.txt"))} | {
    "BSD-2-Clause": [_BSD + _AS_IS],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org"],
}
TEXTS["BSD-3-Clause"].append(_BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS)
# the Affero text differs by its name and one section
TEXTS["AGPL-3.0"] = [re.sub("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", re.sub("GNU General Public License", "GNU Affero General Public License", TEXTS["GPL-3.0"][0]))]

#: What a candidate names, lower-cased.
TRIGGERS = ("license", "licence", "copyright", "spdx", "public domain", "creative commons")
#: Where a text is cut into lines and sentences.
CUT = r"\n|(?<=[.!?;])\s+"
#: Where it is cut into blocks, and lines that a header at its top is made of.
BLOCK = r"\n[ \t\r]*\n|\*/"
COMMENT = r"^\s*(#|//|/?\*|--|;|%|<!--|$)"
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying)([.-][^/]*)?$"


Templates = list[tuple[str, str]]


def entries(templates: dict[str, str | list[str]]) -> Templates:
    """(name, text) of every template by name."""
    return [(n, t) for n in sorted(templates) for t in ([templates[n]] if isinstance(templates[n], str) else templates[n])]


def _weights(templates: Templates) -> tuple[list[str], dict[str, list[float]], float, dict[str, float]]:
    """(names, unit weights of the templates by word, weight of other words, weight of words)."""
    names = [n for n, _ in templates]
    counts = [Counter(re.findall(WORD, t.lower())) for _, t in templates]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + len(names)) / (1 + n)) + 1 for w, n in df.items()}
    norms = [math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items())) or 1.0 for c in counts]
    return names, {w: [c[w] * idf[w] / n for c, n in zip(counts, norms, strict=True)] for w in sorted(idf)}, math.log(1 + len(names)) + 1, idf


def cosines(words: Column, templates: Templates) -> Column:
    """Cosine of an array of words with each template, in their order; words are counted by sorting, so whole texts cost little more than their reading."""
    names, weights, other, idf = _weights(templates)
    vocabulary = F.split(F.lit(" ".join(weights)), " ")
    idfs = F.split(F.lit(" ".join(repr(idf[w]) for w in weights)), " ").cast("array<double>")
    table = F.split(F.lit(" ".join(repr(x) for v in weights.values() for x in v)), " ").cast("array<double>")  # folded to one literal
    zeros = F.array_repeat(F.lit(0.0), len(names))
    start = F.struct(zeros.alias("dots"), F.lit(0.0).alias("norm"))

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def step(acc: Column, run: Column) -> Column:
        place = run["place"]
        weight = run["count"] * F.when(place > 0, F.try_element_at(idfs, F.greatest(place, F.lit(1)))).otherwise(other)
        dots = F.when(place > 0, F.zip_with(acc["dots"], F.slice(table, (F.greatest(place, F.lit(1)) - 1) * len(names) + 1, len(names)), lambda a, b: a + weight * b)).otherwise(acc["dots"])
        return F.struct(dots.alias("dots"), (acc["norm"] + weight * weight).alias("norm"))

    def runs(ordered: Column, ends: Column) -> Column:
        """place in the vocabulary and count of each distinct word; ends: its last place in order."""
        return F.transform(ends, lambda end, i: F.struct(F.array_position(vocabulary, F.element_at(ordered, end)).cast("int").alias("place"), (end - F.when(i > 0, F.element_at(ends, F.greatest(i, F.lit(1)))).otherwise(0)).cast("double").alias("count")))

    def scored(ordered: Column) -> Column:
        n = F.size(ordered)
        ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == n) | (F.element_at(ordered, i) != F.element_at(ordered, F.least(i + 1, n)))))
        return let(ends, lambda e: F.aggregate(runs(ordered, e), start, step, lambda acc: F.transform(acc["dots"], lambda d: d / F.sqrt(F.greatest(acc["norm"], F.lit(1e-12))))))

    return let(F.array_sort(words), scored)


def best_cosines(candidates: Column, templates: Templates) -> Column:
    """The highest cosine of any candidate with each template, 0 without candidates."""
    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit(WORD), F.lit(0))
    return F.aggregate(candidates, F.array_repeat(F.lit(0.0), len(templates)), lambda best, s: F.zip_with(best, cosines(words(s), templates), lambda a, b: F.greatest(a, b)))


def named(text: Column) -> Column:
    """Does the text hold one of TRIGGERS? Plain searches, several times as fast as a pattern."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in TRIGGERS])


def own_licences(files: DataFrame, templates: dict[str, str | list[str]] | None = None, threshold: float = THRESHOLD, text: str = "text", stands: str | None = None) -> DataFrame:
    """files with own_licence and own_score (both null without one), and, if a column is named for it, whether the whole text is a notice or a licence's text.

    Columns of these names are replaced; other names can't clash.
    """
    lines, marks, long = (entries(TEMPLATES), entries(IDENTIFIERS), entries(HEADERS) + entries(TEXTS)) if templates is None else (entries(templates), [], [])
    if not lines:
        raise ValueError("no templates")
    for family in (lines, marks, long):
        cells = len(family) * len({w for _, t in family for w in re.findall(WORD, t.lower())})
        if cells > MAX_CELLS:
            raise ValueError(f"templates of {cells} numbers, more than {MAX_CELLS}")
    whole = F.coalesce(F.col(f"_row.`{text}`").cast("string"), F.lit(""))
    nothing = F.array().cast("array<string>")
    rows = F.split(whole, "\n")
    code = F.array_position(F.transform(rows, lambda x: x.rlike(COMMENT)), False).cast("int")
    head = F.array_join(F.slice(rows, 1, F.when(code > 0, code - 1).otherwise(F.size(rows))), "\n")
    blocks = F.filter(F.array_append(F.split(whole, BLOCK), head), named)
    # texts that name no licence are never cut
    out = _io.packed(files).withColumn("named", named(whole))
    out = out.withColumn("lines", F.when(F.col("named"), F.array_except(F.array_distinct(F.filter(F.split(whole, CUT), named)), F.array(whole))).otherwise(nothing))
    out = out.withColumn("blocks", F.when(F.col("named"), F.array_except(F.array_distinct(blocks), F.array(whole))).otherwise(nothing)).withColumn("whole", F.when(F.col("named"), F.array(whole)).otherwise(nothing))
    parts, names = [], []
    for kind, family, candidates in (("lines", lines, "lines"), ("marks", marks, "lines"), ("blocks", long, "blocks"), ("notice", lines, "whole"), ("mark", marks, "whole"), ("text", long, "whole")):
        if family:
            scores = best_cosines(F.col(candidates), family)
            out = out.withColumn(f"{kind}_scores", scores if family is not long else F.transform(scores, lambda s: F.when(s >= LONG_THRESHOLD, s).otherwise(0.0)))
            parts.append(f"{kind}_scores")
            names += [n for n, _ in family]
    out = out.withColumn("scores", F.when(F.col("named"), F.concat(*parts)))
    best = F.array_max("scores")
    out = out.withColumn("own_score", F.when(best >= threshold, F.round(best, 6)))
    first = F.array_min(F.filter(F.zip_with("scores", F.array(*map(F.lit, names)), lambda s, n: F.when(s == best, n)), lambda n: n.isNotNull()))
    own = {"own_licence": F.when(F.col("own_score").isNotNull(), first), "own_score": F.col("own_score")}
    if stands:
        n = len(entries(HEADERS))
        text_score = F.array_max(F.slice("text_scores", n + 1, len(long) - n)) if long else F.lit(0.0)
        header_score = F.array_max(F.slice("text_scores", 1, n)) if long else F.lit(0.0)
        own[stands] = F.col("named") & ((F.array_max("notice_scores") >= threshold) | (text_score > header_score))
    return _io.widened(out, files.columns, own)


def directory(path: Column) -> Column:
    """The directory of a path, without a slash at the end; the root is the empty text."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def ancestors(path: Column) -> Column:
    """(directory, distance) of a directory and all above it, the root included."""
    parts = F.split(path, "/")
    n = F.size(parts)
    above = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, n - i), "/").alias("above"), i.alias("distance")))
    return F.when(path == "", F.array(F.struct(F.lit("").alias("above"), F.lit(0).alias("distance")))).otherwise(F.array_append(above, F.struct(F.lit("").alias("above"), n.alias("distance"))))


def inherited(files: DataFrame, path: str = "path", stands: str | None = None) -> DataFrame:
    """files (with own_licence) and inherited_licence, inherited_from and licence: own, else inherited.

    stands: a column that says which are licence files, where names don't.
    Columns of the three names are replaced; other names can't clash.
    """
    place = F.col(f"_row.`{path}`").cast("string")
    named = _io.packed(files).withColumns({"directory": directory(place), "own": F.col("_row.own_licence"), "file": F.col(f"_row.`{stands}`") if stands else place.rlike(LICENCE_FILE)})
    declared = named.where(F.col("file") & F.col("own").isNotNull() & F.col("directory").isNotNull()).groupBy("directory", "own").count()
    declared = declared.groupBy(F.col("directory").alias("declared")).agg(F.min_by("own", F.struct(-F.col("count"), "own")).alias("licence"))
    places = named.where("directory is not null").select("directory").distinct().select("directory", F.inline(ancestors(F.col("directory"))))
    nearest = places.join(declared, F.col("above") == F.col("declared")).groupBy(F.col("directory").alias("place")).agg(F.min_by(F.struct("licence", "declared"), "distance").alias("nearest"))
    out = named.join(nearest, F.col("directory") == F.col("place"), "left")
    mine = F.col("own").isNull()
    found = {"inherited_licence": F.when(mine, F.col("nearest.licence")), "inherited_from": F.when(mine, F.col("nearest.declared")), "licence": F.coalesce("own", "nearest.licence")}
    return _io.widened(out, files.columns, found)


def op1_licences(spark, sf_dir: str) -> DataFrame:
    """Licences of documents. A document's directory is its source; one whose whole text is a notice or a licence's text stands as its licence file."""
    docs = _io.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    files = own_licences(docs, stands="stands").withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))).drop("text")
    files = _io.checkpoint(files)  # without texts; directories are then found without reading these again
    return inherited(files, stands="stands").select("doc_id", "own_licence", "own_score", "inherited_licence", "inherited_from", "licence")
