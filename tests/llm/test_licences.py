"""Licence scans against plain cosines and plain inheritance, and on real texts."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import licences

WORD = re.compile(licences.WORD)


def plain_cosine(text, template, templates):
    """TF-IDF cosine by its definition."""
    n, df = len(templates), collections.Counter(w for t in templates for w in set(WORD.findall(t.lower())))
    weight = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    a, b = ({w: k * weight(w) for w, k in collections.Counter(WORD.findall(t.lower())).items()} for t in (text, template))
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b) or 1)


def test_cosines_are_those_of_the_definition(spark):
    r = random.Random(2)
    family = licences.entries(licences.HEADERS)
    templates = [t for _, t in family]
    words = " ".join(templates).split() + ["other", "words", "x2.0", "é"]
    rows = ["", *templates, *(" ".join(r.choices(words, k=r.randint(1, 200))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(rows)), "i long, text string")
    got = df.select("i", licences.best_cosines(F.array("text"), family).alias("c")).collect()
    for x in got:
        assert x["c"] == pytest.approx([plain_cosine(rows[x["i"]], t, templates) for t in templates], abs=1e-9)


def test_inheritance_is_that_of_the_nearest_ancestor(spark):
    r = random.Random(3)
    folders = ["", "a", "a/b", "a/b/c", "a/d", "e", "e/f/g"]
    rows = []
    for i in range(300):
        folder, kind = r.choice(folders), r.random()
        name = r.choice(["LICENSE", "COPYING", "licence.md", "UNLICENSE.txt"]) if kind < 0.08 else f"f{i}.py"
        own = r.choice(["MIT", "ISC", "CC0-1.0"]) if kind < 0.15 else None
        rows.append((f"{folder}/{name}".lstrip("/") if r.random() < 0.97 else None, own, i))
    rows += rows[:20]  # repeated rows count again
    votes = collections.defaultdict(collections.Counter)
    for path, own, _ in rows:
        if path and own and re.search(licences.LICENCE_FILE.replace("(?i)", ""), path, re.I):
            votes[path.rpartition("/")[0]][own] += 1
    best = {d: min(v, key=lambda k: (-v[k], k)) for d, v in votes.items()}

    def expected(path, own):
        if own or path is None:
            return own, None
        at = path.rpartition("/")[0]
        while at not in best and at:
            at = at.rpartition("/")[0]
        return (best[at], at) if at in best else (None, None)

    df = spark.createDataFrame(rows, "path string, own_licence string, `a.b` long").withColumns({"_row": F.lit(1), "directory": F.lit(2), "nearest": F.lit("n"), "licence": F.lit("old")})
    out = licences.inherited(df)
    assert out.columns == ["path", "own_licence", "a.b", "_row", "directory", "nearest", "inherited_licence", "inherited_from", "licence"]
    got = collections.Counter((x["path"], x["own_licence"], x["a.b"], x["licence"], x["inherited_from"]) for x in out.collect())
    assert got == collections.Counter((p, o, i, *expected(p, o)) for p, o, i in rows)
    assert any(x[4] == "a" for x in got) and any(x[4] == "" for x in got)
    assert licences.inherited(df.limit(0)).count() == 0


def test_real_texts(spark):
    gpl = licences.TEXTS["GPL-3.0"][0]
    rows = [
        ("MIT", licences.TEXTS["MIT"][0]),
        ("GPL-3.0", "\n".join(gpl.split("\n")[:40])),
        ("GPL-3.0", "\n".join(gpl.split("\n")[:4])),
        ("BSD-2-Clause", licences._BSD),
        ("MIT", "SPDX-License-Identifier: MIT"),
        ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0\nint x;"),
        ("Apache-2.0", licences.HEADERS["Apache-2.0"][0]),
        ("Elastic-2.0", "Copyright 2020 Someone\n\nElastic License 2.0\n\nURL: https://www.elastic.co/licensing/elastic-license\n\n## Acceptance\n\nBy using the software, you agree to all of the terms and conditions below."),
        (None, "By using this website you accept our terms, our license to your content and its copyright notice, without warranty of any kind. " * 30),
    ]
    df = spark.createDataFrame(rows, "want string, text string")
    assert [(x["own_licence"]) for x in licences.own_licences(df).collect()] == [w for w, _ in rows]


def test_ties_long_texts_and_odd_columns(spark):
    same = {"B": "Licensed under the same license words", "A": "Licensed under the same license words"}
    r = random.Random(4)
    long = "\n".join("a license line " + " ".join(f"w{r.randrange(90_000)}" for _ in range(12)) for _ in range(12_000))
    assert len(long) > 1_000_000
    rows = [(1, same["A"]), (1, same["A"]), (None, None), (2, ""), (3, "license " + " ".join(f"w{i}" for i in range(150_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_row": F.lit(1), "scores": F.lit(2), "named": F.lit(3), "a.b": F.lit(4), "own_licence": F.lit("old")})
    out = licences.own_licences(df, same, stands="stands")
    assert out.columns == ["doc_id", "text", "_row", "scores", "named", "a.b", "own_licence", "own_score", "stands"]
    assert sorted(((x["doc_id"] or 0, x["own_licence"], x["stands"], x["a.b"]) for x in out.collect()), key=str) == sorted([(1, "A", True, 4)] * 2 + [(0, None, False, 4), (2, None, False, 4), (3, None, False, 4)], key=str)
    assert licences.own_licences(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()["own_licence"] is None
    assert licences.own_licences(df.limit(0)).count() == 0
    many = {f"L{i}": " ".join(f"w{j}" for j in range(i, i + 40)) for i in range(3000)}
    with pytest.raises(ValueError, match="numbers"):
        licences.own_licences(df, many)
