"""Secret spans against a plain version, on a labelled sample, and on long texts."""

import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from quern.llm import secrets

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ALNUM = string.ascii_letters + string.digits


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.samples(spark))


def plain_best(run, model, least=20):
    """The most that a stretch of so many characters and more has, by trying all of them."""
    size, marks = len(secrets.ALPHABET) + 1, "+/_=-"
    codes = [0] + [secrets.ALPHABET.index(c) + 1 for c in run]
    scores = []
    for k in range(len(run)):
        a, b = codes[k], codes[k + 1]
        x = model[a * size + b] - secrets.THRESHOLD
        if k and run[k] == run[k - 1]:
            x = min(x, -secrets.THRESHOLD)
        scores.append(-5.0 if k and run[k] in marks and run[k - 1] in marks else x)
    return max(sum(scores[i:j]) for i in range(len(run)) for j in range(i + least, len(run) + 1))


def plain_spans(text, model):
    base = []
    for kind, pattern, least in ((0, ASSIGN, 6), (1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[2] if not kind else m[0]) >= least]
    runs = [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or "") if plain_best(m[0], model) > 0]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + [r for r in runs if not any(a < r[2] and r[0] < b for a, _, b in base)]))


def found(df, model, *columns):
    return secrets.scan(df, model).select(*columns, secrets.rendered("found").alias("spans"))


def test_spans_are_those_of_a_plain_version(spark, model):
    r = random.Random(11)
    code = lambda n, letters=ALNUM: "".join(r.choice(letters) for _ in range(n))
    parts = [lambda: f"password={code(8)}", lambda: f"token: {code(14)}.{code(30)}", lambda: code(28), lambda: "AKIA" + code(18, string.ascii_uppercase), lambda: code(30, "0123456789abcdef"), lambda: "_".join(r.choices(secrets.WORDS, k=5)), lambda: "é \U0001f600 ", lambda: f"x{code(40)}-AKIA{'B' * 20}", lambda: "\n", lambda: "secret=ab"]
    rows = ["", None, *("".join(r.choice(parts)() + r.choice([" ", "", "."]) for _ in range(r.randint(0, 9))) for _ in range(250))]
    rows.append(" ".join(r.choice(parts)() for _ in range(700)))  # more matches than a block
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x["doc_id"]: x["spans"] for x in found(df, model, "doc_id").collect()}
    assert got == {i: plain_spans(t, model) for i, t in enumerate(rows)}
    assert any("random" in s and "assign" in s for s in got.values())


def test_the_model_finds_planted_secrets_in_prose_and_little_else(spark, model):
    """Labelled prose: recall of bare random strings, and precision of what the model adds."""
    r = random.Random(12)
    word = lambda: r.choice(secrets.WORDS)
    rows, n = [], 600
    for i in range(n):
        prose = [word() for _ in range(60)] + [r.choice("_-/").join(word() for _ in range(r.randint(3, 7))) for _ in range(6)] + [f"https/www/{word()}-{word()}/{word()}_{r.randrange(3000)}" for _ in range(3)]
        r.shuffle(prose)
        secret = ""
        if i % 2:
            secret = "".join(r.choice(ALNUM) for _ in range(r.randint(22, 44)))
            prose.insert(r.randrange(len(prose)), secret)
        rows.append((i, " ".join(prose), secret))
    df = spark.createDataFrame(rows, "doc_id long, text string, secret string")
    hits = right = 0
    for x in found(df, model, "text", "secret").collect():
        named = [x["text"][int(a) : int(b)] for a, b in (s.split(":")[1:] for s in x["spans"].split(",") if s.startswith("random"))]
        hits += len(named)
        right += x["secret"] in named if x["secret"] else 0
    recall, precision = right / (n // 2), right / hits
    assert recall >= 0.95 and precision >= 0.95, (recall, precision)
    print("secrets: recall", recall, "precision", precision)


def test_a_long_text_of_secrets_takes_time_by_its_length(spark, model):
    r = random.Random(13)
    parts = [f"token={r.randrange(10**12)}", hashlib.sha1(b"x").hexdigest(), "".join(r.choice(ALNUM) for _ in range(26)), "plain words between them"]
    text = " ".join(parts[i % 4] for i in range(40_000)) + " é " + "a" * 300_000 + " " + "A1" * 100_000
    assert len(text) > 1_000_000
    df = spark.createDataFrame([(1, text), (1, text), (None, "x")], "doc_id long, text string")
    out = found(df, model, "doc_id").collect()
    assert len(out) == 3 and out[0]["spans"] == out[1]["spans"] and out[2]["spans"] == ""
    spans = out[0]["spans"].split(",")
    assert len(spans) >= 30_000 and spans[:2] == [f"assign:0:{len(parts[0])}", f"hex:{len(parts[0]) + 1}:{len(parts[0]) + 41}"]


def test_names_of_columns_and_empty_tables(spark, model):
    df = spark.createDataFrame([(1, "password=abcdefg", "x", 1, 2)], "doc_id long, text string, `a.b` string, _row long, k0 long").withColumn("base", F.lit(7))
    out = secrets.scan(df, model)
    assert out.columns == ["doc_id", "text", "a.b", "_row", "k0", "base", "found"]
    row = out.first()
    assert (row["a.b"], row["k0"], len(row["base"])) == ("x", 2, 1)
    assert secrets.scan(df.limit(0), model).count() == 0
