"""Pseudonyms: one-to-one, linked across spellings, undone by the key, and found as a plain search finds them."""

import collections
import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from quern.llm import pii

KEY = pii.Feistel(b"k")


def replaced(text, back=False):
    return pii.rewrite(text, pii.findings(text, KEY, back))


def kinds(text):
    return [f[2] for f in pii.findings(text, KEY)]


def test_dates_are_one_to_one_in_all_forms_and_linked():
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(i) for i in range(3652)]
    first_of = {"%d/%m/%Y": lambda d: True, "%d.%m.%Y": lambda d: True, "%Y-%m-%d": lambda d: True, "%Y/%m/%d": lambda d: True, "%m/%d/%Y": lambda d: d.day > 12}
    new = {}
    for form, known in first_of.items():  # a month that comes first is known by a day after the twelfth
        own = [d for d in days if known(d)]
        image = [replaced(d.strftime(form)) for d in own]
        assert len(set(image)) == len(own) and all(replaced(y, back=True) == d.strftime(form) for d, y in zip(own, image, strict=True))
        for d, y in zip(own, image, strict=True):
            new.setdefault(d, set()).add(datetime.datetime.strptime(y, form).date())
    assert all(len(v) == 1 for v in new.values()) and len(set().union(*new.values())) == len(days)
    both = [d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")]
    image = {x: replaced(x) for x in both}
    assert len(set(image.values())) == len(image) and all(replaced(y, back=True) == x for x, y in image.items())


@pytest.mark.parametrize("spellings", [["+351 912 345 678", "+351912345678", "+351-912-345-678"], ["+1 (212) 555-7713", "+12125557713", "+1 212.555.7713"], ["+49 151 12345678", "+4915112345678"], ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"], ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"], ["06 12 34 56 78", "06.12.34.56.78"], ["2001:db8:0:0:0:0:0:1", "2001:0DB8:0:0:0:0:0:0001"]])
def test_equal_values_are_linked_however_they_are_spelt(spellings):
    images = [replaced(f"to {s}, then") for s in spellings]
    plain = {"".join(c for c in y[3:-6].lower() if c.isalnum()) if ":" not in y else y for y in images}
    assert len(plain) == 1 and not any(s in y for s, y in zip(spellings, images, strict=True))
    assert [kinds(f"to {s}, then") for s in spellings] == [kinds(spellings[0])] * len(spellings)


def test_kinds():
    assert kinds("+4915112345678") == ["phone"] and kinds("4111111111111111") == ["card"]
    assert kinds("fe80::1:2:3 and 2001:db8::8a2e:370:7334 not 12:30:45 a::b 1:2:3:4:5") == ["ip", "ip"]
    assert kinds("1.2.3.4 01 02 03 04 05 x 99.12.31.00") == ["ip", "phone"]
    assert kinds("") == [] and kinds("@ 1 22/13/2020 2020-02-30") == []


def plain_findings(text):
    """Every kind's pattern over the whole text, each match against all that were found."""
    out = []
    for kind in pii.KINDS:
        pattern, replace = pii._PATTERNS[kind]
        for m in pattern.finditer(text):
            if all(m.end() <= a or b <= m.start() for a, b, _ in out) and replace(m[0], KEY, False) is not None:
                out.append((m.start(), m.end(), kind))
    return sorted(out)


def test_findings_are_those_of_a_plain_search_and_are_undone(spark, sf):
    r = random.Random(1)
    parts = ["jane.doe@mail.example.com", "4111 1111 1111 1111", "+1 (017) 555-7713", "078-05-1120", "192.168.0.1", "DE89 3704 0044 0532 0130 00", "1999-12-31", "31.12.1999", " ", ", ", "x", "1", "@", "-", "é", "\n"]
    rows = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(800)]
    rows += [x["text"] or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text in rows:
        found = pii.findings(text, KEY)
        assert [f[:3] for f in found] == plain_findings(text)
        new = pii.rewrite(text, found)
        again = pii.findings(new, KEY, back=True)
        if [f[2] for f in again] == [f[2] for f in found]:
            assert pii.rewrite(new, again) == text
        assert not any(text[a:b] in new[a:b] for a, b, k, _ in found if k in ("card", "ssn"))


def test_query_counts_what_is_found(spark, sf):
    from quern.llm.queries import QUERIES

    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    demo = pii.Feistel(pii.DEMO_KEY)
    for x in QUERIES["op2_pii"](spark, sf).collect():
        found = pii.findings(docs[x["doc_id"]] or "", demo)
        assert x["text"] == (pii.rewrite(docs[x["doc_id"]], found) if found else docs[x["doc_id"]])
        counts = collections.Counter(f[2] for f in found)
        assert [x[f"pii_{k}"] for k in pii.KINDS] == [counts[k] for k in pii.KINDS]


def test_a_long_text_takes_time_by_its_length():
    text = " ".join(f"user{i}.name@mail{i % 7}.example.com 10.{i % 250}.3.4 2020-01-{i % 28 + 1:02d}" for i in range(20_000))
    assert len(text) > 1_000_000
    began = time.time()
    assert len(pii.findings(text, KEY)) == 60_000
    assert time.time() - began < 60


def test_odd_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "1.2.3.4", "x"), (None, "1.2.3.4", "x"), (1, None, None), (2, "", None)], "doc_id long, text string, `a.b` string").withColumns({"pii_card": F.lit("mine"), "_row": F.lit(1)})
    out = pii.pseudonymise(df, b"k")
    assert out.columns == ["doc_id", "text", "a.b", "_row", *(f"pii_{k}" for k in pii.KINDS)]
    rows = out.orderBy("doc_id").collect()
    assert rows[0] == rows[1] and rows[0]["text"] != "1.2.3.4" and rows[0]["pii_ip"] == 1
    assert [x["text"] for x in rows[2:]] == [None, ""]
    assert pii.pseudonymise(df, b"k", counts=False).columns == df.columns
    assert pii.pseudonymise(df.limit(0), b"k").count() == 0
