"""Corpus operators against brute force, libraries and round trips."""

import collections
import hashlib
import pickle
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import bpe, components, decontaminate, licences, nearsets, pii, puquality, rules, secrets, simhash, stats, tokencount, tokenfile
from quern.llm._text import blocks
from quern.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "\n", "a", "a\n", "a\na\na\n", "é é é é\n\n\té é é é", "\x0b\x0c x", "<|endoftext|> <s> ▁▁", "x" * 5000, "The the THE the " * 300, "'s 'll don't 12٣ \U0001f600 ﬁ"]
WORDS = "a b the of to anea reth onnt é ñ #1 $$ !! it's \n \t".split(" ")


def texts(n, seed=0, words=60):
    r = random.Random(seed)
    return ODD + [" ".join(r.choice(WORDS) for _ in range(r.randint(0, words))) for _ in range(n)]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return df.withColumns({c: F.lit(1).cast("long") for c in ("n_words", "row", "key", "_text", "spans")}) if extra else df


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def documents(spark, sf, n=200):
    return [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n).collect()]


# --- tokens -------------------------------------------------------------------


def test_bpe_is_the_library(spark, sf):
    import tiktoken

    c = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    alphabet = "aàé th's  \n\n\t\x1c\x85 12٣__\U0001f600'LL 'll ñß"
    r = random.Random(1)
    for s in [x or "" for x in texts(200)] + documents(spark, sf, 60) + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(800)]:
        ids = c.encode(s)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(s)
        assert c.decode(ids) == s.encode()


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.index) == list(range(3000))
    assert [h.find(k) for k in keys] == list(range(3000)) and h.find(b"other") == -1
    assert bpe.PerfectHash([b"one"]).find(b"one") == 0


def test_encode_and_decode_columns(spark):
    docs = frame(spark, texts(20), extra=True)
    path = P.path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(docs, path, P.PATTERN, round_trip="same"), path, P.PATTERN)
    assert all(r["same"] and bytes(r["decoded"]).decode() == (r["text"] or "") for r in coded.collect())
    assert bpe.encode(docs.limit(0), path, P.PATTERN).count() == 0


def test_token_counts(spark, sf):
    k = tokencount.counter(P.path("piece_bpe_32k.model"))
    assert k.cuts and len(k.whole) > 10_000
    for s in [x or "" for x in texts(400)] + documents(spark, sf, 60):
        assert k.count(s) == len(k.model.encode(s))
    got = by_id(tokencount.count_tokens(frame(spark, [None, "", "the of"]), P.path("piece_bpe_32k.model"), limit=1), "n_bytes", "n_tokens", "over_limit")
    assert got[0] == got[1] == (0, 0, False) and got[2][0] == 6 and got[2][2]


def test_token_files(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "PART_BYTES", 3000)
    rows = texts(100) + documents(spark, sf, 40)
    path = P.path("word_bpe_49k.json")
    e = tokenfile.encoder(path)
    parts = tokenfile.write(frame(spark, rows).repartition(5), path, f"file://{tmp_path}", end_id=1)
    assert len(parts) > 1
    at = 0
    found = tokenfile.read(spark, f"file://{tmp_path}", parts, e.width).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in found] == list(range(len(rows)))
    for r in found:
        want = e.model.encode(rows[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["token_ids"]) == (at, want)
        at += len(want)
    assert tokenfile.write(frame(spark, rows).limit(0), path, f"file://{tmp_path}/none") == []


def test_token_files_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "PART_BYTES", 4000)
    r = random.Random(2)
    long = lambda n: " ".join(r.choice(["the", "of", "and", "word"]) for _ in range(n))
    same = long(60)
    # a wide range of ids with long texts in a few of them, rows without an id, one id of many texts, one row many times
    rows = [(i * 10**12, long(2)) for i in range(50)] + [(10**12 + i, long(900)) for i in range(30)] + [(None, long(80)) for _ in range(60)]
    rows += [(7 * 10**12, long(70)) for _ in range(80)] + [(9 * 10**12, same)] * 100 + [(3, None), (4, "")]
    path = P.path("word_bpe_49k.json")
    e = tokenfile.encoder(path)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.lit("x")).withColumn("a.b", F.lit(1)).repartition(6)
    parts = tokenfile.write(docs, path, f"file://{tmp_path}", end_id=1)
    sizes = [n for _, _, n in parts]
    assert len(parts) > 20 and max(sizes) < 4 * sum(sizes) / len(sizes)
    found = tokenfile.read(spark, f"file://{tmp_path}", parts, e.width).orderBy("start").collect()
    ids = [x["doc_id"] for x in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d)) and len(found) == len(rows)
    at = 0
    for x in found:
        assert x["start"] == at and x["n_tokens"] == len(x["token_ids"])
        at += x["n_tokens"]
    want = collections.Counter((d, tuple(e.model.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in rows)
    assert collections.Counter((x["doc_id"], tuple(x["token_ids"])) for x in found) == want
    monkeypatch.setattr(tokenfile, "MAX_PARTS", 3)
    assert len(tokenfile.write(docs, path, f"file://{tmp_path}/few")) <= 4


# --- statistics, rules, classifier ----------------------------------------------


def brute_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    where = collections.defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i : i + 3])].append(i)
    cover = {i + j for v in where.values() if len(v) > 1 for i in v for j in range(3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(cover)]


def test_stats(spark, sf):
    odd = "a"
    for _ in range(10):  # the words of Thue and Morse, which a sum of powers takes as equal
        odd += odd.translate(str.maketrans("ab", "ba"))
    even = odd.translate(str.maketrans("ab", "ba"))
    rows = texts(600) + documents(spark, sf, 100) + [f"{odd}\n{even}", f"{odd} {even} {odd}\n{even} {odd} {even}", f"x\n{odd}\n{odd}\nx"]
    got = np.concatenate([stats.measure(d, o) for _, _, d, o in blocks(pa.array(rows, pa.string()), 4000)])
    assert got[:, :5].tolist() == [brute_stats(t) for t in rows]
    assert by_id(stats.measured(frame(spark, rows[:30])), *stats.NAMES[:5]) == {i: tuple(brute_stats(t)) for i, t in enumerate(rows[:30])}
    assert stats.measured(frame(spark, rows).limit(0)).count() == 0


def test_rules_find_a_planted_threshold():
    r = np.random.default_rng(0)
    x = {"a": r.random(4000), "b": r.random(4000)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5)
    found = rules.learn(x, bad)
    hit = np.zeros(4000, bool)
    for rule in found:
        hit |= np.logical_and.reduce([rules._holds(t, x) for t in rule])
    assert (hit == bad).mean() > 0.99
    assert rules.learn(x, np.zeros(4000, bool)) == [] and rules.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []


def test_quality_rules_query(spark, sf):
    out = QUERIES["op5_quality_rules"](spark, sf).toPandas()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in out.itertuples():
        n, chars, symbols, dup, repeat = brute_stats(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)


def test_pu_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op7_pu_quality"](spark, sf).toPandas()
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(out[out.held_out], on="doc_id")
    assert (labels.predicted == labels.quality).mean() > 0.9
    empty = puquality.scored(stats.measured(frame(spark, [None, ""])), puquality.Model((), (), 0.0, 0.5)).collect()
    assert [r["score"] for r in empty] == [0.5, 0.5]


# --- duplicates, decontamination --------------------------------------------------


def union(pairs, items):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


@pytest.mark.parametrize("tile", [3, 8192])
def test_simhash_components(spark, sf, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = texts(150, words=12) + documents(spark, sf, 100)
    rows += rows[:20]
    out = simhash.near_duplicates(frame(spark, rows, extra=True))
    got = by_id(out, "f0", "component_id")
    prints = {i: simhash.fingerprint(t or "")[0][0] for i, t in enumerate(rows)}
    assert {i: f & (1 << 64) - 1 for i, (f, _) in got.items()} == prints
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: c for i, (_, c) in got.items()} == union(near, prints)


def test_fingerprint_is_as_defined():
    import xxhash

    words = "A b C d e f b C d".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint("A b  C d\te f b C\nd") == ([want], 7)
    assert simhash.fingerprint(" \n") == ([0], 0) and simhash.fingerprint("One Two")[0] == [xxhash.xxh64_intdigest("one two", 42)]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(40)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate_keeps_one_of_each_group_and_all_others(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(200)) for _ in range(30)]
    rows = list(base)
    for i in range(10):  # one word changed
        words = base[i].split()
        words[100] = "changed"
        rows.append(" ".join(words))
    docs = frame(spark, rows)
    docs = docs.unionByName(docs.where("doc_id = 3"))  # a repeated row
    assert sorted(x["doc_id"] for x in simhash.deduplicate(docs).collect()) == list(range(30))


def test_deduplicate_takes_rows_and_not_ids(spark):
    r = random.Random(6)
    text = {k: " ".join(f"{k}{r.randrange(5000)}" for _ in range(80)) for k in "ABC"}
    near = text["C"].rsplit(" ", 1)[0]
    rows = [(1, "A"), (7, "A"), (7, "B"), (9, "z"), (None, "C"), (None, "D"), (None, "B"), (9, "z"), (12, ""), (13, None), (14, "D")]
    text |= {"z": "z", "D": near, "": "", None: None}
    docs = spark.createDataFrame([(i, text[k], f"{i}{k}") for i, k in rows], "doc_id long, text string, `a.b` string").withColumn("_row", F.lit(1)).withColumn("mark", F.lit(2))
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert collections.Counter(x["a.b"] for x in out.collect()) == collections.Counter(["1A", "7B", "9z", "12", "14D"])
    assert simhash.deduplicate(docs.limit(0)).count() == 0


GRAM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(t):
    return GRAM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, sf):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "a b"), (901, "the"), (902, None), (903, "A, b"), (904, " -- ")]
    rows = texts(60) + documents(spark, sf)
    windows = collections.defaultdict(set)
    for i, t in items:
        w = grams(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 24, 4000):
        out = decontaminate.overlaps(frame(spark, rows, extra=True), benchmark, max_block=limit)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in out.select("_row.doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), "items").collect()}
        for i, t in enumerate(rows):
            w, hit, named = grams(t), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        named |= windows[tuple(w[k : k + n])]
            assert got[i] == (len(w), len(hit), sorted(named))
    none = decontaminate.overlaps(frame(spark, rows), benchmark.limit(0))
    assert none.where("size(items) > 0").count() == 0 and none.count() == len(rows)


def brute_sets(rows, width=5):
    out = []
    for t in rows:
        w = t.encode().lower().split()
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_link_at_a_similarity_of_their_shingles(spark, monkeypatch, small):
    if small:  # tiles that are cut, groups of several chunks, numbers of classes that clash
        for name, value in (("TILE", 40), ("MEMBERS", 7), ("SMALL", 4)):
            monkeypatch.setattr(nearsets, name, value)
        monkeypatch.setattr(nearsets, "number", lambda salt=0: F.pmod(F.xxhash64(*nearsets.SET, F.lit(salt)), F.lit(1 << (14 + salt))))
    r = random.Random(8)
    rows = []
    for _ in range(60):  # variants around the threshold, far and near
        base = [f"w{r.randrange(9000)}" for _ in range(r.choice([3, 8, 30, 120, 400]))]
        rows.append(" ".join(base))
        for _ in range(3):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                words[r.randrange(len(words))] = f"x{r.randrange(9000)}"
            rows.append(" ".join(words))
    rows += ["", " ", "a b c d e f g " * 30, "A b c d e f g " * 40]
    base = [f"v{i}" for i in range(100)]
    for i in range(120):  # a group of many unlike near copies of one text
        words = list(base)
        for _ in range(i % 5):
            words[r.randrange(100)] = f"x{r.randrange(9000)}"
        rows.append(" ".join(words))
    found = brute_sets(rows)
    same = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    near = [(i, j) for i in range(len(rows)) for j in range(i) if same(found[i], found[j])]
    between = [1 for i in range(len(rows)) for j in range(i) if 10 * len(found[i] & found[j]) > 5 * len(found[i] | found[j]) and not same(found[i], found[j])]
    assert len(near) > 30 and len(between) > 30
    out = simhash.similar(frame(spark, rows))
    assert by_id(out, "component_id") == union(near, range(len(rows)))


def test_near_copies_may_repeat_a_passage(spark):
    r = random.Random(9)
    x, p = (" ".join(f"w{r.randrange(9000)}" for _ in range(n)) for n in (600, 250))
    docs = frame(spark, [f"{x} {p}", f"{x} {p} {p}", x])
    assert by_id(simhash.similar(docs), "component_id") == {0: 0, 1: 0, 2: 2}
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == [0, 2]


# --- personal data, secrets, licences -----------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(b"key")
    image = [f.permute(i, n, "t") for i in range(n)]
    assert sorted(image) == list(range(n))
    assert [f.permute(y, n, "t", back=True) for y in image] == list(range(n))


def test_pseudonyms_keep_formats_and_links(spark):
    t = "a +1 (017) 555-7713 b 4111 1111 1111 1111 x.72@mail3.example.com### 152.143.123.131 DE89 3704 0044 0532 0130 00 078-05-1120 1999-12-31 31.12.1999 1.2.3.4.5 2020-02-30 4111111111111112"
    rows = [t, t, None, "", "nothing here"]
    out = pii.pseudonymise(frame(spark, rows, extra=True), b"k")
    got = by_id(out, "text")
    assert got[0] == got[1] and got[2] is None and got[3] == "" and got[4] == "nothing here"
    assert got[0].endswith("1.2.3.4.5 2020-02-30 4111111111111112")
    for secret in ("555-7713", "4111 1111 1111 1111", "x.72@", "152.143", "0532 0130", "078-05", "1999-12-31"):
        assert secret not in got[0]
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[0])[0].replace(" ", "")
    assert pii.luhn_digit(card[:-1]) == int(card[-1])
    iban = re.search(r"DE\d\d(?: \d{4}){4} \d\d", got[0])[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert by_id(pii.pseudonymise(out.select("doc_id", "text"), b"k", counts=False, back=True), "text")[0] == t
    assert by_id(pii.pseudonymise(frame(spark, rows), b"other"), "text")[0] != got[0]


@pytest.mark.parametrize("text", ["...jane.doe@mail.example.com", "_jane@x.org_", "%%%j.12@mail3.example.com###", "to:jane@x.org,joe@y.org", "élan.7@x.org"])
def test_addresses_next_to_marks(text):
    found = pii.findings(text, pii.Feistel(b"k"))
    assert [f[2] for f in found] == ["email"] * text.count("@")
    assert pii.rewrite(pii.rewrite(text, found), pii.findings(pii.rewrite(text, found), pii.Feistel(b"k"), back=True)) == text


def brute_secrets(t):
    out = []
    for kind, pattern, least in ((0, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), (1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, t or "") if len(m[2] if not kind else m[0]) >= least]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, sf):
    r = random.Random(3)
    parts = ["token", "=", " ", '"', "abcdef", "AKIA", "0123456789", "ABCDEFGH", "\n", "é", "password: ", "APIKEY=", "\U0001f600", "deadbeef", ".", "'"]
    rows = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(300)] + ODD + documents(spark, sf, 100)
    rows += ["key wJalrXUtnFEMI/K7MDENG/bPxRfiCYq83xZ7pLm end", "see https/www-example-com/articles-2024 and getUserAccountList2"]
    model = secrets.train(secrets.samples(spark))
    out = secrets.scan(frame(spark, rows), model).select("doc_id", secrets.rendered("base").alias("base"), secrets.rendered("found").alias("found"))
    got = by_id(out, "base", "found")
    assert {i: b for i, (b, _) in got.items()} == {i: brute_secrets(t) for i, t in enumerate(rows)}
    assert got[len(rows) - 2][1].startswith("random:4:") and got[len(rows) - 1][1] == ""
    assert set(secrets.train(secrets.samples(spark).limit(0))) == {0.0}


def test_secret_models_tell_held_out_samples_apart(spark):
    data = secrets.samples(spark, 3000).withColumn("test", F.crc32(F.col("text").cast("binary")) % 3 == 0)
    model = secrets.train(data.where("not test").select("text", "random"))
    right = data.where("test").select(((secrets.ratio(F.col("text"), model) > 0) == F.col("random")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.97


def test_secrets_joined_to_words_are_found(spark):
    r = random.Random(4)
    code = lambda n, letters="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(letters) for _ in range(n))
    word = lambda: r.choice(secrets.WORDS)
    kinds = {
        "stripe": lambda: f"STRIPE_LIVE_KEY=sk_live_{code(24)}",
        "credential": lambda: f"DATABASE_CREDENTIAL={code(24)}",
        "production": lambda: f"DATABASE_CONNECTION_PASSWORD_PRODUCTION={code(24)}",
        "path": lambda: f"{word()}/{word()}/{word()}/{word()}/{code(24)}",
        "tail": lambda: f"{word()}_{word()}_{word()}_{code(20)}",
        "letters": lambda: code(40, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "words": lambda: r.choice("_-/").join(word() for _ in range(8)),
        "path of words": lambda: f"{word()}/{word()}-{word()}/2024/{word()}_{word()}/{word()}{word()}",
        "rules": lambda: r.choice(["-" * 60, "=-" * 30, "x" * 50, "Y" * 30, "Title" + "_" * 40]),
    }
    rows = [(k, f()) for k, f in kinds.items() for _ in range(200)]
    out = secrets.scan(frame(spark, [t for _, t in rows]), secrets.train(secrets.samples(spark))).select("doc_id", (F.size("found") > 0).alias("hit"))
    hits = collections.Counter(rows[i][0] for i, hit in by_id(out, "hit").items() if hit)
    share = {k: hits[k] / 200 for k in kinds}
    assert all(share[k] >= 0.9 for k in list(kinds)[:6]), str(share)
    assert all(share[k] <= 0.03 for k in list(kinds)[6:]), str(share)


def test_licences(spark):
    rows = [
        ("a/LICENSE", "MIT License\n\nReleased under the MIT License."),
        ("a/b/c/x.py", "hello"),
        ("a/b/y.py", "x\nLicensed under the Apache License, Version 2.0. and more"),
        ("z.py", ""),
        ("a/b/LICENSE.txt", "Licensed under CC BY-NC 4.0."),
        ("a/q.py", None),
        (None, "x"),
        ("a/b/d/e", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/d/f", "We have no license to speak of in this long sentence about other things"),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: (r["own_licence"], r["licence"], r["inherited_from"]) for r in licences.inherited(licences.own_licences(df)).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "MIT", None),
        "a/b/c/x.py": (None, "CC-BY-NC-4.0", "a/b"),
        "a/b/y.py": ("Apache-2.0", "Apache-2.0", None),
        "z.py": (None, None, None),
        "a/b/LICENSE.txt": ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None),
        "a/q.py": (None, "MIT", "a"),
        None: (None, None, None),
        "a/b/d/e": ("GPL-3.0", "GPL-3.0", None),
        "a/b/d/f": (None, "CC-BY-NC-4.0", "a/b"),
    }
    with pytest.raises(ValueError, match="templates"):
        licences.own_licences(df, {})


def test_licence_headers_identifiers_and_texts(spark):
    wrap = lambda t, mark: "".join(f"{mark} {line}\n" for line in re.findall(r".{1,70}(?:\s|$)", t))
    rows = [(n, f"/*\n{wrap(t[0], ' *')} */\n#include <x>\nint main() {{ return 1; }}" + " x" * 60) for n, t in licences.HEADERS.items()]
    rows += [(n, wrap(t[0], "#") + "import os\n" * 50) for n, t in licences.HEADERS.items()]
    rows += [(n, f"// {x}\nint x;\n") for n, t in licences.IDENTIFIERS.items() for x in t]
    rows += [(n, "Copyright (c) 2024 Some One\n\n" + x) for n, t in licences.TEXTS.items() for x in t]
    rows += [(None, "the license of this long prose is not to be had " + "word " * 1000)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = by_id(licences.own_licences(df, stands="stands"), "own_licence", "stands")
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in enumerate(rows)}
    n = sum(map(len, licences.TEXTS.values()))
    assert all(got[i][1] for i in range(len(rows) - 1 - n, len(rows) - 1)) and not any(got[i][1] for i in range(2 * len(licences.HEADERS)))


# --- queries and pipeline -------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_every_document(spark, sf, name):
    out = QUERIES[name](spark, sf)
    assert "doc_id" in out.columns
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_contract_digests(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    base = by_id(QUERIES["op3_secrets"](spark, sf), "base_sha256")
    assert base == {i: hashlib.sha256(brute_secrets(t).encode()).hexdigest() for i, t in docs.items()}


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_000 + i, t, None, None, None) for i, t in enumerate(ODD)], docs.schema)
    docs = docs.unionByName(odd).withColumns({"n_words": F.lit("x"), "component_id": F.lit("y")})
    known = {r["doc_id"]: r["text"] for r in docs.collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert after.columns == docs.columns
        ids = sorted(r["doc_id"] for r in after.select("doc_id").collect())
        assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "quality rules":
            for i in ids:
                n, _, _, _, repeat = brute_stats(known[i])
                assert n >= 50 and 100 * repeat <= 50 * n
        if name == "near duplicates":
            held = [r["text"] for r in after.select("text").collect()]
            assert len(held) == len(set(held))
        if name == "personal data":
            assert not any("@mail" in r["text"] and r["text"] == known[r["doc_id"]] for r in after.select("doc_id", "text").collect())
        before = after
    assert all(r["round_trip"] for r in before.collect())


def test_pipeline_on_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_decontamination_query_and_the_size_of_blocks(spark, sf):
    docs = {r["doc_id"]: grams(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    windows = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = grams(r["text"])
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(r["item_id"]))
    lengths = {len(w) for w in windows}
    for r in QUERIES["op6_decontaminate"](spark, sf).collect():
        w, hit, named = docs[r["doc_id"]], set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    named |= own
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(named), digest, bool(hit))
    r = random.Random(0)
    texts_ = [" ".join(f"w{r.randrange(9000)}" for _ in range(300)) for _ in range(1500)]
    block = decontaminate._read(pa.array([str(i) for i in range(1500)]), pa.array(texts_), 10)
    keys, _ = decontaminate._keys(block, 5)
    held = len(pickle.dumps(decontaminate._arrange(block, 5, keys, np.zeros(len(keys), np.int64))))
    assert held < 12 * sum(map(len, texts_))
