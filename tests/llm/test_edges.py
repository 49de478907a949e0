"""Odd input for every operator: null ids and texts, repeated rows, long texts, empty tables, clashing and dotted names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import _io, bpe, decontaminate, licences, nearsets, pii, puquality, rules, secrets, simhash, stats, tokencount, tokenfile
from quern.llm._tiles import forest
from quern.llm.queries import QUERIES
from tests.llm.test_llm import brute_stats, union

P = pytest.importorskip("public_tokenizers")
BPE = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
WORDS = P.path("word_bpe_49k.json")
PIECES = P.path("piece_bpe_32k.model")
CLASHES = ("_row", "_in", "n_words", "row", "key", "base_", "spans", "c0", "id", "a", "b", "part", "tie", "mark", "first", "f0", "h1", "c", "_id", "_mark", "token", "chunk", "number", "size", "named", "nearest", "lines")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with a megabyte of text, nulls and repetitions, beside columns of awkward names."""
    r = random.Random(21)
    long = " ".join(r.choice(["the", "of", "and", "word", "Été", f"w{r.randrange(9000)}"]) for _ in range(240_000))
    assert len(long.encode()) > 1_000_000
    rows = [(1, long), (2, None), (3, ""), (None, "no id here at all"), (None, None), (4, "same row"), (4, "same row"), (4, "same id, other text"), (5, " \n\t "), (6, "x" * 200_000), (7, " ".join(f"u{i}" for i in range(80)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in CLASHES} | {"a.b": F.lit("dotted")})


OPERATORS = {
    "licences": lambda d, s: licences.inherited(licences.own_licences(d.withColumn("path", F.concat(F.lit("a/"), F.col("doc_id").cast("string"))))),
    "pii": lambda d, s: pii.pseudonymise(d, b"k"),
    "secrets": lambda d, s: secrets.scan(d, secrets.train(secrets.samples(s, 400))),
    "bpe": lambda d, s: bpe.decode(bpe.encode(d, *BPE, round_trip="same"), *BPE),
    "rules": lambda d, s: rules.judged(stats.measured(d), [(rules.Test("word_length", True, 9.0),)]),
    "decontaminate": lambda d, s: _io.unpacked(decontaminate.overlaps(d, s.createDataFrame([("i", "the of and")], "item_id string, text string"))),
    "puquality": lambda d, s: puquality.scored(stats.measured(d), puquality.Model((("n_words", 3.0),), (1.0,), 0.0, 0.5)),
    "tokencount": lambda d, s: tokencount.count_tokens(d, PIECES),
    "simhash": lambda d, s: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_comes_back_and_no_rows_give_none(spark, odd, name):
    out = OPERATORS[name](odd, spark).collect()
    assert len(out) == odd.count()
    if "a.b" in out[0].asDict():
        assert {x["a.b"] for x in out} == {"dotted"} and {x["_row"] for x in out} == {7}
    assert OPERATORS[name](odd.limit(0), spark).collect() == []


@pytest.mark.parametrize("stage", ["rules", "simhash", "decontaminate"])
def test_filters_keep_rows_as_they_are(spark, odd, stage):
    labels = spark.createDataFrame([(1, 1), (None, 0), (9, None), (1, 0)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([("i", None), (None, "x"), ("j", "same row"), ("j", "same row")], "item_id string, text string")
    f = {"rules": lambda d: rules.good_documents(d, labels), "simhash": simhash.deduplicate, "decontaminate": lambda d: decontaminate.clean_documents(d, benchmark)}[stage]
    out = f(odd)
    assert out.columns == odd.columns and f(odd.limit(0)).collect() == []
    got = collections.Counter((x["doc_id"], (x["text"] or "")[:30]) for x in out.collect())
    every = collections.Counter((x["doc_id"], (x["text"] or "")[:30]) for x in odd.collect())
    assert all(n <= every[k] for k, n in got.items())
    if stage == "rules":
        assert {k[0] for k in got} == {7}  # the long text repeats its words
    if stage == "simhash":  # texts without words are one class, of which the first id stays
        assert got == collections.Counter({k: 1 for k in every if k not in ((3, ""), (5, " \n\t "), (None, ""))})
    if stage == "decontaminate":
        assert got == every - collections.Counter({(4, "same row"): 2})


def test_token_files_of_odd_rows(spark, odd, tmp_path):
    parts = tokenfile.write(odd, WORDS, f"file://{tmp_path}", end_id=1)
    e = tokenfile.encoder(WORDS)
    out = tokenfile.read(spark, f"file://{tmp_path}", parts, e.width, digest=True).collect()
    want = collections.Counter()
    for x in odd.collect():
        ids = e.model.encode(x["text"] or "", add_special_tokens=False).ids + [1]
        want[x["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in out) == want
    ends = sorted((x["start"], x["start"] + x["n_tokens"]) for x in out)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


# --- queries against the libraries and plain versions, with their digests ---------------------


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {x["doc_id"]: x["text"] or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op4_is_the_library(spark, sf, documents):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(BPE[0]), special_tokens={})
    for x in QUERIES["op4_byte_bpe"](spark, sf).collect():
        text = documents[x["doc_id"]]
        ids = library.encode_ordinary(text)
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op5_rules_are_what_decides(spark):
    sf = "/root/testdata/sf0.01"
    documents = {x["doc_id"]: x["text"] or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {x["doc_id"]: x for x in QUERIES["op5_quality_rules"](spark, sf).collect()}
    learnt = rules.fit(stats.measured(_io.table(spark, sf, "documents")), _io.table(spark, sf, "labels"))
    measured = {x["doc_id"]: x for x in rules.with_ratios(stats.measured(_io.table(spark, sf, "documents"))).collect()}
    assert learnt and set(rows) == set(documents)
    for i, x in rows.items():
        n, chars, symbols, lines, repeat = brute_stats(documents[i])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (n, chars, symbols, lines, repeat)
        hit = next((k for k, rule in enumerate(learnt, 1) if all((measured[i][t.feature] > t.threshold) == t.above for t in rule)), None)
        assert x["rule"] == hit and x["kept"] == (not x["base_failed"] and hit is None)


def test_rules_break_ties_by_name_and_learn_alike_from_any_order(spark):
    r = np.random.default_rng(1)
    same = r.random(600)
    x = {"b": same, "a": same.copy()}
    found = rules.learn(x, same > 0.7)
    assert found and {t.feature for rule in found for t in rule} == {"a"}


def test_op8_files_hold_what_the_library_gives(spark, sf, documents):
    e, at = tokenfile.encoder(WORDS), 0
    rows = {x["doc_id"]: x for x in QUERIES["op8_token_files"](spark, sf).collect()}
    for i in sorted(documents):
        ids = e.model.encode(documents[i], add_special_tokens=False).ids + [1]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op9_counts_are_the_librarys(spark, sf, documents):
    model = tokencount.counter(PIECES).model
    for x in QUERIES["op9_token_counts"](spark, sf).collect():
        text = documents[x["doc_id"]]
        n = len(model.encode(text))
        assert (x["n_bytes"], x["n_tokens"], x["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_op10_fingerprints_and_components(spark, sf, documents):
    import xxhash

    def plain(text):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: plain(t) for i, t in documents.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    parts = union(near, prints)
    for x in QUERIES["op10_simhash"](spark, sf).collect():
        assert (x["fingerprint"], x["component_id"]) == (f"{prints[x['doc_id']]:016x}", parts[x["doc_id"]])


def test_ids_that_share_fingerprints_join_no_components(spark):
    rows = [(1, "alpha beta gamma"), (1, "delta eps zeta"), (5, "alpha beta gamma"), (6, "delta eps zeta"), (None, "other words here"), (None, "delta eps zeta")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"]) for x in out if x["component_id"] is not None) == [(0, 1), (1, 1), (1, 1), (5, 1), (6, 1)]


def test_forests_are_those_of_all_pairs():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    prints = np.concatenate([base, base ^ (np.uint64(1) << r.integers(0, 64, (40, 2)).astype(np.uint64)), base[:5]])
    for radius in (0, 2, 60):
        root = forest(np.ones(len(prints), bool), prints, radius)
        near = [(i, j) for i in range(len(prints)) for j in range(i) if int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= radius]
        assert dict(enumerate(root.tolist())) == union(near, range(len(prints)))


def test_fingerprints_of_similar_sets_are_within_the_radius():
    """The share of sets of a similarity of 0.8 whose fingerprints are candidates."""
    r = np.random.default_rng(4)
    hits = []
    for _ in range(400):
        n = int(r.integers(50, 500))
        pool = r.integers(0, 1 << 63, 10 * n).astype(np.uint64)
        common = 8 * n // 9 + 1  # 8 of 10 shingles of the union
        a, b = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
        pa_, pb = (np.array(nearsets.majority(s, 2), np.uint64) for s in (a, b))
        hits.append(int(np.bitwise_count(pa_ ^ pb).sum()) <= nearsets.RADIUS)
    assert np.mean(hits) >= 0.99


# --- positive-unlabelled learning ------------------------------------------------------------


def sample(r, n, share):
    good = r.random(n) < share
    x = {f: r.random(n) for f in puquality.FEATURES}
    for f in list(puquality.FEATURES)[:3]:
        x[f] = np.where(good, 0.6, 0.0) + 0.4 * r.random(n)
    return x, good


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_the_prior_is_estimated_from_positives_and_unlabelled_rows(share):
    r = np.random.default_rng(5)
    u, good = sample(r, 6000, share)
    p, _ = sample(r, 2000, 1.0)
    model = puquality.fit(p, u)
    assert abs(model.prior - good.mean()) < 0.05
    z = sum(w * (u[f] > t) for (f, t), w in zip(model.steps, model.weights, strict=True)) + model.bias
    assert ((z >= 0) == good).mean() > 0.97


def test_the_fit_is_a_minimum_of_the_risk():
    r = np.random.default_rng(6)

    def rows(n, share):
        good = r.random(n) < share
        return {f: r.random(n) + (0.3 * good if f in puquality.FEATURES[:3] else 0) for f in puquality.FEATURES}

    p, u = rows(4000, 1.0), rows(8000, 0.5)
    model = puquality.fit(p, u, 0.5, rounds=2000, rate=0.02, decay=0.0)
    x = {k: np.stack([d[f] > t for f, t in model.steps], 1).astype(float) for k, d in (("p", p), ("u", u))}

    def risk(w, bias):
        zp, zu = x["p"] @ w + bias, x["u"] @ w + bias
        return 0.5 * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - 0.5 * np.logaddexp(0, zp).mean())

    w = np.array(model.weights)
    least = risk(w, model.bias)
    assert least < risk(0 * w, 0.0)
    worse = [risk(w + 0.2 * r.standard_normal(len(w)), model.bias + 0.2 * r.standard_normal()) - least for _ in range(100)]
    assert min(worse) > -1e-3, min(worse)


# --- helpers -----------------------------------------------------------------------------------


def test_whole_gives_runs_uncut():
    import pyarrow as pa

    r = random.Random(7)
    for most in (0, 5):
        for _ in range(200):
            keys = sorted(r.randrange(6) for _ in range(r.randint(0, 40)))
            rows = list(enumerate(keys))
            batches, at = [], 0
            while at < len(rows):
                n = r.randint(0, 7)
                batches.append(pa.RecordBatch.from_pydict({"k": pa.array([k for _, k in rows[at : at + n]], pa.int64()), "i": pa.array([i for i, _ in rows[at : at + n]], pa.int64())}))
                at += n
            seen, cut = [], collections.Counter()

            def take(part, seen=seen):
                runs = _io.runs(part.column("k").to_numpy())
                seen += [("run", tuple(part.column("i").to_pylist()[a:b])) for a, b in runs]
                return iter(())

            def spill(part, seen=seen, cut=cut):
                assert len(set(part.column("k").to_pylist())) == 1
                seen.append(("part", tuple(part.column("i").to_pylist())))
                cut[part.column("k")[0].as_py()] += part.num_rows
                return iter(())

            list(_io.whole(iter(batches), ["k"], take, least=r.randint(1, 9), spill=spill if most else None, most=most))
            assert sorted(i for _, t in seen for i in t) == list(range(len(rows)))
            counts = collections.Counter(keys)
            assert all(cut[k] in (0, n) for k, n in counts.items()) and all(cut[k] > most for k in cut)
            assert len([1 for kind, _ in seen if kind == "run"]) == len([k for k in counts if not cut[k]])
