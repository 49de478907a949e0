"""Behaviour that SQL doesn't show: refusals, edge rows, state."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators import aggregates, filters, graph, lifecycle, linking, search, tables, temporal, windows
from quern.plans.execute import execute, report
from quern.plans.validate import InvalidPlan, validate
from quern.sources import extract, readers
from quern.streaming import jobs
from quern.types import ColumnSpec, TableError, TableSchema, decode, parse_duration, parse_money

LEASES = TableSchema("leases", (ColumnSpec("id", primary=True), ColumnSpec("tenant"), ColumnSpec("rent", "integer"), ColumnSpec("due", "money"), ColumnSpec("_valid_from", "datetime"), ColumnSpec("_valid_to", "datetime")))


@pytest.fixture
def leases(spark):
    d = lambda y: datetime.datetime(y, 1, 1)
    rows = [("a", "x", 10, ("10.50", "EUR"), d(2020), d(2021)), ("b", "x", 20, ("1.25", "EUR"), d(2021), None), ("c", "y", None, ("3", "USD"), None, None)]
    df = spark.createDataFrame([(i, t, r, m[0], m[1], f, u) for i, t, r, m, f, u in rows], "id string, tenant string, rent long, amount string, currency string, _valid_from timestamp, _valid_to timestamp")
    return df.withColumn("due", parse_money(F.col("amount"), F.col("currency"))).drop("amount", "currency")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


@pytest.mark.parametrize(("tree", "scope"), [(None, "ALL"), ({}, "ALL"), ({"eq": {"a": 1}}, "SCOPED"), ({"in": {"a": []}}, "NONE"), ({"not": {}}, "NONE"), ({"and": []}, "INVALID"), ({"or": [{}, {"eq": {"a": 1}}]}, "ALL"), ({"and": [{"in": {"a": []}}, {"eq": {"a": 1}}]}, "NONE"), ({"contains": {"a": " "}}, "ALL")])
def test_scope(tree, scope):
    assert filters.scope(tree) == scope


def test_filters_refuse_depth_and_empty_branches(spark):
    tree = {"eq": {"a": 1}}
    for _ in range(9):
        tree = {"not": tree}
    with pytest.raises(TableError, match="filter_too_nested"):
        filters.compile_filter(tree)
    with pytest.raises(TableError, match="empty_branch"):
        filters.compile_filter({"or": []})


def test_like_wildcards_are_plain_text(spark):
    df = spark.createDataFrame([("50%_\\off",), ("50 off",), (None,)], "t string")
    assert df.where(filters.compile_filter({"contains": {"t": "%_\\"}})).count() == 1


@pytest.mark.parametrize(
    ("steps", "code"),
    [
        ([], "invalid_plan"),
        ([{"op": "order", "by": [{"alias": "leases", "field": "id"}]}], "no_source"),
        ([{"op": "filter", "type": "nope"}], "unknown_type"),
        ([{"op": "filter", "type": "leases", "where": [{"field": "rent", "op": "contains", "value": "1"}]}], "type_mismatch"),
        ([{"op": "filter", "type": "leases", "where": [{"field": "rent", "op": "eq", "value": 2**63}]}], "bad_value"),
        ([{"op": "filter", "type": "leases"}, {"op": "limit", "n": 1}, {"op": "limit", "n": 1}], "bad_order"),
        ([{"op": "judge"}], "not_supported_yet"),
        ([{"op": "filter", "type": "leases"}] * 13, "step_cap"),
        ([{"op": "filter", "type": "leases", "x": 1}], "unknown_property"),
        ([{"op": "filter", "type": "leases"}, {"op": "aggregate", "measures": [{"fn": "sum", "as": "s", "alias": "leases", "field": "tenant"}]}], "type_mismatch"),
    ],
)
def test_plans_are_refused(steps, code):
    with pytest.raises(InvalidPlan) as e:
        validate({"steps": steps}, {"leases": LEASES})
    assert code in {i.code for i in e.value.issues}


def run(leases, *steps):
    return execute({"steps": list(steps)}, {"leases": leases}, {"leases": LEASES})


def test_as_of_is_half_open(leases):
    at = lambda day: ids(run(leases, {"op": "filter", "type": "leases"}, {"op": "as_of", "date": day}), "leases.id")
    assert at("2020-12-31") == ["a", "c"]
    assert at("2021-01-01") == ["b", "c"]


def test_nulls_sort_first_up_and_last_down(leases):
    order = lambda d: [r["leases.id"] for r in run(leases, {"op": "filter", "type": "leases"}, {"op": "order", "by": [{"alias": "leases", "field": "rent", "dir": d}]}).collect()]
    assert order("asc") == ["c", "a", "b"]
    assert order("desc") == ["b", "a", "c"]


def test_money(leases):
    money = {"amount": "1", "currency": "eur"}
    kept = run(leases, {"op": "filter", "type": "leases", "where": [{"field": "due", "op": "gt", "value": money}]})
    assert ids(kept, "leases.id") == ["a", "b"]
    total = {"op": "aggregate", "measures": [{"fn": "sum", "as": "s", "alias": "leases", "field": "due"}]}
    assert str(run(leases, {"op": "filter", "type": "leases", "where": [{"field": "due", "op": "gt", "value": money}]}, total).first()["s"]["amount"]).rstrip("0") == "11.75"
    with pytest.raises(Exception, match="mixed_currency"):
        run(leases, {"op": "filter", "type": "leases"}, total).collect()
    with pytest.raises(Exception, match="mixed_currency"):
        aggregates.money(leases, "sum", "due").collect()


def test_report_caps(leases):
    plan = {"steps": [{"op": "filter", "type": "leases"}]}
    assert report(plan, {"leases": leases}, {"leases": LEASES})["row_count"] == 3
    assert report(plan, {"leases": leases}, {"leases": LEASES}, a_step=2)["status"] == "capped"


def test_store(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "s"))
    schema = TableSchema("t", (ColumnSpec("id", primary=True), ColumnSpec("n", "integer", required=True), ColumnSpec("j", "json", extracted=(("k", "integer"),))))
    store.create(schema)
    store.create(schema)
    store.insert("t", [{"id": "a", "n": 1, "j": '{"k": 5}'}, {"id": "b", "n": 2}])
    assert store.query("t", {"eq": {"j__k": 5}}).count() == 1
    with pytest.raises(TableError, match="duplicate_key"):
        store.insert("t", [{"id": "c", "n": 1}, {"id": "a", "n": 1}])
    with pytest.raises(TableError, match="unknown_column"):
        store.insert("t", [{"id": "d", "x": 1}])
    with pytest.raises(TableError, match="invalid_row"):
        store.insert("t", [{"id": "d", "n": None}])
    with pytest.raises(TableError, match="all_rows"):
        store.delete("t", {})
    assert ids(store.read("t")) == ["a", "b"]
    store.upsert("t", [{"id": "b", "n": 7}, {"id": "e", "n": 9}])
    assert {r["id"]: r["n"] for r in store.read("t").collect()} == {"a": 1, "b": 7, "e": 9}
    wider = TableSchema("t", (*schema.columns, ColumnSpec("m", "integer", required=True)))
    assert store.evolve(wider) == [("add_column", "m")]
    assert {r["m"] for r in store.read("t").collect()} == {0}
    with pytest.raises(TableError, match="drop_column"):
        store.evolve(schema)
    assert store.list(counts=True) == [{"name": "t", "columns": 4, "rows": 3}]
    assert store.truncate("t") == 3


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert tables.digest(a).first() == tables.digest(a.orderBy(F.col("i").desc())).first()
    assert tables.digest(a).first() != tables.digest(a.limit(1)).first()


def test_decode(spark):
    cases = [("integer", "12", 12), ("integer", "1.5", None), ("float", "1e3", 1000.0), ("boolean", "Yes", True), ("boolean", "maybe", None), ("date", "2020-02-30", None), ("date", "2020-02-29", datetime.date(2020, 2, 29))]
    for kind, text, want in cases:
        assert spark.createDataFrame([(text,)], "t string").select(decode(F.col("t"), kind).alias("v")).first()["v"] == want
    assert parse_duration("7d") == 7 * 86_400


def test_bfs_first_reach(spark):
    edges = spark.createDataFrame([("a", "b", "z"), ("a", "c", "m"), ("d", "a", "k"), ("c", "b", "a"), ("b", "e", "r"), ("c", "e", "q")], "src string, dst string, relation string")
    seeds = spark.createDataFrame([("a",)], "id string")
    got = {r["id"]: (r["depth"], r["relation"], r["via"]) for r in graph.traverse(edges, seeds, 3).collect()}
    assert got == {"b": (1, "z", "a"), "c": (1, "m", "a"), "d": (1, "k", "a"), "e": (2, "q", "c")}
    assert ids(graph.traverse(edges, seeds, 3, node_cap=2)) == ["b", "c"]


def test_chain_is_cycle_safe_and_supersede_refuses_cycles(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "id string, superseded_by string").withColumns({"superseded_at": F.lit(None).cast("timestamp"), "superseded_reason": F.lit(None).cast("string")})
    links = nodes.select("id", F.col("superseded_by").alias("next"))
    assert [(r["id"], r["hop"]) for r in graph.chain(links, nodes.where("id = 'a'").select("id")).orderBy("hop").collect()] == [("a", 0), ("b", 1)]
    with pytest.raises(ValueError, match="cycle"):
        graph.supersede(nodes, "a", "b", "x", F.current_timestamp())


def test_cap_links(spark):
    edges = spark.createDataFrame([("a", x, s) for x, s in (("b", 0.9), ("c", 0.8), ("d", 0.7))], "src string, dst string, score double")
    kept, gone = windows.cap_links(edges, 2)
    assert ids(kept, "dst") == ["b", "c"] and ids(gone, "dst") == ["d"]


def test_hash_chain(spark):
    import hashlib

    rows, before = [], ""
    for i in range(4):
        code = hashlib.sha256((before + f"p{i}").encode()).hexdigest()
        rows.append((i, f"p{i}", before, code))
        before = code
    log = spark.createDataFrame(rows, "n int, payload string, previous string, hash string")
    assert windows.verify_chain(log, "n", "payload", "hash", "previous").count() == 0
    assert ids(windows.verify_chain(log.withColumn("payload", F.when(F.col("n") == 2, "x").otherwise(F.col("payload"))), "n", "payload", "hash", "previous"), "n") == [2]


def test_merge_policies(spark):
    rows = [("k", 1, "a", None, ["x"]), ("k", 2, None, " ", ["y", "x"]), ("k", 3, "c", "f", ["z"])]
    df = spark.createDataFrame(rows, "id string, at int, v string, f string, tags array<string>")
    got = linking.merge_records(df, "id", "at", {"v": "oldest-wins", "f": "first-non-null", "tags": "append"}).first()
    assert (got["v"], got["f"], got["tags"], got["records"]) == ("a", "f", ["x", "y", "z"], 3)


def test_lww_ties_and_deletes(spark):
    rows = [("n", "f", "1", 5, 1, "a"), ("n", "f", "2", 5, 1, "b"), ("n", "g", "3", 1, 1, "a"), ("n", "__delete", None, 2, 1, "a")]
    changes = spark.createDataFrame(rows, "node_id string, field string, value string, wall_clock_ms long, lamport long, device_id string")
    assert [(r["field"], r["value"]) for r in linking.lww(changes).collect()] == [("f", "2")]


def test_abstention(spark):
    calibration = spark.createDataFrame([(0.5, 0.1, "ready")], "median double, scale double, status string")
    best = spark.createDataFrame([("far", 0.99, 0.0, False), ("weak", 0.6, 1.0, False), ("rescued", 0.6, 1.0, True), ("uncovered", 0.8, 0.0, False)], "query string, score double, coverage double, exact_identifier boolean")
    assert {r["query"]: r["abstain"] for r in search.abstain(best, calibration).collect()} == {"far": False, "weak": True, "rescued": False, "uncovered": True}


def test_temporal_conditions(spark):
    current = spark.createDataFrame([("a", 3, "x")], "id string, revision int, v string")
    writes = spark.createDataFrame([("a", "y", False, 3), ("b", "z", True, None)], "id string, v string, if_absent boolean, if_revision int")
    out = {r["id"]: (r["revision"], r["v"]) for r in temporal.commit_batch(writes, current).collect()}
    assert out == {"a": (4, "y"), "b": (1, "z")}
    with pytest.raises(ValueError, match="revision"):
        temporal.commit_batch(writes.withColumn("if_revision", F.lit(2)), current)


def test_scalars(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c.alias("v")).first()["v"]
    assert one(S.alias_normalise(F.col("t")), t="O'Neil  &Sons, Ltd.") == "oneil sons ltd"
    assert one(S.alias_normalise(F.col("t"), compatibility=True), t="ＡＢＣ①") == "abc1"
    assert one(S.sanitise_identifier(F.col("t")), t=" 2 a-b ") == "_2_a_b"
    assert [one(S.light_stem(F.col("t")), t=w) for w in ("ponies", "expired", "class", "jobs", "expire")] == ["pony", "expir", "class", "job", "expir"]
    assert one(S.has_token(F.col("t"), "api.v2"), t="use api.v2 now") and not one(S.has_token(F.col("t"), "api"), t="rapid")
    assert one(S.cap_text(F.col("t"), 5, "…"), t="ééé") == "éé…"
    assert one(S.canonical_json(F.col("t")), t='{"b": 1, "a": [2]}') == '{"a":[2],"b":1}'
    assert one(S.glob_match(F.col("t"), ["tmp-*"]), t="TMP-1") and not one(S.glob_match(F.col("t"), ["tmp"]), t="tmp-1")
    assert one(S.detect_language(F.col("t"))["language"], t="der die das und ist nicht ein haus mit dem") == "de"
    assert one(S.trigrams(F.col("t")), t="abcab") == ["abc", "bca", "cab"]
    assert S.keyword_terms("What is the Fox-Trot of a fox?") == ["fox", "trot"]


def test_extraction(spark):
    html = "<p>a &amp;lt;b</p><script>x</script><table><tr><th>h</th></tr><tr><td>1<td>2</td></tr></table>"
    df = spark.createDataFrame([(1, html)], "id long, html string")
    assert "x" not in df.select(extract.html_text(F.col("html"))).first()[0].split()
    assert extract.html_tables(df, "id", "html").first()["headers"] == ["h"]
    pages = spark.createDataFrame([("intro\nPage_Number: 3\nbody\n",)], "t string").select(extract.pages(F.col("t")).alias("p")).first()["p"]
    assert [(p["page"], p["text"]) for p in pages] == [(0, "intro"), (3, "body")]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>hello</w:t></w:p></w:d>')
    media = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    docs = spark.createDataFrame([(1, media, data.getvalue()), (2, media, b"broken"), (3, "x/y", b"")], "id long, media_type string, content binary")
    got = {r["id"]: (r["text"], r["error"]) for r in extract.extract(docs).collect()}
    assert got == {1: ("hello", None), 2: (None, "broken: BadZipFile"), 3: (None, "unsupported: x/y")}


def test_laid_out_tables(spark):
    items = spark.createDataFrame([("d", 1, float(x), float(y), 10.0, 8.0, f"c{x}{y}") for y in (10, 20, 30) for x in (0, 100)], "doc string, page int, x double, y double, width double, height double, text string")
    assert extract.laid_out_tables(items).first().asDict() == {"doc": "d", "page": 1, "rows": 3, "columns": 2, "confidence": 1.0}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\nbroken\n{"id": "3"}\n')
    rows, bad = readers.jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int")
    assert ids(rows) == ["1", "3"] and bad.first()["line"] == "broken"
    (tmp_path / "b.csv").write_text('id,text,x\n1,"a ""q"", b",7\n')
    assert readers.csv(spark, str(tmp_path / "b.csv")).first()["text"] == 'a "q", b'
    df = spark.createDataFrame([("1", "2020-01-01", "x", ""), ("2", "", "y", None)], "`a b` string, d string, `a-b` string, e string")
    schema = readers.infer_schema(df, "t")
    assert [(c.name, c.kind) for c in schema.columns[4:]] == [("a_b", "integer"), ("d", "date"), ("a_b_2", "string"), ("e", "string")]
    raw = readers.coerce(spark.createDataFrame([("x",), ("4",), (" ",)], "n string"), {"n": "integer"})
    assert [(r["n"], r["n_raw"]) for r in raw.collect()] == [(None, "x"), (4, None), (None, None)]


def test_stream_outbox_and_dead_letters(spark, tmp_path):
    rows = [("1", "w", "stream.event", '{"a":1}', datetime.datetime(2024, 1, 1)), (None, "w", "stream.event", "{}", datetime.datetime(2024, 1, 1)), ("3", "w", "stream.event", "nope", datetime.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, jobs.EVENT).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        jobs.run(jobs.files(spark, str(tmp_path / "in"), jobs.EVENT), jobs.outbox(str(tmp_path / "out")), str(tmp_path / "state"))
    assert ids(spark.read.parquet(str(tmp_path / "out/events"))) == ["1"]
    assert sorted(r["error"] for r in spark.read.parquet(str(tmp_path / "out/dead")).collect()) == ["bad_payload", "missing_id"]


def test_lifecycle(spark):
    now = F.lit("2024-05-01").cast("timestamp")
    nodes = spark.createDataFrame([("a", ["pinned"], None, "2023-01-01"), ("b", [], None, "2023-01-01"), ("c", [], "2024-04-30", "2023-01-01")], "id string, tags array<string>, last_retrieved_at string, updated_at string").withColumns({"status": F.lit("active"), "legal_hold": F.lit(False)})
    assert ids(lifecycle.cold_nodes(nodes, now)) == ["b"]
    assert lifecycle.decompose({"kind": "rename", "field": "a", "to": "b"})[-1] == {"phase": "contract", "do": "drop a"}
    assert lifecycle.budget_bytes(10 << 40) == 50 << 30


@pytest.fixture(scope="module")
def memory(spark):
    rows = [("n1", "the gateway retries twice before it fails", "decision", "n2"), ("n2", "the gateway retries three times before it fails", "decision", None), ("n3", "lunch is at noon", "note", None), ("n4", "gateway timeouts are logged", "note", None)]
    nodes = spark.createDataFrame(rows, "id string, text string, type string, superseded_by string").withColumns({"updated_at": F.lit("2024-01-01").cast("timestamp"), "curated": F.lit(False)})
    edges = spark.createDataFrame([("n2", "n3", "mentions", None), ("n3", "n4", "mentions", None)], "src string, dst string, relation string, valid_to timestamp")
    return nodes, edges


def test_recall_replaces_superseded_and_finds_neighbours(spark, memory):
    from quern.operators import recall

    nodes, edges = memory
    asked = spark.createDataFrame([("q", "gateway retries")], "query string, text string")
    hits, near = recall.recall(nodes, asked, 3, edges=edges, today=F.lit("2024-02-01").cast("timestamp"))
    found = [r["id"] for r in hits.orderBy("rank").collect()]
    assert found[0] == "n2" and "n1" not in found and "n3" not in found
    assert ids(near) == ["n3"]
    text = recall.context(hits, nodes.select("id", "text")).first()["context"]
    assert text.startswith("- the gateway retries three")
    shown = recall.render(recall.report(nodes, edges), "html")
    assert "<h2>hubs</h2>" in shown and "n3" in recall.render({"hubs": graph.top_hubs(edges)})


def test_engine(spark, memory, tmp_path):
    from quern.api import Engine
    from quern.operators.joins import Hop

    nodes, edges = memory
    e = Engine(spark, str(tmp_path), nodes.withColumns({"label": F.col("text"), "content": F.col("text"), "tags": F.array().cast("array<string>")}), edges, nodes.select("id", "text"))
    e.create(TableSchema("a", (ColumnSpec("id", primary=True), ColumnSpec("n", "integer"), ColumnSpec("at", "datetime"))))
    e.create(TableSchema("b", (ColumnSpec("id", primary=True), ColumnSpec("a_id"))))
    e.insert("a", [{"id": "x", "n": 1, "at": datetime.datetime(2024, 1, 2)}, {"id": "y", "n": 5, "at": datetime.datetime(2024, 2, 2)}])
    e.insert("b", [{"id": "1", "a_id": "x"}, {"id": "2", "a_id": "x"}])
    assert e.aggregate("a", "sum", "n").first()["value"] == 6.0
    assert [r["bucket"] for r in e.time_series("a", "at", "month", "count").collect()] == ["2024-01", "2024-02"]
    assert e.join("a", [Hop("b", "id", "a_id")]).count() == 2
    plan = {"steps": [{"op": "filter", "type": "a", "where": [{"field": "n", "op": "gt", "value": 1}]}]}
    assert e.plan(plan).count() == 1 and e.plan_report(plan)["status"] == "ok"
    assert e.update_by_query("a", {"eq": {"id": "x"}}, {"n": 9}) == 1 and e.delete_by_query("a", {"gt": {"n": 8}}) == 1
    assert ids(e.traverse(["n2"], 2)) == ["n3", "n4"]
    assert ids(e.search("gateway timeouts")) == ["n4"]
    assert ids(e.search_texts("lunch noon")) == ["n3"]


def test_verbatim_view_keeps_the_last_live_row(spark):
    from quern.operators import recall

    rows = [("a", 1, "old", False), ("a", 2, "new", False), ("b", 1, "gone", False), ("b", 2, None, True)]
    live = recall.canonical(spark.createDataFrame(rows, "id string, version int, text string, is_tombstone boolean"))
    assert [(r["id"], r["text"]) for r in live.collect()] == [("a", "new")]
