"""Small fixtures for operators that no registered query exercises."""

import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators import aggregates, filters, graph, joins, lifecycle, linking, recall, search, tables, temporal
from quern.plans.execute import execute, unreviewed
from quern.queries import QUERIES
from quern.sources import readers
from quern.streaming import jobs
from quern.types import ColumnSpec, TableSchema


def now():
    return F.lit("2024-06-01").cast("timestamp")


def rows(df, *columns):
    columns = columns or df.columns
    return sorted((tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()), key=str)


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_capture(spark):
    df = spark.createDataFrame([("We decided to always retry the gateway three times before failing",), ("thanks, I remember that we must always do what we decided",), ("Should we always retry before we fail or decide something?",), (None,)], "t string")
    assert [r["v"] for r in df.select(search.capture(F.col("t")).alias("v")).collect()] == [True, False, False, False]


def test_bulk_limits(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    store.create(TableSchema("t", (ColumnSpec("id", primary=True),)))
    with pytest.raises(tables.TableError, match="bulk_limit"):
        store.bulk_insert("t", [{"id": str(i)} for i in range(1001)])
    assert store.bulk_insert("t", [{"id": "a"}]) == 1


def test_reject_reasons(spark):
    df = spark.createDataFrame([("1", "w", "graph.node", None, None, None), (None, "w", "graph.node", None, None, None), ("2", "x", "vector", None, None, None), (None, "w", "graph.edge", "a", "b", None), (None, "w", "graph.edge", "a", "b", "r")], "id string, workspace string, target string, source_id string, target_id string, relation string")
    assert [r["v"] for r in df.select(readers.reject_reason(df, "w").alias("v")).collect()] == [None, "missing_id", "workspace_mismatch", "edge_incomplete", None]


def test_union_schema():
    a = TableSchema("t", (ColumnSpec("id", primary=True), ColumnSpec("x")))
    b = TableSchema("t", (ColumnSpec("id", primary=True), ColumnSpec("x", "integer"), ColumnSpec("y")))
    assert [(c.name, c.kind) for c in tables.union_schema(a, b).columns] == [("id", "string"), ("x", "string"), ("y", "string")]


def test_files_archive_and_backup(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    (tmp_path / "in" / "b.txt").write_text("x")
    found = readers.files(spark, str(tmp_path / "in"), "*.txt", contents=True)
    kept = readers.archive(found, str(tmp_path / "store"))
    assert len(set(rows(kept, "source_ref"))) == 1 and spark.read.parquet(str(tmp_path / "store")).count() == 1
    readers.backup({"a": spark.range(5), "b": spark.range(3)}, str(tmp_path / "bundle"))
    assert rows(readers.verify_backup(spark, str(tmp_path / "bundle")), "ok") == [True, True]
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "bundle" / "b"))
    assert rows(readers.verify_backup(spark, str(tmp_path / "bundle")), "table", "ok") == [("a", True), ("b", False)]


def test_structured_items_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("j1", '[{"a": 1, "b": "x"}, {"a": 2.5}]'), ("j2", "[]")], "job_id string, result string")
    items = readers.structured_items(df)
    assert rows(items, "job_id", "item", "key", "kind") == [("j1", 0, "a", "integer"), ("j1", 0, "b", "string"), ("j1", 1, "a", "float")]
    for _ in range(2):
        readers.write_structured(items, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_json_arrays(spark):
    df = spark.createDataFrame([('{"topics": ["a", "b"]}',), ('{"topics": ["a"]}',), ("{}",), (None,)], "m string")
    assert [r["v"] for r in df.select(filters.json_has_all(F.col("m"), "$.topics", ["a", "b"]).alias("v")).collect()] == [True, False, False, False]
    assert df.select(S.json_list(F.col("m"), "$.topics").alias("v")).first()["v"] == ["a", "b"]


def test_rows_with_nodes(spark):
    t = spark.createDataFrame([("1", "n1"), ("2", None)], "id string, _memory_node_id string")
    n = spark.createDataFrame([("n1", "L")], "id string, label string")
    assert rows(joins.with_nodes(t, n, "left"), "id", "node.label") == [("1", "L"), ("2", None)]


def test_links_in_time(spark):
    links = spark.createDataFrame([("a", "b", day(0), day(10)), ("a", "c", day(5), None), ("d", "a", None, None)], "from_id string, to_id string, valid_from timestamp, valid_to timestamp")
    at = F.lit(day(10))
    assert rows(joins.current_links(links, at), "from_id", "to_id") == [("a", "c"), ("d", "a")]
    assert joins.list_links(links, "a", "out").count() == 2 and joins.list_links(links, "a").count() == 3


def test_spellings(spark):
    values = spark.createDataFrame([("ACME Ltd.",), ("acme, ltd",), ("Acme Limited",), ("Other",)], "name string")
    aliases = spark.createDataFrame([("acme ltd", "acme"), ("acme limited", "acme")], "normalised string, canonical string")
    assert rows(joins.spellings(values, "name", aliases, ["acme ltd"], S.alias_normalise)) == ["ACME Ltd.", "Acme Limited", "acme, ltd"]
    assert rows(aggregates.unresolved(values, "name", aliases, S.alias_normalise), "normalised", "rows", "example") == [("other", 1, "Other")]


def test_plan_groups_widen_equality(spark):
    schema = TableSchema("t", (ColumnSpec("id", primary=True), ColumnSpec("name")))
    df = spark.createDataFrame([("1", "ACME"), ("2", "Acme Ltd"), ("3", "Other")], "id string, name string")
    plan = {"steps": [{"op": "filter", "type": "t", "where": [{"field": "name", "op": "eq", "value": "ACME"}]}]}
    out = execute(plan, {"t": df}, {"t": schema}, groups={"t.name": {"ACME": ["ACME", "Acme Ltd"]}})
    assert rows(out, "t.id") == ["1", "2"]


def test_unreviewed(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    values = spark.createDataFrame([("a", False, 0.5), ("b", True, 0.9), ("c", False, 0.9)], "entity string, needs_review boolean, confidence double")
    assert rows(unreviewed(t, values, "id", 0.7), "id", "unreviewed") == [("a", True), ("b", True), ("c", False)]


def test_visible_count(spark):
    out = aggregates.visible_count(spark.range(50), F.col("id") % 2 == 0, 20).first()
    assert out["lower_bound"] and out["visible"] <= 20
    with pytest.raises(tables.TableError, match="scan_cap"):
        aggregates.check_scan(spark.range(50), 20)
    assert aggregates.group_limit(None) == (10_000, True) and aggregates.group_limit(5) == (5, False)


def test_groups_are_all_kept_without_a_limit(spark):
    df = spark.range(10_050).select(F.col("id").alias("k"))
    assert aggregates.group_by(df, "k", "count").count() == aggregates.distinct_values(df, "k").count() == 10_050
    assert aggregates.group_by(df, "k", "count", limit=10_020).count() == 10_020 and aggregates.distinct_values(df, "k", limit=3).count() == 3


def test_token_budget_covers_many_short_rows(spark, sf, tmp_path):
    texts = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text")).repartition(7)
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["token_budget"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(900)) and all(r["tokens"] == 1 for r in got)


@pytest.fixture(scope="module")
def net(spark):
    nodes = spark.createDataFrame([("a", "t1", "p"), ("b", "t1", "p"), ("c", "t2", "q"), ("d", "note", "q")], "id string, type string, project string").withColumns({"label": F.col("id"), "status": F.lit("active"), "stale": F.lit(False), "tags": F.array(F.lit("x"))})
    edges = spark.createDataFrame([("a", "b", "r", 0.9, None), ("b", "c", "inferred_r", 0.5, None), ("a", "c", "r", 0.3, day(1))], "src string, dst string, relation string, score double, valid_to timestamp")
    return nodes, edges


def test_graph_reads(spark, net):
    nodes, edges = net
    one = graph.link_stats(edges, 1).first()
    assert (one["live"], one["invalidated"], one["max_degree"], one["nodes_over_cap"]) == (2, 1, 2, 1) and one["mean_strength"] == pytest.approx(0.7)
    assert rows(graph.query_edges(edges, source="a"), "dst") == ["b"] and graph.query_edges(edges, source="a", include_dead=True).count() == 2
    assert rows(graph.query_edges(edges, after=("a", "b", "r")), "src") == ["b"]
    assert rows(graph.topology_sample(nodes, edges, 2)[1], "src", "dst") == [("a", "b")]
    walled = graph.traverse(edges, spark.createDataFrame([("a",)], "id string"), 3, allowed=nodes.where("project = 'p'"))
    assert rows(walled, "id") == ["b"]
    assert rows(graph.blast_radius(nodes, edges, ["t1"], ["r"])) == [("edge", "r", 1), ("node", "t1", 2)]
    assert rows(joins.endpoints(edges, nodes, ["type"]), "src_type", "dst_type")[0] == ("t1", "t1")
    assert rows(graph.lineage(nodes.withColumn("superseded_by", F.when(F.col("id") == "a", "b")), spark.createDataFrame([("b",)], "id string")), "id", "direction") == [("a", "back"), ("b", "forward")]


def test_graph_writes(spark, net):
    nodes, edges = net
    assert rows(graph.prune_inferred(edges), "relation") == ["r", "r"]
    n, e = graph.delete_nodes(nodes, edges, spark.createDataFrame([("b",)], "id string"))
    assert rows(n, "id") == ["a", "c", "d"] and rows(e, "src", "dst") == [("a", "c")]
    assert rows(graph.mark_stale(nodes, F.array_contains("tags", "x")).where("stale"), "id") == ["a", "b", "c", "d"]
    assert rows(graph.archive(nodes, F.col("id") == "a").where("status = 'archived'"), "id") == ["a"]


def test_corpus_health(spark):
    df = spark.createDataFrame([("active", None, True, False, 0.5), (None, "tactical", False, True, 0.0)], "status string, classification string, stale boolean, anchor_stale boolean, confirmation_score double")
    one = aggregates.corpus_health(df).first()
    assert (one["nodes"], one["status_active"], one["classification_tactical"], one["stale"], one["anchor_stale"], one["mean_confirmation"]) == (2, 2, 2, 1, 1, 0.5)


def test_more_scalars(spark):
    df = spark.createDataFrame([(" A, b,,A ", "see #12 in foo_bar.baz and getUserName or x1y2z3", 2, 1, 1, 0.5)], "tags string, t string, s int, f int, p int, c double")
    one = df.select(S.tags_to_array(F.col("tags")).alias("tags"), S.identifier_tokens(F.col("t")).alias("ids"), S.strong_identifier(F.lit("foo_bar")).alias("yes"), S.strong_identifier(F.lit("word")).alias("no"), S.outcome_weight(F.col("s"), F.col("f"), F.col("p"), F.col("c")).alias("w"), S.tags_to_text(F.array(F.lit("a"), F.lit("b"))).alias("csv"), S.cjk_share(F.lit("漢字ab")).alias("cjk"), S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("cos")).first()
    assert one["tags"] == ["a", "b"] and one["csv"] == "a,b" and one["yes"] and not one["no"] and one["cjk"] == 0.5
    assert {"#12", "getUserName", "x1y2z3"} <= set(one["ids"])
    assert one["w"] == pytest.approx(1 + 0.5 * 0.25 * 0.8 + 0.2 * 0.5 * 0.8) and one["cos"] == pytest.approx(2**-0.5)


def hits(spark, *found):
    return spark.createDataFrame([("q", i, n + 1, s) for n, (i, s) in enumerate(found)], "query string, id string, rank int, score double")


def test_retrieval_steps(spark):
    h = hits(spark, ("a", 0.9), ("b", 0.8), ("c", 0.7))
    texts = spark.createDataFrame([("a", "plain words"), ("b", "has err_42 inside"), ("c", "more words")], "id string, text string")
    assert [r["id"] for r in search.pin_identifiers(h, texts, ["err_42"]).collect()] == ["b", "a", "c"]
    assert rows(search.term_coverage(h, texts, {"words": 1.0, "zebra": 1.0}), "coverage") == [0.5]
    assert rows(search.refill(h.where("rank <= 1"), h, 2), "id") == ["a", "b"]
    fixed = search.after_corrections(h, spark.createDataFrame([("c", "a"), ("b", "z")], "id string, target string"))
    assert [r["id"] for r in fixed.orderBy("rank").collect()] == ["b", "z", "c", "a"]
    shown = {r["id"]: (r["confidence"], r["body"]) for r in search.present(h, texts).collect()}
    assert shown == {"a": (1.0, "plain words"), "b": (0.7, None), "c": (0.7, None)}
    again = search.rerank(h, texts, lambda q, piece: F.when(piece.contains("err"), 9.0).otherwise(0.0))
    assert [r["id"] for r in again.orderBy("rank").collect()] == ["b", "a", "c"]
    both = recall.seed_union(hits(spark, ("a", 0.9)), hits(spark, ("b", 0.95), ("a", 0.1)), 2)
    assert [r["id"] for r in both.orderBy("rank").collect()] == ["b", "a"]
    assert rows(recall.expand(texts, ["a", "c"]), "id") == ["a", "c"]


def test_multi_query_and_pieces(spark):
    seeds = spark.createDataFrame([("q", "p0", "bm25", "a", 1), ("q", "p1", "bm25", "a#q2", 1), ("q", "p0", "bm25", "b", 2)], "query string, phrasing string, leg string, id string, rank int")
    assert [(r["id"], r["rank"]) for r in search.multi_query(seeds, None, 5).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    docs = spark.createDataFrame([("d", "T", "x" * 500)], "id string, title string, text string")
    assert rows(search.pieces(docs, title="title"), "id") == ["d#p0", "d#p1", "d#p2"]
    best = search.best_piece(spark.createDataFrame([("q", "d#p1", 0.2), ("q", "d#p2", 0.6), ("q", "e#p1", 0.5)], "query string, id string, score double"), 5)
    assert [(r["id"], r["score"]) for r in best.orderBy("rank").collect()] == [("d", 0.6), ("e", 0.5)]


def test_cross_workspace_and_short_tokens(spark):
    df = spark.createDataFrame([("w1", "q", "a", 0.5), ("w2", "q", "a", 0.9), ("w3", "q", "z", 1.0)], "workspace string, query string, id string, score double")
    assert rows(recall.cross_workspace(df, ["w1", "w2"], 5), "id", "workspace") == [("a", "w2")]
    docs = spark.createDataFrame([("a", "漢字漢字"), ("b", "漢 only"), ("c", "漢字")], "id string, text string")
    assert [(r["id"], r["score"]) for r in search.short_token_search(docs, ["漢", "字"], 5).collect()] == [("a", 1.0), ("c", 0.5)]
    pair = spark.createDataFrame([("retries failed calls", "retried calls fail")], "a string, b string")
    assert pair.select(search.jaccard(F.col("a"), F.col("b")).alias("j")).first()["j"] > 0.3
    deferred = spark.createDataFrame([("1", "deferred-task", ["src/a.py"], ["auth"], day(2)), ("2", "deferred-task", ["doc/x"], ["Billing"], day(1)), ("3", "note", ["src/b"], [], day(0))], "id string, type string, paths array<string>, topics array<string>, created_at timestamp")
    assert [r["id"] for r in search.deferred_matches(deferred, ["src/"], ["bill"]).collect()] == ["2", "1"]
    calibrated = search.calibrate(spark.range(100).select((F.col("id") / 100).alias("score"))).first()
    assert calibrated["status"] == "ready" and search.calibrate(spark.range(3).select(F.lit(0.1).alias("score"))).first()["status"] == "too_few"


def test_versions(spark):
    v = spark.createDataFrame([("n", 1, day(1), "upsert", "A", None, "c1"), ("n", 2, day(2), "upsert", "B", "A", "c2"), ("n", 3, day(3), "upsert", "C", "B", "c2")], "node_id string, version_id int, changed_at timestamp, operation string, state string, previous_state string, changeset string")
    assert rows(temporal.rollback(v, "c2"), "node_id", "state") == [("n", "A")]
    assert rows(lifecycle.drop_old_versions(v, F.lit(day(9)), 7), "version_id") == [2, 3] or rows(lifecycle.drop_old_versions(v, F.lit(day(9)), 7), "version_id") == [3]
    df = spark.createDataFrame([(("x", 1), ("x", 2))], "a struct<v:string,revision:int>, b struct<v:string,revision:int>")
    assert df.select(temporal.same_state("a", "b", ["v", "revision"]).alias("s")).first()["s"]


def test_link_diff_and_types(spark):
    wanted = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("a", "d", 0.85)], "a string, b string, score double")
    existing = spark.createDataFrame([("a", "b", 0.9, "similarity"), ("a", "d", 0.7, "similarity"), ("x", "y", 0.9, "similarity"), ("u", "v", 0.9, "manual")], "a string, b string, score double, origin string")
    assert rows(linking.diff(wanted, existing), "a", "b", "action") == [("a", "b", "unchanged"), ("a", "c", "insert"), ("a", "d", "refresh"), ("u", "v", "kept_foreign"), ("x", "y", "invalidate")]
    nodes = spark.createDataFrame([("a", "decision", day(1)), ("b", "decision", day(2)), ("c", "decision", day(0)), ("d", "note", day(0))], "id string, type string, created_at timestamp")
    typed = linking.type_pairs(wanted.withColumn("score", F.when(F.col("b") == "b", 0.98).otherwise(F.col("score"))), nodes)
    assert rows(typed, "older", "newer", "verdict") == [("a", "b", "supersedes"), ("c", "a", "related_to"), ("d", "a", "related_to")]
    near = wanted.select(F.col("a").alias("query"), F.col("b").alias("id"), "score")
    assert rows(linking.supersession_candidates(near, nodes, ["decision"]), "older", "newer") == [("a", "b"), ("c", "a")]


def test_record_helpers(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, v string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "id string, v string")
    assert rows(linking.ingest(now, new, "id", ["v"]), "id", "outcome") == [("a", "unchanged"), ("b", "merged"), ("c", "created")]
    assert rows(linking.skip_identical(new, now, ["id", "v"]), "id") == ["b", "c"]
    twice = now.unionByName(new)
    assert rows(linking.duplicate_ids(twice, "id", F.col("v")), "id", "differing") == [("a", False), ("b", True)]
    changes = spark.createDataFrame([("n", "f", "1", 5, 1, "a"), ("n", "f", "2", 6, 1, "b")], "node_id string, field string, value string, wall_clock_ms long, lamport long, device_id string")
    assert rows(linking.conflicts(changes), "value", "winner") == [("1", "b")]


def test_lifecycle_rest(spark):
    work = spark.createDataFrame([("tmp-1", "2024-01-01"), ("tmp-2", "2024-05-31"), ("main", "2024-01-01")], "workspace string, last_activity string")
    assert rows(lifecycle.ephemeral_workspaces(work, ["tmp-*"], now()), "workspace") == ["tmp-1"]
    nodes = spark.createDataFrame([("a", day(0), 1000), ("b", day(0), None)], "id string, created_at timestamp, ttl_ms long")
    assert rows(lifecycle.expired(nodes, now()), "id") == ["a"]
    assert rows(lifecycle.sweep(nodes, [(F.col("ttl_ms") > 1, "delete"), (F.lit(True), "archive")]), "id", "action") == [("a", "delete"), ("b", "archive")]
    candidates = spark.createDataFrame([("w", 0.7), ("v", 0.7)], "workspace string, confidence double")
    limits = spark.createDataFrame([("w", 0.6)], "workspace string, threshold double")
    assert rows(lifecycle.promotions(candidates, limits), "workspace", "disposition") == [("v", "queued"), ("w", "applied")]
    anchored = spark.createDataFrame([("a", ["x", "y"])], "id string, anchors array<string>")
    assert rows(lifecycle.anchors(anchored), "anchor") == ["x", "y"]
    aliases = spark.createDataFrame([("a#q1",), ("gone#q2",)], "id string")
    assert rows(lifecycle.orphan_aliases(aliases, nodes), "id") == ["gone#q2"]
    review = spark.createDataFrame([(True, 0.9), (False, 0.2), (None, None)], "needs_review boolean, confidence double")
    assert [r["needs_attention"] for r in lifecycle.flag_review(review, 0.5).collect()] == [True, True, False]
    assert lifecycle.compact(spark.range(100).repartition(8), 1000).rdd.getNumPartitions() == 1


def test_streams_rest(spark, tmp_path):
    batch = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("j", 2, "b")], "key string, seq int, v string")
    assert rows(jobs.latest_per_key(batch, "key", "seq"), "key", "v") == [("j", "b"), ("k", "c")]
    reads = spark.createDataFrame([("a", day(1)), ("a", day(2))], "id string, at timestamp")
    assert rows(jobs.access_stamps(reads), "id", "accesses") == [("a", 2)]
    assert jobs.incremental(reads, "at", "2024-01-03 00:04:00").count() == 1
    reads.write.parquet(str(tmp_path / "in"))
    seen = []
    jobs.mirror(jobs.files(spark, str(tmp_path / "in"), reads.schema), {"one": lambda df: seen.append(df.count()), "two": lambda df: seen.append(df.count())}, str(tmp_path / "c"))
    assert sum(seen) == 4 and len(seen) % 2 == 0
    stream = jobs.deduplicated(jobs.files(spark, str(tmp_path / "in"), reads.schema), "id", "at")
    jobs.run(stream, lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_indexed_vectors_find_nine_of_ten_neighbours(spark):
    import numpy as np

    from quern.operators import search

    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.where("id % 50 = 0").withColumnRenamed("id", "query")
    centres = search.ivf_fit(vectors, 32)
    index = search.ivf_index(vectors, centres)
    assert index.count() == vectors.count()
    exact = {(r["query"], r["id"]) for r in search.knn(vectors, asked, 10).collect()}
    found = {(r["query"], r["id"]) for r in search.ivf_search(index, centres, asked, 10, 20).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    every = {(r["query"], r["id"]) for r in search.ivf_search(index, centres, asked.limit(20), 10, 32).collect()}
    assert every == {p for p in exact if p[0] in {q for q, _ in every}}
    assert search.ivf_fit(vectors.limit(0), 4).shape == (0, 0) and np.isfinite(centres).all()


def test_embeddings_are_made_in_batches_of_bounded_size(spark):
    from quern.operators import search

    def embedder(texts):
        assert len(texts) <= 3 and (len(texts) == 1 or sum(map(len, texts)) <= 20)
        return [[len(x), 1.0] for x in texts]

    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([1, 5, 30, 2, 2, 2, 2, 0, 19])] + [(9, None)], "id long, text string")
    got = {r["id"]: r["embedding"][0] for r in search.embedded(docs, embedder, 2, rows=3, budget=20).collect()}
    assert got == {0: 1, 1: 5, 2: 30, 3: 2, 4: 2, 5: 2, 6: 2, 7: 0, 8: 19, 9: 0}


def test_slots():
    from quern.streaming.jobs import Slots

    s = Slots(each=2, total=3)
    assert [s.enter("a"), s.enter("a"), s.enter("a"), s.enter("b"), s.enter("c")] == [0, 0, 5, 0, 5]
    s.leave("a")
    assert s.enter("c") == 0 and s.enter("b") == 5


def test_store_refuses_the_second_of_two_writers(spark, tmp_path):
    from quern.operators import tables
    from quern.types import ColumnSpec, TableError, TableSchema

    store = tables.Store(spark, str(tmp_path / "with space"))
    store.create(TableSchema("x", (ColumnSpec("id", "integer", primary=True),)))
    version, schema, _ = store._read_commit("x")
    store.insert("x", [{"id": 1}])
    with pytest.raises(TableError, match="write_conflict"):
        store._commit(version, schema, store.read("x").limit(0))
    assert [r["id"] for r in store.read("x").collect()] == [1]
    with pytest.raises(TableError, match="duplicate_key") as e:
        store.transaction("x", [("insert", [{"id": 2}]), ("insert", [{"id": 1}])])
    assert "failed op 1: insert" in e.value.__notes__
    with pytest.raises(TableError, match="unknown_table"):
        store.read("y")
    assert not [n for n in store.folder.names("x/commits") if n.startswith(".")]


def test_bm25_is_the_same_by_pattern_and_by_words(spark, sf, monkeypatch):
    from quern.operators import search

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    asked = spark.createDataFrame([("q1", "the thing edged"), ("q2", "token onneing")], "query string, text string")
    rows = lambda: [(r["query"], r["id"], round(r["score"], 9)) for r in search.bm25(docs, asked, 20, "doc_id").orderBy("query", "rank").collect()]
    one = rows()
    monkeypatch.setattr(search, "MAX_PATTERN_TERMS", 1)
    assert rows() == one and one


def test_as_of_joins_carry_over_days_and_numbers(spark):
    from quern.operators import joins

    left = spark.createDataFrame([(1, 5.0), (1, 250_000.0), (1, 90_000.0), (2, 7.0), (None, 3.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 90_000.0, "b"), (2, 8.0, "c"), (None, 1.0, "d"), (1, 1.0, "0")], "k int, u double, v string")
    got = {(r["k"], r["t"]): r["v"] for r in joins.as_of_join(left, right, "k", "t", "u", ["v"]).collect()}
    assert got == {(1, 5.0): "a", (1, 90_000.0): "b", (1, 250_000.0): "b", (2, 7.0): None, (None, 3.0): "d"}
