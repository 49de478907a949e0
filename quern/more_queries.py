"""More registered queries: tables and their life, imports, scalars, recall steps, graph writes, merging and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators import aggregates as A
from quern.operators import filters, graph, joins, lifecycle, linking, recall, search, tables, temporal, windows
from quern.queries import _EDGES_SQL, ORACLE_SQL, QUERIES, Tables, _edges, _ids, _nodes, query, ts
from quern.sources import extract, folders, readers
from quern.types import ColumnSpec, TableSchema, decode, parse_boolean, parse_duration

__all__ = ["ORACLE_SQL", "QUERIES"]


def rows(t: Tables, values: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(values, schema)


# --- typed tables ------------------------------------------------------------

CUSTOMER = TableSchema("customer", (ColumnSpec("id", "integer", primary=True), ColumnSpec("name", required=True), ColumnSpec("balance", "float")))


def _store(t: Tables) -> tables.Store:
    store = tables.Store(t.spark, folders.shared(t.spark, "tables"))
    store.create(CUSTOMER)
    store.create(CUSTOMER)  # the same shape again is no error
    store.insert("customer", t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    return store


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def store_insert(t):
    return _store(t).read("customer")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, '' AS tier, CAST(NULL AS DOUBLE) AS score FROM customer")
def store_evolve(t):
    store = _store(t)
    store.evolve(TableSchema("customer", (*CUSTOMER.columns, ColumnSpec("tier", required=True), ColumnSpec("score", "float"))))
    return store.read("customer")


@query("SELECT 'customer' AS name, 3 AS columns, (SELECT count(*) FROM customer) AS rows UNION ALL SELECT 'empty', 1, 0")
def store_list(t):
    store = _store(t)
    store.create(TableSchema("empty", (ColumnSpec("id", primary=True),)))
    return rows(t, [(x["name"], x["columns"], x["rows"]) for x in store.list(counts=True)], "name string, columns int, rows long")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def store_truncate(t):
    """A table emptied, then filled by records; nations are few whatever the scale."""
    store = _store(t)
    store.truncate("customer")
    store.bulk_insert("customer", [{"id": r[0], "name": r[1]} for r in t.nation.select("n_nationkey", "n_name").collect()])
    return store.read("customer").select("id", "name")


@query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey BETWEEN 10 AND 19 THEN 0.0 ELSE c_acctbal END AS balance FROM customer WHERE NOT (c_acctbal < 0 AND NOT c_custkey BETWEEN 10 AND 19)")
def store_update_delete(t):
    store = _store(t)
    store.update("customer", {"gte": {"id": 10}, "lte": {"id": 19}}, {"balance": 0.0})
    store.delete("customer", {"lt": {"balance": 0}})
    return store.read("customer")


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def store_old_version(t):
    store = _store(t)
    before = store.version("customer")
    store.delete("customer", {"gte": {"id": 0}})
    return store.read("customer", before)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'required: name' END AS issue FROM customer")
def row_issues(t):
    given = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("name"))
    return given.select("id", tables.issues(CUSTOMER, given.columns).alias("issue"))


@query("SELECT * FROM (VALUES (0, 'id'), (1, 'name'), (2, 'balance'), (3, 'tier')) v(place, name)")
def schema_union(t):
    new = TableSchema("customer", (ColumnSpec("id", "integer", primary=True), ColumnSpec("name"), ColumnSpec("tier")))
    return rows(t, list(enumerate(c.name for c in tables.union_schema(CUSTOMER, new).columns)), "place int, name string")


# --- reading -----------------------------------------------------------------


def _text_file(t: Tables, name: str, lines: DataFrame) -> str:
    folder = folders.shared(t.spark, name)
    lines.write.text(folder)
    return folder


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 50 <> 0")
def jsonl_rows(t):
    line = F.when(F.col("o_orderkey") % 50 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")))
    found, _ = readers.jsonl(t.spark, _text_file(t, "jsonl", t.orders.select(line.alias("value"))), "o_orderkey long, o_orderstatus string, o_totalprice double")
    return found


@query("SELECT count(*) AS broken FROM orders WHERE o_orderkey % 50 = 0")
def jsonl_broken(t):
    line = F.when(F.col("o_orderkey") % 50 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("o_orderkey")))
    return readers.jsonl(t.spark, _text_file(t, "jsonl", t.orders.select(line.alias("value"))), "o_orderkey long")[1].agg(F.count("*").alias("broken"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 'a \"' || p_name || '\", b' AS text FROM part")
def csv_rows(t):
    folder = folders.shared(t.spark, "csv")
    t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit('a "'), F.col("p_name"), F.lit('", b')).alias("text")).write.option("header", True).option("escape", '"').csv(folder)
    return readers.csv(t.spark, folder).select("id", "text")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'graph.node' WHEN 1 THEN 'graph.edge' WHEN 2 THEN 'vector' WHEN 3 THEN 'verbatim' WHEN 4 THEN 'unknown' ELSE 'vector' END AS target FROM events")
def row_router_targets(t):
    k = F.col("event_id") % 6
    line = F.when(k == 0, F.lit('{"type":"t","label":"l"}')).when(k == 1, F.lit('{"source":"a","to":"b","text":"x"}')).when(k == 2, F.lit('{"vector":[1,2],"text":"x"}')).when(k == 3, F.lit('{"text":"x"}')).when(k == 4, F.lit('{"other":1}')).otherwise(F.lit('{"target":"vector","text":"x"}'))
    return readers.route(t.events.select("event_id", line.alias("json"))).select("event_id", "target")


@query("SELECT * FROM (VALUES ('k', 'integer'), ('price', 'float'), ('day', 'date'), ('at', 'datetime'), ('open', 'boolean'), ('status', 'string'), ('none', 'string')) v(\"column\", kind)")
def type_inference_kinds(t):
    text = t.orders.select(
        F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.when(F.col("o_orderstatus") == "O", "Yes").otherwise("no")).alias("open"), F.col("o_orderstatus").alias("status"), F.lit(" ").alias("none"),
    )
    return readers.infer_kinds(text, text.columns)


@query("SELECT * FROM (VALUES (0, '_row_id', 'string'), (1, '_import_id', 'string'), (2, '_source_file', 'string'), (3, '_source_row', 'integer'), (4, 'a_b', 'integer'), (5, 'a_b_3', 'float'), (6, 'a_b_2', 'string')) v(place, name, kind)")
def schema_inference(t):
    found = t.orders.select(F.col("o_orderkey").cast("string").alias("a b"), F.col("o_totalprice").cast("string").alias("a-b"), F.col("o_orderstatus").alias("a_b_2"))
    return rows(t, [(i, c.name, c.kind) for i, c in enumerate(readers.infer_schema(found, "orders").columns)], "place int, name string, kind string")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'workspace_mismatch' WHEN event_id % 7 = 0 THEN 'missing_id' END AS reason FROM events")
def reject_reasons(t):
    found = t.events.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("id"), F.when(F.col("event_id") % 5 == 0, "other").otherwise("own").alias("workspace"))
    return found.select("event_id", readers.reject_reason(found, "own").alias("reason"))


@query("SELECT n_nationkey AS id, x.page, x.text FROM nation, (VALUES (0, 'intro'), (3, 'first'), (4, 'last')) x(page, text)")
def page_split(t):
    text = F.lit("intro\nPage_Number: 3\n first \nPage_Number: 4\nlast\n")
    return t.nation.select(F.col("n_nationkey").alias("id"), F.inline(extract.pages(text)))


@query("SELECT n_regionkey AS id, 0 AS \"table\", 'Key|Name' AS headers, CAST(n_nationkey AS VARCHAR) || '|' || n_name AS cells FROM nation", name="html_tables")
def html_table_rows(t):
    cells = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td><b>"), F.col("n_name"), F.lit("</b></td></tr>"))
    made = t.nation.groupBy(F.col("n_regionkey").alias("id")).agg(F.concat(F.lit("<p>x</p><table><tr><th>Key</th><th>Name</th></tr>"), F.array_join(F.collect_list(cells), ""), F.lit("</table>")).alias("html"))
    found = extract.html_tables(made, "id", "html")
    return found.select("id", "table", F.array_join("headers", "|").alias("headers"), F.explode("rows").alias("_r")).select("id", "table", "headers", F.array_join("_r", "|").alias("cells"))


# --- scalars -----------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN p_name ELSE substr(p_name, 1, 8) || chr(10) || '[truncated]' END AS text FROM part")
def text_cap(t):
    return t.part.select("p_partkey", S.cap_text(F.col("p_name"), 8).alias("text"))


@query("SELECT o_orderkey, lower(o_orderpriority) || '|' || lower(o_orderstatus) AS tags FROM orders")
def tag_list(t):
    given = F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ,, "), F.col("o_orderstatus"), F.lit(","), F.lower("o_orderstatus"))
    return t.orders.select("o_orderkey", F.array_join(S.tags_to_array(given), "|").alias("tags"))


@query("SELECT o_orderkey, '_' || regexp_replace(o_orderpriority, '[^A-Za-z0-9_]+', '_', 'g') AS name FROM orders")
def identifiers(t):
    return t.orders.select("o_orderkey", S.sanitise_identifier(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("!"))).alias("name"))


@query("SELECT * FROM (VALUES (0, 'store,reports'), (1, 'we,do,it'), (2, '???'), (3, ''), (4, 'longest_1,longest_2'), (5, 'alpha')) v(place, terms)")
def keyword_queries(t):
    asked = ["Where do we store the reports?", "We do it", " ??? ", " ", "an x longest1 longest2", "the ALPHA alpha a"]
    found = [S.keyword_terms(q) for q in asked]
    found[4] = [w.replace("longest", "longest_") for w in found[4]]
    return rows(t, [(i, ",".join(w)) for i, w in enumerate(found)], "place int, terms string")


@query("SELECT c_custkey, 'x-' || CAST(c_custkey AS VARCHAR) || '|src_' || c_mktsegment AS found FROM customer")
def identifier_words(t):
    text = F.concat(F.lit("see x-"), F.col("c_custkey").cast("string"), F.lit(" and src_"), F.col("c_mktsegment"), F.lit(" but not plain words"))
    return t.customer.select("c_custkey", F.array_join(S.identifier_tokens(text), "|").alias("found"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])token([^\\p{L}\\p{N}_]|$)')")
def whole_tokens(t):
    return t.documents.where(S.has_token(F.col("text"), "token")).select("doc_id")


@query("SELECT p_partkey, list_aggregate(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))), 'count') AS n FROM part")
def trigram_counts(t):
    return t.part.select("p_partkey", F.size(S.trigrams(F.col("p_name"))).cast("long").alias("n"))


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, NULL::BIGINT AS number FROM orders")
def decoded_values(t):
    return t.orders.select("o_orderkey", decode(F.col("o_totalprice").cast("string"), "float").alias("price"), decode(F.date_format("o_orderdate", "yyyy-MM-dd"), "date").cast("string").alias("day"), decode(F.col("o_orderpriority"), "integer").alias("number"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag FROM orders")
def parsed_booleans(t):
    text = F.element_at(F.array(F.lit(" TRUE "), F.lit("no"), F.lit("1"), F.lit("maybe")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.orders.select("o_orderkey", parse_boolean(text).alias("flag"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def json_tags(t):
    meta = F.to_json(F.struct(F.array("c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("tags")))
    return t.customer.withColumn("meta", meta).where(filters.json_has_all(F.col("meta"), "$.tags", ["BUILDING", "n3"])).select("c_custkey")


@query("SELECT event_id, '{\"a\":1,\"k\":' || json_extract_string(props, '$.k') || '}' AS json FROM events")
def canonical_objects(t):
    given = F.concat(F.lit('{ "k": '), F.get_json_object("props", "$.k"), F.lit(', "a" : 1 }'))
    return t.events.select("event_id", S.canonical_json(given).alias("json"))


@query("SELECT * FROM (VALUES ('7d', 604800), ('168h', 604800), (' 30m ', 1800), ('45s', 45)) v(text, seconds)")
def durations(t):
    return rows(t, [(x, parse_duration(x)) for x in ("7d", "168h", " 30m ", "45s")], "text string, seconds long")


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE 'sm%ring' OR lower(p_name) LIKE '%box'")
def glob_names(t):
    return t.part.where(S.glob_match(F.col("p_name"), ["SM*ring", "*box"])).select("p_partkey")


@query("WITH o AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS s, count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_type = 'click') AS p FROM events GROUP BY 1) SELECT user_id, round(CASE WHEN s + f + p > 0 THEN 1 + 0.5 * f / (s + f + p) * least((s + f + p) / 5.0, 1) + 0.2 * 0.5 * least((s + f + p) / 5.0, 1) ELSE 1 END, 9) AS weight FROM o")
def outcome_weights(t):
    n = t.events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == e).alias(c) for c, e in (("s", "purchase"), ("f", "error"), ("p", "click"))])
    return n.select("user_id", F.round(S.outcome_weight(F.col("s"), F.col("f"), F.col("p"), F.lit(0.5)), 9).alias("weight"))


@query("SELECT * FROM (VALUES (0, 'ALL'), (1, 'NONE'), (2, 'SCOPED'), (3, 'NONE'), (4, 'ALL'), (5, 'INVALID')) v(place, scope)")
def filter_scopes(t):
    eq = {"eq": {"a": 1}}
    trees = [{}, {"in": {"a": []}}, {"or": [eq, {"in": {"a": []}}]}, {"not": {}}, {"or": [eq, {}]}, {"and": []}]
    return rows(t, [(i, filters.scope(x)) for i, x in enumerate(trees)], "place int, scope string")


# --- joins and counts --------------------------------------------------------


@query("SELECT o_orderkey, 'order ' || CAST(o_orderkey AS VARCHAR) AS label FROM orders")
def rows_with_nodes(t):
    own = t.orders.select("o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("_memory_node_id"))
    return joins.with_nodes(own, _nodes(t)).select("o_orderkey", F.col("`node.label`").alias("label"))


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS visible, false AS lower_bound FROM orders")
def counted_visible(t):
    return A.visible_count(t.orders, F.col("o_orderstatus") == "F", 10**9)


@query("SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS live, (SELECT count(*) FROM orders) AS invalidated")
def link_counts(t):
    edges = _edges(t).withColumn("valid_to", F.when(F.col("relation") == "placed_by", ts("2024-01-01")))
    return graph.link_stats(edges, 10).select("live", "invalidated")


@query("SELECT count(*) AS nodes, count(*) FILTER (WHERE c_custkey % 10 <> 0) AS status_active, count(*) FILTER (WHERE c_custkey % 10 = 0) AS status_archived, count(*) FILTER (WHERE c_nationkey = 1) AS stale, round(coalesce(avg(c_acctbal) FILTER (WHERE c_acctbal > 0), 0), 4) AS mean_confirmation FROM customer")
def corpus_health(t):
    n = t.customer.select(F.when(F.col("c_custkey") % 10 == 0, "archived").alias("status"), F.lit(None).cast("string").alias("classification"), (F.col("c_nationkey") == 1).alias("stale"), F.lit(False).alias("anchor_stale"), F.col("c_acctbal").alias("confirmation_score"))
    return A.corpus_health(n).select("nodes", "status_active", "status_archived", "stale", "mean_confirmation")


@query("SELECT lower(c_mktsegment) AS normalised, count(*) AS rows, count(DISTINCT CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END) AS spellings FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def unresolved_spellings(t):
    given = t.customer.withColumn("segment", F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    return A.unresolved(given, "segment", rows(t, [("building", "building")], "normalised string, canonical string"), F.lower).select("normalised", "rows", "spellings")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def alias_join(t):
    aliases = rows(t, [("building", "house"), ("machinery", "house")], "normalised string, canonical string")
    return joins.spellings(t.customer, "c_mktsegment", aliases, ["Machinery"], F.lower).select("c_custkey")


# --- windows, links, merging -----------------------------------------------


@query("WITH e AS (SELECT o_orderkey AS src, o_custkey AS dst, o_totalprice AS score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY score DESC, src) AS n FROM e) SELECT src, dst FROM r WHERE n <= 3")
def capped_links(t):
    edges = t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.col("o_totalprice").alias("score"))
    return windows.cap_links(edges, 3)[0].select("src", "dst")


@query("SELECT a, b, action FROM (SELECT o_orderkey AS a, o_orderkey + 1 AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'insert' WHEN o_orderkey % 5 = 1 THEN 'invalidate' WHEN o_orderkey % 5 = 2 THEN 'refresh' WHEN o_orderkey % 5 = 3 THEN 'unchanged' ELSE 'kept_foreign' END AS action FROM orders)")
def link_diff(t):
    k = F.col("o_orderkey") % 5
    pair = t.orders.select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"), k.alias("k"))
    wanted = pair.where("k <> 1").select("a", "b", F.when(F.col("k") == 2, 0.9).otherwise(0.8).alias("score"))
    existing = pair.where("k <> 0").select("a", "b", F.lit(0.8).alias("score"), F.when(F.col("k") == 4, "manual").otherwise("similarity").alias("origin"))
    return linking.diff(wanted, existing).select("a", "b", "action")


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 1000000 END AS older, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1000000 ELSE o_orderkey END AS newer, CASE WHEN o_orderkey % 3 = 0 THEN 'supersedes' ELSE 'related_to' END AS verdict FROM orders")
def typed_pairs(t):
    """Ids name the copy that a node is of: beyond a million orders a shifted key is another order's too."""
    node = lambda copy: F.struct(F.lit(copy).alias("copy"), (F.col("o_orderkey") + copy * 1000000).alias("id"))
    pairs = t.orders.select(node(0).alias("a"), node(1).alias("b"), F.when(F.col("o_orderkey") % 3 == 0, 0.99).otherwise(0.9).alias("score"))
    first = t.orders.select(node(0).alias("id"), F.when(F.col("o_orderkey") % 2 == 0, ts("2024-01-01")).otherwise(ts("2024-01-03")).alias("created_at"))
    second = t.orders.select(node(1).alias("id"), ts("2024-01-02").alias("created_at"))
    nodes = first.unionByName(second).dropDuplicates(["id"])
    return linking.type_pairs(pairs, nodes).select(F.col("older.id").alias("older"), F.col("newer.id").alias("newer"), "verdict")


@query("SELECT event_id, user_id FROM events WHERE event_id % 4 <> 0")
def skip_stored(t):
    return linking.skip_identical(t.events, t.events.where("event_id % 4 = 0"), ["event_id", "props"]).select("event_id", "user_id")


@query("SELECT o_custkey AS id, count(*) AS rows, count(DISTINCT o_orderstatus) AS contents, count(DISTINCT o_orderstatus) > 1 AS differing FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(t):
    return linking.duplicate_ids(t.orders.withColumnRenamed("o_custkey", "id"), "id", F.col("o_orderstatus"))


@query("SELECT node_id, field, device_id, value, 'd2' AS winner FROM (SELECT CAST(user_id AS VARCHAR) AS node_id, event_type AS field, 'd1' AS device_id, props AS value FROM events)")
def lost_writes(t):
    base = t.events.select(F.col("user_id").cast("string").alias("node_id"), F.col("event_type").alias("field"), F.col("props").alias("value"), F.lit(0).cast("long").alias("wall_clock_ms"), F.col("event_id").alias("lamport"))
    later = base.select("node_id", "field").distinct().select("node_id", "field", F.lit("v").alias("value"), F.lit(9).cast("long").alias("wall_clock_ms"), F.lit(0).cast("long").alias("lamport"), F.lit("d2").alias("device_id"))
    return linking.conflicts(base.withColumn("device_id", F.lit("d1")).unionByName(later))


# --- recall ------------------------------------------------------------------


def _hits(t: Tables) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    found = t.orders.select(F.col("o_custkey").cast("string").alias("query"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1e6).alias("score"))
    return found.withColumn("rank", F.row_number().over(w))


_HITS_SQL = "SELECT CAST(o_custkey AS VARCHAR) AS query, o_orderkey AS id, o_totalprice / 1e6 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice / 1e6 DESC, o_orderkey) AS rank FROM orders"


@query(f"WITH h AS ({_HITS_SQL}), d AS (SELECT query, id, 0 AS s, rank FROM h WHERE rank <= 2), p AS (SELECT query, id, 1 AS s, rank FROM h WHERE rank BETWEEN 2 AND 6 AND (query, id) NOT IN (SELECT (query, id) FROM d)) SELECT query, id, rank FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY s, rank, id) AS rank FROM (SELECT * FROM d UNION ALL SELECT * FROM p)) WHERE rank <= 4")
def slot_refill(t):
    hits = _hits(t)
    return search.refill(hits.where("rank <= 2"), hits.where("rank between 2 and 6"), 4)


@query(f"WITH h AS ({_HITS_SQL}), u AS (SELECT query, id, min(score) AS score FROM h WHERE rank <= 5 GROUP BY 1, 2) SELECT query, id, rank FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM u) WHERE rank <= 4")
def seeds_united(t):
    hits = _hits(t)
    return recall.seed_union(hits.where("rank <= 3"), hits.where("rank between 2 and 5"), 4).select("query", "id", "rank")


@query(f"WITH h AS (SELECT * FROM ({_HITS_SQL}) WHERE rank <= 5), m AS (SELECT query, CASE WHEN id % 2 = 0 THEN id + 1 ELSE id END AS id, rank FROM h) SELECT query, id, min(rank) AS rank FROM m GROUP BY 1, 2")
def superseded_hits(t):
    hits = _hits(t).where("rank <= 5")
    chains = hits.where("id % 2 = 0").select(F.col("id").alias("start"), (F.col("id") + 1).alias("id"), F.lit(1).alias("hop")).distinct()
    return search.replace_superseded(hits, chains).select("query", "id", "rank")


@query(f"WITH h AS ({_HITS_SQL}), b AS (SELECT query, max(score) AS score FROM h GROUP BY 1) SELECT query, round((score - 0.1) / 0.05, 6) AS z, (score - 0.1) / 0.05 < 2 AS abstain FROM b")
def abstentions(t):
    best = _hits(t).groupBy("query").agg(F.max("score").alias("score")).withColumns({"coverage": F.lit(1.0), "exact_identifier": F.lit(False)})
    return search.abstain(best, rows(t, [(100, 0.1, 0.05, "ready")], "n long, median double, scale double, status string")).select("query", F.round("z", 6).alias("z"), "abstain")


@query(f"WITH h AS ({_HITS_SQL}) SELECT h.query, 1.0 * (max(CASE WHEN o.o_orderstatus = 'F' THEN 0.75 ELSE 0 END) + max(CASE WHEN o.o_orderstatus = 'O' THEN 0.25 ELSE 0 END)) AS coverage FROM h JOIN orders o ON o.o_orderkey = h.id WHERE h.rank <= 5 GROUP BY 1")
def covered_terms(t):
    texts = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("state_"), F.col("o_orderstatus")).alias("text"))
    return search.term_coverage(_hits(t), texts, {"state_F": 3.0, "state_O": 1.0})


@query(f"WITH h AS (SELECT * FROM ({_HITS_SQL}) WHERE rank <= 3) SELECT query, id, CASE WHEN score >= 0.82 THEN 1.0 WHEN score >= 0.65 THEN 0.7 ELSE 0.4 END AS confidence, CASE WHEN score >= 0.3 AND rank <= 2 THEN 'order ' || CAST(id AS VARCHAR) END AS body FROM h")
def presented_hits(t):
    texts = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("text"))
    return search.present(_hits(t).where("rank <= 3"), texts, full_at=0.3, full_most=2).select("query", "id", "confidence", "body")


@query(f"WITH h AS ({_HITS_SQL}), w AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS workspace FROM h WHERE id % 5 <> 0) SELECT query, id, workspace, rank FROM (SELECT query, id, workspace, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM w) WHERE rank <= 5")
def workspaces_recalled(t):
    hits = _hits(t).drop("rank").withColumn("workspace", F.when(F.col("id") % 5 == 0, "z").when(F.col("id") % 2 == 0, "x").otherwise("y"))
    return recall.cross_workspace(hits, ["x", "y"], 5).select("query", "id", "workspace", "rank")


@query("WITH n AS (SELECT doc_id AS id, length(text) - length(replace(text, 'é', '')) AS n FROM documents WHERE contains(text, 'é')) SELECT id, round(n / (SELECT max(n) FROM n), 6) AS score FROM n ORDER BY n DESC, id LIMIT 10")
def short_tokens(t):
    return search.short_token_search(t.documents, ["é"], 10, "doc_id").select("id", F.round("score", 6).alias("score"))


@query("SELECT user_id AS id, arg_max(props, event_id) AS props FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def live_texts(t):
    return recall.canonical(t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "props", (F.col("event_type") == "error").alias("is_tombstone"))).select("id", "props")


@query("SELECT p_partkey, CASE WHEN p_name = p_brand THEN 1.0 ELSE round(len(list_intersect(string_split(lower(p_name), ' '), ['small', 'ring'])) * 1.0 / len(list_distinct(list_concat(string_split(lower(p_name), ' '), ['small', 'ring']))), 6) END AS score FROM part")
def token_jaccard(t):
    return t.part.select("p_partkey", F.round(search.jaccard(F.col("p_name"), F.lit("small ring")), 6).alias("score"))


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 10 = 3")
def deferred(t):
    nodes = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "note").otherwise("deferred_task").alias("type"), F.array(F.concat(F.lit("src/"), (F.col("o_custkey") % 10).cast("string"), F.lit("/a.py"))).alias("paths"), F.array().cast("array<string>").alias("topics"), F.col("o_orderdate").alias("created_at"))
    return search.deferred_matches(nodes, ["src/3/"], []).select("id", "created_at")


# --- graph -------------------------------------------------------------------


@query(f"WITH e AS ({_EDGES_SQL}) SELECT src, dst, relation FROM e WHERE dst = 'n3' AND relation = 'in_nation' ORDER BY src LIMIT 10000")
def edges_asked(t):
    return graph.query_edges(_edges(t), target="n3", relation="in_nation").select("src", "dst", "relation")


@query("SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_nationkey = 3 AND c_custkey % 2 = 0")
def walled_walk(t):
    allowed = _nodes(t).where("id like 'c%' and cast(substring(id, 2) as bigint) % 2 = 0").select("id")
    return graph.traverse(_edges(t), _ids(t, "n3"), 2, allowed=allowed).select("id")


@query(f"WITH e AS ({_EDGES_SQL}) SELECT src, dst FROM e WHERE relation <> 'placed_by'")
def pruned_edges(t):
    return graph.prune_inferred(_edges(t), "placed").select("src", "dst")


@query(f"WITH e AS ({_EDGES_SQL}) SELECT src, dst FROM e WHERE src NOT IN ('n1', 'n2', 'c5') AND dst NOT IN ('n1', 'n2', 'c5')")
def deleted_nodes(t):
    return graph.delete_nodes(_nodes(t), _edges(t), _ids(t, "n1", "n2", "c5"))[1].select("src", "dst")


@query("SELECT 'node' AS kind, 'nation' AS name, (SELECT count(*) FROM nation) AS affected UNION ALL SELECT 'edge', 'placed_by', (SELECT count(*) FROM orders)")
def blast_radius(t):
    return graph.blast_radius(_nodes(t), _edges(t), ["nation", "absent"], ["placed_by"])


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'archived' ELSE 'active' END AS status, c_nationkey = 3 AS stale FROM customer")
def archived_nodes(t):
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.lit("active").alias("status"), F.lit(None).cast("boolean").alias("stale"), "c_acctbal", "c_nationkey")
    return graph.mark_stale(graph.archive(nodes, F.col("c_acctbal") < 0), F.col("c_nationkey") == 3).select("id", "status", "stale")


@query("SELECT c_custkey AS id, CASE c_custkey WHEN 1 THEN 2 WHEN 2 THEN 3 END AS superseded_by FROM customer")
def superseded(t):
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("superseded_by"), F.lit(None).cast("timestamp").alias("superseded_at"), F.lit(None).cast("string").alias("superseded_reason"))
    for old, new in ((1, 2), (2, 3), (4, 5)):
        nodes = graph.supersede(nodes, old, new, "newer", ts("2024-01-01"))
    return graph.unsupersede(nodes, 4).select("id", "superseded_by")


@query("SELECT o_orderkey % 3 AS kind, count(*) AS n FROM orders WHERE o_orderkey < 30 GROUP BY 1")
def sampled_topology(t):
    nodes = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("kind"))
    return graph.topology_sample(nodes, _edges(t).where("false"), 30)[0].groupBy("kind").agg(F.count("*").alias("n"))


# --- versions and conditions -------------------------------------------------


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'exists' WHEN 2 THEN 'revision' END AS conflict FROM orders")
def write_conflicts(t):
    current = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(5).alias("revision"))
    k = F.col("id") % 4
    writes = current.select("id", (k == 0).alias("if_absent"), F.when(k == 1, 5).when(k == 2, 4).alias("if_revision"))
    return temporal.check_conditions(writes, current).select("id", "conflict")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 8 ELSE 7 END AS revision FROM customer")
def batch_committed(t):
    current = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(7).alias("revision"))
    writes = current.where("id % 2 = 0").select("id", F.lit("new").alias("name"), F.lit(False).alias("if_absent"), F.lit(7).alias("if_revision"))
    return temporal.commit_batch(writes, current)


@query("SELECT user_id AS node_id, event_id AS version_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 2 OR date_diff('second', ts, TIMESTAMP '2024-02-01') < 7 * 86400")
def versions_kept(t):
    v = t.events.select(F.col("user_id").alias("node_id"), F.col("event_id").alias("version_id"), F.col("ts").cast("timestamp").alias("changed_at"))
    return lifecycle.drop_old_versions(v, ts("2024-02-01"), 7, 2).select("node_id", "version_id")


@query("SELECT user_id AS node_id, arg_min(props, (ts, event_id)) AS state FROM events WHERE event_id % 9 = 4 GROUP BY 1")
def rolled_back(t):
    v = t.events.select(F.col("user_id").alias("node_id"), F.col("event_id").alias("version_id"), F.col("ts").alias("changed_at"), (F.col("event_id") % 9).alias("changeset"), F.col("props").alias("previous_state"))
    return temporal.rollback(v, 4)


# --- lifecycle ---------------------------------------------------------------


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 NOT IN (1, 2) AND c_nationkey <> 3")
def cold(t):
    k = F.col("c_custkey") % 4
    nodes = t.customer.select(F.col("c_custkey").alias("id"), F.when(k == 1, "archived").alias("status"), F.when(k == 2, F.array(F.lit("pinned"))).otherwise(F.array(F.lit("x"))).alias("tags"), F.lit(None).cast("timestamp").alias("last_retrieved_at"), F.when(F.col("c_nationkey") == 3, ts("2024-05-20")).otherwise(ts("2024-01-01")).alias("updated_at"), F.lit(False).alias("legal_hold"))
    return lifecycle.cold_nodes(nodes, ts("2024-06-01")).select("id")


@query("SELECT * FROM (VALUES ('tmp-old'), ('CI-7')) v(workspace)")
def forgotten_workspaces(t):
    known = rows(t, [("tmp-old", "2024-01-01"), ("tmp-new", "2024-05-30"), ("CI-7", "2024-01-01"), ("default", "2020-01-01"), ("main", "2020-01-01")], "workspace string, at string").select("workspace", F.col("at").cast("timestamp").alias("last_activity"))
    return lifecycle.ephemeral_workspaces(known, ["tmp-*", "ci-*", "def*"], ts("2024-06-01")).select("workspace")


@query("SELECT event_id AS id FROM events WHERE event_id % 3 = 0 AND ts + INTERVAL 10 DAY <= TIMESTAMP '2024-01-20'")
def expired_nodes(t):
    nodes = t.events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("event_id") % 3 == 0, F.lit(10 * 86_400_000)).alias("ttl_ms"))
    return lifecycle.expired(nodes, ts("2024-01-20")).select("id")


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice < 20000 THEN 'delete' ELSE 'archive' END AS action FROM orders WHERE o_totalprice < 20000 OR o_orderstatus = 'F'")
def swept(t):
    return lifecycle.sweep(t.orders.withColumnRenamed("o_orderkey", "id"), [(F.col("o_totalprice") < 20000, "delete"), (F.col("o_orderstatus") == "F", "archive")])


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 1e6 >= CASE o_orderstatus WHEN 'F' THEN 0.1 WHEN 'O' THEN 0.2 ELSE 0.8 END THEN 'applied' ELSE 'queued' END AS disposition FROM orders")
def promoted(t):
    candidates = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("workspace"), (F.col("o_totalprice") / 1e6).alias("confidence"))
    return lifecycle.promotions(candidates, rows(t, [("F", 0.1), ("O", 0.2)], "workspace string, threshold double")).select("o_orderkey", "disposition")


@query("SELECT c_custkey AS id, x.anchor, x.anchor = 'b' AS anchor_stale FROM customer, (VALUES ('a'), ('b')) x(anchor)")
def anchored(t):
    return lifecycle.anchors(t.customer.select(F.col("c_custkey").alias("id"), F.array(F.lit("a"), F.lit("b")).alias("anchors")), F.col("anchor") == "b")


@query("SELECT 'c' || CAST(c_custkey AS VARCHAR) || '#q' || CAST(c_custkey % 3 AS VARCHAR) AS id FROM customer WHERE c_acctbal < 0")
def orphaned_aliases(t):
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return lifecycle.orphan_aliases(t.customer.select(F.concat(name, F.lit("#q"), (F.col("c_custkey") % 3).cast("string")).alias("id")), t.customer.where("c_acctbal >= 0").select(name.alias("id"))).select("id")


@query("SELECT o_orderkey, o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_totalprice / 1e6 < 0.1) AS needs_attention FROM orders")
def review_flags(t):
    given = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", True).alias("needs_review"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") / 1e6).alias("confidence"))
    return lifecycle.flag_review(given, 0.1).select("o_orderkey", "needs_attention")


@query("SELECT * FROM (VALUES ('rename', 3), ('retype', 3), ('drop', 2), ('add', 1)) v(kind, steps)")
def schema_steps(t):
    return rows(t, [(k, len(lifecycle.decompose({"kind": k, "field": "a", "to": "b"}))) for k in ("rename", "retype", "drop", "add")], "kind string, steps int")


@query("SELECT o_orderkey, 2 AS n, o_orderkey % 5 = 1 AS bad_link, o_orderkey % 5 = 0 AS bad_hash FROM orders WHERE o_orderkey % 5 < 2")
def broken_chain(t):
    """A chain of two entries an order; of every five orders one has a changed text and one a wrong link."""
    k = F.col("o_orderkey") % 5
    sha = lambda *parts: F.sha2(F.concat(*parts).cast("binary"), 256)
    first = t.orders.select("o_orderkey", F.lit(1).alias("n"), F.col("o_orderpriority").alias("payload"), F.lit("").alias("previous")).withColumn("hash", sha("previous", "payload"))
    link = F.when(k == 1, F.lit("other")).otherwise(F.col("hash"))
    second = first.select("o_orderkey", F.lit(2).alias("n"), F.when(k == 0, "changed").otherwise("kept").alias("payload"), link.alias("previous")).withColumn("hash", sha(F.col("previous"), F.lit("kept")))
    return windows.verify_chain(first.unionByName(second), "n", "payload", "hash", "previous", "o_orderkey").select("o_orderkey", "n", "bad_link", "bad_hash")


@query("SELECT o_orderkey AS id, o_custkey = 3 AS same FROM orders")
def same_states(t):
    one = t.orders.select(F.col("o_orderkey").alias("id"), F.struct("o_custkey", F.lit(1).alias("revision")).alias("a"), F.struct(F.lit(3).cast("long").alias("o_custkey"), F.lit(2).alias("revision")).alias("b"))
    return one.select("id", temporal.same_state("a", "b", ["o_custkey", "revision"]).alias("same"))


# --- links within walls, proposals, phrases, imports and streams ---------------------

_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


@query(f"WITH n AS (SELECT vec_id AS id, embedding, vec_id % 2 AS scope, CASE vec_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'y' END AS home FROM embeddings), p AS (SELECT a.id AS x, b.id AS y, round({_DOT}, 9) AS score FROM n a JOIN n b ON a.id <> b.id AND a.scope = b.scope AND (a.home = '' OR b.home = '' OR a.home = b.home) WHERE a.id % 50 = 0 AND a.id % 100 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS k FROM p WHERE score >= 0.3) SELECT least(x, y) AS a, greatest(x, y) AS b, round(max(score), 6) AS score, max(score) >= 0.35 AS duplicate FROM r WHERE k <= 3 GROUP BY 1, 2")
def walled_links(t):
    """Links of the vectors asked, within scopes and ecosystems; those of ids divisible by 100 opted out."""
    k = F.col("vec_id") % 3
    nodes = t.embeddings.select(F.col("vec_id").alias("id"), F.array((F.col("vec_id") % 2).cast("string")).alias("scopes"), F.when(k == 0, "*").when(k == 1, "x").otherwise("y").alias("ecosystem"), (F.col("vec_id") % 100 == 0).alias("opted_out"))
    found = linking.link_on_arrival(t.embeddings, nodes, t.embeddings.where("vec_id % 50 = 0"), 3, 0.3, 0.35, widest=10**6, id_column="vec_id")
    return found.withColumn("score", F.round("score", 6))


@query("SELECT o_orderkey AS older, CASE WHEN o_orderkey % 4 = 0 THEN 'accepted' WHEN o_orderkey % 4 = 1 THEN 'rejected' ELSE 'open' END AS state FROM orders WHERE o_orderkey % 4 <> 3")
def decided_proposals(t):
    k = F.col("o_orderkey") % 4
    pairs = t.orders.select(F.col("o_orderkey").alias("older"), (F.col("o_orderkey") + 1).alias("newer"), F.lit("supersedes").alias("verdict"), k.alias("k"))
    decisions = pairs.where("k < 2").select("older", "newer", (F.col("k") == 0).alias("accepted"))
    return linking.decide(linking.propose(pairs, pairs.where("k = 3")), decisions).select("older", "state")


@query("WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), h AS (SELECT id, w FROM w WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' the of ') OR contains(' ' || array_to_string(w, ' ') || ' ', ' token ')), c AS (SELECT id, list_transform(['the', 'of', 'token'], lambda x: len(list_filter(w, lambda y: y = x))) AS n FROM h), s AS (SELECT id, list_sum(list_transform(n, lambda k: coalesce(list_sum(list_transform(range(1, k + 1), lambda j: 1.0 / (j * j))), 0))) AS raw FROM c) SELECT id, round(raw / (SELECT max(raw) FROM s), 6) AS score FROM s ORDER BY raw DESC, id LIMIT 20")
def phrases_ranked(t):
    return search.phrase_rank(t.documents, "the-of token", 20, "doc_id").select("id", F.round("score", 6).alias("score"))


@query("SELECT 'fields' AS name, count(*) AS n FROM orders UNION ALL SELECT 'integers', count(*) FROM orders UNION ALL SELECT 'floats', count(*) FROM orders")
def structured_values(t):
    results = t.orders.select(F.col("o_orderkey").alias("job_id"), F.to_json(F.array(F.struct(F.col("o_custkey").cast("string").alias("customer"), F.lit("1.5").alias("weight"), F.col("o_orderstatus").alias("status")))).alias("result"))
    items = readers.structured_items(results)
    return items.agg(F.count_if(F.col("key") == "status").alias("fields"), F.count_if(F.col("kind") == "integer").alias("integers"), F.count_if(F.col("kind") == "float").alias("floats")).select(F.explode(F.create_map(*[x for c in ("fields", "integers", "floats") for x in (F.lit(c), F.col(c))])).alias("name", "n"))


@query("SELECT 'nation' AS \"table\", true AS ok UNION ALL SELECT 'orders', true")
def backup_verified(t):
    folder = folders.shared(t.spark, "backup")
    readers.backup({"nation": t.nation, "orders": t.orders}, folder)
    return readers.verify_backup(t.spark, folder)


@query("SELECT p_partkey, 'sha256:' || sha256(p_name) AS source_ref FROM part")
def archived_contents(t):
    return readers.archive(t.part.select("p_partkey", F.col("p_name").alias("content")), folders.shared(t.spark, "archive")).select("p_partkey", "source_ref")


@query("SELECT user_id AS id, max(ts) AS last_accessed_at, count(*) AS accesses FROM events GROUP BY 1")
def access_stamps(t):
    from quern.streaming import jobs

    return jobs.access_stamps(t.events.select(F.col("user_id").alias("id"), F.col("ts").alias("at")))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_entries(t):
    from quern.streaming import jobs

    return jobs.latest_per_key(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 5 MINUTE")
def incremental_pass(t):
    from quern.streaming import jobs

    return jobs.incremental(t.events, "ts", "2024-01-15 00:00:00").select("event_id")


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'bad_kind' WHEN event_id % 5 = 1 THEN 'bad_payload' WHEN event_id % 5 = 2 THEN 'too_long' END AS error FROM events")
def stream_errors(t):
    from quern.streaming import jobs

    k = F.col("event_id") % 5
    payload = F.when(k == 1, "{broken").when(k == 2, F.concat(F.lit('{"x":"'), F.repeat(F.lit("y"), 100), F.lit('"}'))).otherwise(F.col("props"))
    return jobs.validated(t.events.select(F.col("event_id").alias("id"), F.when(k == 0, "other").otherwise("stream.event").alias("operation_kind"), payload.alias("payload")), 80).select("id", "error")


@query(f"WITH h AS (SELECT query, id, rank FROM ({_HITS_SQL}) WHERE rank <= 6), s AS (SELECT query, id, CAST(id % 2 AS VARCHAR) AS phrasing, rank FROM h), f AS (SELECT query, id, sum(1.0 / (60 + rank)) AS raw FROM s GROUP BY 1, 2) SELECT query, CAST(id AS VARCHAR) AS id, row_number() OVER (PARTITION BY query ORDER BY raw DESC, CAST(id AS VARCHAR)) AS rank FROM f")
def phrasings_fused(t):
    seeds = _hits(t).where("rank <= 6").select("query", (F.col("id") % 2).cast("string").alias("phrasing"), F.lit("lexical").alias("leg"), F.concat(F.col("id").cast("string"), F.lit("#q1")).alias("id"), "rank")
    return search.multi_query(seeds, None, 10).select("query", "id", "rank")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.8 * 0.6 * (1 - (o_orderkey % 10) / 10.0) END AS base FROM orders")
def candidate_bases(t):
    return t.orders.select("o_orderkey", search.selectivity_base(F.when(F.col("o_orderkey") % 2 == 0, F.lit(0.5)), F.lit(0.8), 0.6, F.col("o_orderkey") % 10, F.lit(10)).alias("base"))


@query("SELECT doc_id AS id, text FROM documents WHERE doc_id IN (1, 2, 3, 77)")
def expanded_texts(t):
    return recall.expand(t.documents.select(F.col("doc_id").alias("id"), "text"), [1, 2, 3, 77])


@query("WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || ' because of it' ELSE text END AS text FROM conversations) SELECT conv_id, turn FROM c WHERE len(regexp_extract_all(lower(trim(text)), '[\\p{L}\\p{N}]+')) >= 8 AND regexp_matches(trim(text), '(?i)\\b(decid|prefer|always|never|remember|because|must|should|agreed|conclu|fixed|root cause|convention|important)\\w*') AND NOT regexp_matches(trim(text), '(?i)^(hi|hello|thanks|thank you|ok|okay)\\b') AND NOT suffix(trim(text), '?')")
def captured_turns(t):
    said = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" because of it"))).otherwise(F.col("text"))
    return t.conversations.where(search.capture(said)).select("conv_id", "turn")


@query(f"WITH h AS (SELECT query, id, rank FROM ({_HITS_SQL}) WHERE rank <= 4), n AS (SELECT h.query, h.id AS seed, h.rank AS seed_rank, h.id * 10 + 10000000 + d AS id, d AS depth FROM h, (VALUES (1), (2)) v(d)) SELECT query, seed, id, depth, round(0.3 / (1 + depth), 9) AS score FROM n")
def related_notes(t):
    hits = _hits(t).where("rank <= 4")
    near = hits.select(F.col("id").alias("seed")).distinct().withColumn("depth", F.explode(F.array(F.lit(1), F.lit(2)))).select("seed", (F.col("seed") * 10 + 10000000 + F.col("depth")).alias("id"), "depth", F.lit(0.5).alias("strength"), F.lit("l").alias("label"))
    return search.related(hits, near, 5).select("query", "seed", "id", "depth", F.round("score", 9).alias("score"))


@query(f"WITH h AS (SELECT query, id, rank FROM ({_HITS_SQL}) WHERE rank <= 3) SELECT query, id, 2 * rank - 1 AS rank FROM h UNION ALL SELECT query, id + 20000000, 2 * rank FROM h")
def corrected_notes(t):
    hits = _hits(t).where("rank <= 3").select("query", "id", "rank")
    return search.after_corrections(hits, hits.select("id", (F.col("id") + 20000000).alias("target")).distinct())


@query("SELECT lang, count(*) > 0 AS known, avg(CAST(1 AS INT)) >= 0.9 AS right FROM documents WHERE length(text) >= 400 GROUP BY 1")
def languages_by_trigrams(t):
    """Are at least nine of ten longer texts of each language told by the trigrams of the labelled ones?"""
    profiles = S.language_profiles(t.documents)
    told = t.documents.where(F.length("text") >= 400).select("lang", S.trigram_language(F.col("text"), profiles)["language"].alias("found"))
    return told.groupBy("lang").agg((F.count("*") > 0).alias("known"), (F.avg((F.col("lang") == F.col("found")).cast("int")) >= 0.9).alias("right"))
