"""Registered queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators import aggregates as A
from quern.operators import filters, graph, joins, lifecycle, linking, paging, search, tables, temporal, windows
from quern.plans.execute import execute
from quern.session import ship
from quern.sources import extract, folders, readers
from quern.streaming import jobs
from quern.types import ColumnSpec, TableSchema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = ship(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(function: Callable[[Tables], DataFrame]):
        key = name or function.__name__

        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Tables(spark, sf_dir))

        QUERIES[key] = run
        if sql:
            ORACLE_SQL[key] = sql
        return function

    return add


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# --- filters, projections, paging -----------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 10 AND l_quantity <= 20 AND l_discount > 0.05")
def filter_eq_in_range(t):
    where = {"in": {"l_returnflag": ["A", "R"]}, "gte": {"l_quantity": 10}, "lte": {"l_quantity": 20}, "gt": {"l_discount": 0.05}}
    return t.lineitem.where(filters.compile_filter(where)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F' OR (o_totalprice > 100000 AND o_orderstatus = 'O'))")
def filter_bool_tree(t):
    tree = {"not": {"or": [{"eq": {"o_orderstatus": "F"}}, {"and": [{"gt": {"o_totalprice": 100000}}, {"eq": {"o_orderstatus": "O"}}]}]}}
    return t.orders.where(filters.compile_filter(tree)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' AND p_type ILIKE 's%'")
def filter_contains_ci(t):
    return t.part.where(filters.compile_filter({"contains": {"p_name": "RE"}, "startsWith": {"p_type": "S"}})).select("p_partkey", "p_name")


@query("SELECT count(*) AS n FROM part WHERE p_brand LIKE '%1%'")
def filter_contains_cs(t):
    return t.part.where(filters.compile_filter({"contains": {"p_brand": "1"}}, case_sensitive=True)).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM part WHERE false")
def filter_in_nothing(t):
    return t.part.where(filters.compile_filter({"in": {"p_brand": []}})).agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.toxic = 1")
def filter_null_tests(t):
    tree = {"or": [{"eq": {"quality": None}}, {"eq": {"toxic": 1}}]}
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where(filters.compile_filter(tree)).select("doc_id", "quality")


@query("SELECT s_suppkey, s_name FROM supplier WHERE NOT (s_nationkey IN (1, 2, 3)) AND s_name LIKE '%1' AND s_acctbal <> 0 AND regexp_matches(s_name, '[0-9]+$')")
def engine_filter(t):
    clause = lambda f, op, v: {"field": {"field": f, "operator": op, "value": v}}
    tree = {"and": [clause("s_nationkey", "nin", {"array": [{"integer": 1}, {"integer": 2}, {"integer": 3}]}), clause("s_name", "ends_with", {"string": "1"}), clause("s_acctbal", "ne", {"float": 0.0}), clause("s_name", "regex", {"string": "[0-9]+$"})]}
    return t.supplier.where(filters.engine_filter(tree)).select("s_suppkey", "s_name")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def project_order_limit(t):
    return paging.top_k(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"), 100, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("SELECT event_id AS id, ts, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC, id LIMIT 51")
def keyset_page(t):
    rows = t.events.withColumnRenamed("event_id", "id").select("id", "ts", "event_type")
    return paging.keyset_page(rows, 50, (ts("2024-01-15 00:00:00"), F.lit(2**62)), time="ts", columns=["event_type"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def point_lookup(t):
    return paging.by_key(t.customer.select("c_custkey", "c_name", "c_acctbal"), "c_custkey", 77)


@query("SELECT least(count(*), 1001) AS count FROM lineitem WHERE l_quantity > 5")
def bounded_count(t):
    return paging.bounded_count(t.lineitem.where(filters.compile_filter({"gt": {"l_quantity": 5}})), 1000)


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small ')")
def id_prefix(t):
    return t.part.where(filters.id_prefix(F.col("p_name"), "small ")).select("p_partkey", "p_name")


@query("SELECT * FROM (VALUES (0, 7), (1, 3), (2, 11)) v(place, c_custkey) JOIN (SELECT c_custkey, c_name FROM customer) USING (c_custkey)")
def hydrate_ids(t):
    found = filters.by_ids(t.customer.select("c_custkey", "c_name"), [7, 3, 11, 10**9], "c_custkey")
    return found.withColumn("place", F.array_position(F.array(F.lit(7), F.lit(3), F.lit(11)), F.col("c_custkey").cast("int")).cast("int") - 1)


@query("WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [] ELSE ['s' || (doc_id % 5)] END AS scopes FROM documents) SELECT doc_id FROM d WHERE len(scopes) = 0 OR list_contains(scopes, 's1') OR list_contains(scopes, 's2')")
def row_scopes(t):
    scopes = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string"))))
    return t.documents.select("doc_id", scopes.alias("scopes")).where(filters.visible(F.col("scopes"), ["s1", "s2"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE coalesce(trim(CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '*' ELSE source END), '') IN ('src3', '', '*')")
def ecosystem_rows(t):
    eco = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "*").otherwise(F.col("source"))
    return t.documents.where(filters.in_ecosystem(eco, "src3")).select("doc_id")


@query("WITH p AS (SELECT p_partkey, lower(p_name) || ',' || lower(p_brand) AS tags FROM part) SELECT p_partkey FROM p WHERE list_contains(string_split(tags, ','), 'brand#11')")
def tags_all(t):
    tags = F.concat_ws(",", F.lower("p_name"), F.lower("p_brand"))
    return t.part.select("p_partkey", tags.alias("tags")).where(filters.delimited_has_all(F.col("tags"), ["brand#11"])).select("p_partkey")


# --- joins ------------------------------------------------------------------


@query('SELECT o_orderkey AS "orders.o_orderkey", o_totalprice AS "orders.o_totalprice", c_name AS "customer.c_name", c_mktsegment AS "customer.c_mktsegment" FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000')
def join_inner(t):
    both = {"orders": t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "customer": t.customer.select("c_custkey", "c_name", "c_mktsegment")}
    out = joins.join(both, "orders", "customer", ("o_custkey", "c_custkey"), {"gt": {"orders.o_totalprice": 50000}})
    return out.select([F.col(f"`{c}`") for c in ("orders.o_orderkey", "orders.o_totalprice", "customer.c_name", "customer.c_mktsegment")])


@query('SELECT c_custkey AS "customer.c_custkey", o_orderkey AS "orders.o_orderkey", l_linenumber AS "lineitem.l_linenumber" FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE c_nationkey = 3')
def join_many_left(t):
    named = {"customer": t.customer.select("c_custkey", "c_nationkey"), "orders": t.orders.select("o_orderkey", "o_custkey"), "lineitem": t.lineitem.select("l_orderkey", "l_linenumber")}
    out = joins.join_many(named, "customer", [joins.Hop("orders", "c_custkey", "o_custkey", "left"), joins.Hop("lineitem", "o_orderkey", "l_orderkey", "left")], {"eq": {"c_nationkey": 3}}, limit=None)
    return out.select([F.col(f"`{c}`") for c in ("customer.c_custkey", "orders.o_orderkey", "lineitem.l_linenumber")])


@query("SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_four_hops(t):
    named = {"lineitem": t.lineitem.select("l_orderkey", "l_extendedprice"), "orders": t.orders.select("o_orderkey", "o_custkey"), "customer": t.customer.select("c_custkey", "c_nationkey"), "nation": t.nation.select("n_nationkey", "n_regionkey"), "region": t.region}
    hops = [joins.Hop("orders", "l_orderkey", "o_orderkey"), joins.Hop("customer", "o_custkey", "c_custkey"), joins.Hop("nation", "c_nationkey", "n_nationkey"), joins.Hop("region", "n_regionkey", "r_regionkey")]
    out = joins.join_many(named, "lineitem", hops, limit=None)
    return out.groupBy(F.col("`region.r_name`").alias("r_name")).agg(F.count("*").alias("n"), F.round(F.sum("`lineitem.l_extendedprice`"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def anti_orphans(t):
    return joins.anti(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def semi_exists(t):
    return joins.semi(t.part.select("p_partkey", "p_name"), t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("SELECT e.event_id, e.user_id, (SELECT max_by(p.value, (p.ts, p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS last_purchase FROM events e WHERE e.event_type = 'view' AND e.user_id < 20")
def as_of_join(t):
    return _last_purchases(t, "user_id < 20")


@query("WITH p AS (SELECT user_id, ts, max_by(value, event_id) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT e.event_id, e.user_id, p.last_purchase FROM (FROM events WHERE event_type = 'view') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts")
def as_of_join_all(t):
    return _last_purchases(t, "true")


def _last_purchases(t, where: str) -> DataFrame:
    views = t.events.where("event_type = 'view'").where(where).select("event_id", "user_id", "ts")
    bought = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("pid"), F.col("value").alias("last_purchase"))
    return joins.as_of_join(views, bought, "user_id", "ts", "at", ["pid", "last_purchase"]).select("event_id", "user_id", "last_purchase")


@query("SELECT s.s_suppkey, b.low FROM supplier s JOIN (SELECT range * 500.0 - 1000 AS low, range * 500.0 - 300 AS high FROM range(25)) b ON s.s_acctbal >= b.low AND s.s_acctbal < b.high")
def range_join(t):
    ranges = t.spark.range(25).select((F.col("id") * 500.0 - 1000).alias("low"), (F.col("id") * 500.0 - 300).alias("high"))
    return joins.range_join(t.supplier.select("s_suppkey", "s_acctbal"), ranges, "s_acctbal", "low", "high", 500.0).select("s_suppkey", "low")


@query("SELECT 'from_id' AS \"end\", CAST(o_custkey AS VARCHAR) AS id, count(*) AS links FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def link_cardinality(t):
    links = t.orders.select(F.col("o_custkey").cast("string").alias("from_id"), F.col("o_orderkey").cast("string").alias("to_id"))
    return joins.cardinality_violations(links, "n-1")


# --- aggregates ---------------------------------------------------------------


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean, min(l_shipdate) AS first, max(l_extendedprice) AS highest FROM lineitem")
def agg_scalar(t):
    m = A.measure
    return t.lineitem.agg(m("count").alias("n"), F.round(m("sum", "l_quantity"), 2).alias("total"), F.round(m("avg", "l_discount"), 6).alias("mean"), m("min", "l_shipdate").alias("first"), m("max", "l_extendedprice").alias("highest"))


@query("SELECT 0.0 AS total, 0.0 AS mean, CAST(NULL AS DOUBLE) AS low, CAST(0 AS BIGINT) AS n")
def agg_empty(t):
    rows = t.lineitem.where("l_quantity < 0")
    return rows.agg(A.measure("sum", "l_quantity").alias("total"), A.measure("avg", "l_quantity").alias("mean"), A.measure("min", "l_quantity").alias("low"), A.measure("count").alias("n"))


@query("SELECT l_returnflag AS key, round(sum(l_quantity), 2) AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 1")
def group_by_sum(t):
    return A.group_by(t.lineitem, "l_returnflag", "sum", "l_quantity").withColumn("value", F.round("value", 2))


@query("SELECT DISTINCT p_brand AS value FROM part ORDER BY 1")
def distinct_sorted(t):
    return A.distinct_values(t.part, "p_brand")


_LABELS = {"minute": "strftime(ts, '%Y-%m-%dT%H:%M')", "hour": "strftime(ts, '%Y-%m-%dT%H:00')", "day": "strftime(ts, '%Y-%m-%d')", "week": "strftime(o_orderdate, '%Y-W%W')", "month": "strftime(o_orderdate, '%Y-%m')", "quarter": "strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate)", "year": "strftime(o_orderdate, '%Y')"}
for _unit, _label in _LABELS.items():
    _fine = _unit in ("minute", "hour", "day")
    _table, _time, _value = ("events", "ts", "value") if _fine else ("orders", "o_orderdate", "o_totalprice")

    def _series(t, unit=_unit, table=_table, time=_time, value=_value):
        return A.time_series(getattr(t, table), time, unit, "sum", value).withColumn("value", F.round("value", 2))

    query(f"SELECT {_label} AS bucket, round(sum({_value}), 2) AS value, count(*) AS count FROM {_table} GROUP BY 1", f"ts_{_unit}")(_series)


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CAST(sum(CAST(round(o_totalprice, 2) AS DECIMAL(18, 2))) AS VARCHAR) AS total, count(*) AS n FROM orders GROUP BY 1")
def money_group(t):
    money = F.struct(F.round("o_totalprice", 2).cast("decimal(18,2)").alias("amount"), F.when(F.col("o_orderkey") % 2 == 0, "EUR").otherwise("USD").alias("currency"))
    return t.orders.select(money.alias("m")).groupBy("m.currency").agg(F.sum("m.amount").cast("decimal(38,2)").cast("string").alias("total"), F.count("*").alias("n"))


@query("WITH e AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS synced FROM events) SELECT count(*) FILTER (WHERE synced >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY) AS fresh, count(*) FILTER (WHERE synced < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY) AS stale, count(*) FILTER (WHERE synced IS NULL) AS never, min(synced) AS oldest, max(synced) AS newest, round(100.0 * count(*) FILTER (WHERE synced >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 DAY) / count(synced), 4) AS percent_fresh FROM e")
def freshness(t):
    rows = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 10 != 0, F.date_trunc("second", "ts")).alias("s"), F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("synced"))
    return A.freshness(rows, "synced", ts("2024-01-30 00:00:00")).drop("stale_ids")


@query("WITH c AS (SELECT user_id AS node_id, count(*) FILTER (WHERE event_type = 'purchase') AS success, count(*) FILTER (WHERE event_type = 'error') AS failure, count(*) FILTER (WHERE event_type = 'click') AS partial FROM events GROUP BY 1) SELECT *, CASE WHEN success + failure + 0.5 * partial > 0 THEN round(success / (success + failure + 0.5 * partial), 3) ELSE 0.0 END AS confirmation_score FROM c")
def outcome_counters(t):
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "click", "partial")
    return A.outcomes(t.events.select(F.col("user_id").alias("node_id"), status.alias("status")))


@query("SELECT count(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3, round((quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) / 1.349, 6) AS scale FROM lineitem")
def median_iqr(t):
    return A.robust_scale(t.lineitem, "l_extendedprice").withColumn("scale", F.round("scale", 6))


@query("SELECT coalesce(nullif(lang, ''), 'null') AS language, count(*) AS n FROM documents GROUP BY 1")
def language_breakdown(t):
    return t.documents.groupBy(F.coalesce(F.nullif("lang", F.lit("")), F.lit("null")).alias("language")).agg(F.count("*").alias("n"))


@query("SELECT source, list_sort(list(DISTINCT lang)) AS refs FROM documents GROUP BY 1")
def provenance(t):
    return A.provenance(t.documents, "source", "lang")


# --- query plans ---------------------------------------------------------------

CATALOGUE = {
    "lineitem": TableSchema("lineitem", (ColumnSpec("l_orderkey", "integer", primary=True), ColumnSpec("l_returnflag"), ColumnSpec("l_linestatus"), ColumnSpec("l_quantity", "float"), ColumnSpec("l_extendedprice", "float"), ColumnSpec("l_discount", "float"))),
    "orders": TableSchema("orders", (ColumnSpec("o_orderkey", "integer", primary=True), ColumnSpec("o_custkey", "integer"), ColumnSpec("o_orderstatus"), ColumnSpec("o_totalprice", "float"), ColumnSpec("o_orderdate", "datetime"))),
    "customer": TableSchema("customer", (ColumnSpec("c_custkey", "integer", primary=True), ColumnSpec("c_name"), ColumnSpec("c_nationkey", "integer"), ColumnSpec("c_mktsegment"))),
    "nation": TableSchema("nation", (ColumnSpec("n_nationkey", "integer", primary=True), ColumnSpec("n_name"))),
    "periods": TableSchema("periods", (ColumnSpec("o_orderkey", "integer", primary=True), ColumnSpec("o_custkey", "integer"), ColumnSpec("_valid_from", "datetime"), ColumnSpec("_valid_to", "datetime"))),
}


def _plan(t: Tables, steps: list[dict], **more: DataFrame) -> DataFrame:
    named = {n: getattr(t, n) for n in ("lineitem", "orders", "customer", "nation")} | more
    return execute({"version": 1, "steps": steps}, named, CATALOGUE)


@query('SELECT l_returnflag AS "lineitem.l_returnflag", l_linestatus AS "lineitem.l_linestatus", count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price FROM lineitem WHERE l_discount >= 0.02 GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY 4 DESC LIMIT 10')
def plan_group_having(t):
    a = {"alias": "lineitem"}
    steps = [
        {"op": "filter", "type": "lineitem", "where": [{"field": "l_discount", "op": "gte", "value": 0.02}]},
        {"op": "aggregate", "group_by": [a | {"field": "l_returnflag"}, a | {"field": "l_linestatus"}], "measures": [{"fn": "count", "as": "n"}, {"fn": "sum", "as": "quantity", **a, "field": "l_quantity"}, {"fn": "avg", "as": "price", **a, "field": "l_extendedprice"}], "having": [{"measure": "n", "op": "gte", "value": 2}]},
        {"op": "order", "by": [{"measure": "quantity", "dir": "desc"}]},
        {"op": "limit", "n": 10},
    ]
    return _plan(t, steps).withColumns({"quantity": F.round("quantity", 2), "price": F.round("price", 4)})


@query('SELECT n_name AS "nation.n_name", count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IN (\'O\', \'F\') AND lower(c_mktsegment) LIKE \'%mach%\' GROUP BY 1')
def plan_join_agg(t):
    steps = [
        {"op": "filter", "type": "orders", "where": [{"field": "o_orderstatus", "op": "in", "value": ["O", "F"]}]},
        {"op": "join", "type": "customer", "on": {"left": {"alias": "orders", "field": "o_custkey"}, "right": {"field": "c_custkey"}}},
        {"op": "filter", "alias": "customer", "where": [{"field": "c_mktsegment", "op": "contains", "value": "mach"}]},
        {"op": "join", "type": "nation", "on": {"left": {"alias": "customer", "field": "c_nationkey"}, "right": {"field": "n_nationkey"}}},
        {"op": "aggregate", "group_by": [{"alias": "nation", "field": "n_name"}], "measures": [{"fn": "count", "as": "orders"}, {"fn": "sum", "as": "total", "alias": "orders", "field": "o_totalprice"}]},
    ]
    named = t.customer.withColumn("c_nationkey", F.col("c_nationkey").cast("long"))
    return _plan(t, steps, customer=named, nation=t.nation.withColumn("n_nationkey", F.col("n_nationkey").cast("long"))).withColumn("total", F.round("total", 2))


def _periods(t: Tables) -> DataFrame:
    return temporal.intervals(t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("_valid_from")), "o_custkey", "_valid_from", "o_orderkey").withColumnRenamed("valid_to", "_valid_to")


_PERIODS_SQL = "SELECT o_orderkey, o_custkey, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS u FROM orders"


@query(f'SELECT count(*) AS n FROM ({_PERIODS_SQL}) WHERE f <= TIMESTAMP \'1998-06-01\' AND (u IS NULL OR u > TIMESTAMP \'1998-06-01\')')
def plan_as_of(t):
    steps = [{"op": "filter", "type": "periods", "where": []}, {"op": "as_of", "date": "1998-06-01"}, {"op": "aggregate", "measures": [{"fn": "count", "as": "n"}]}]
    return _plan(t, steps, periods=_periods(t))


# --- time ---------------------------------------------------------------------


@query(f"SELECT o_orderkey, o_custkey FROM ({_PERIODS_SQL}) WHERE f <= TIMESTAMP '1997-01-01' AND (u IS NULL OR u > TIMESTAMP '1997-01-01')")
def asof_half_open(t):
    return temporal.rows_as_of(_periods(t), ts("1997-01-01")).select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey, o_custkey FROM ({_PERIODS_SQL}) WHERE f <= TIMESTAMP '1997-01-01' AND (u IS NULL OR u >= TIMESTAMP '1997-01-01')")
def asof_inclusive(t):
    return temporal.nodes_as_of(_periods(t), ts("1997-01-01"), "_valid_from", "_valid_to").select("o_orderkey", "o_custkey")


@query("SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS user, max(CASE WHEN role = 'assistant' THEN text END) AS assistant FROM conversations WHERE turn <= 1 GROUP BY 1")
def recorded_pivot(t):
    values = t.conversations.select(F.col("conv_id"), F.col("role").alias("field"), F.col("text").alias("value"), F.col("turn").alias("recorded_at"), F.lit(None).cast("long").alias("superseded_at"))
    return temporal.recorded_as_of(values, F.lit(1), ["user", "assistant"], "conv_id")


def _versions(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("node_id"), F.col("event_id").alias("version_id"), F.col("ts").alias("changed_at"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("operation"), F.col("props").alias("state"))


@query("WITH v AS (SELECT user_id AS node_id, arg_max(event_type, (ts, event_id)) AS op, arg_max(props, (ts, event_id)) AS state FROM events WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1) SELECT node_id, state FROM v WHERE op <> 'error'")
def version_snapshot(t):
    return temporal.snapshot(_versions(t), ts("2024-01-20"))


@query("SELECT user_id AS node_id, count(*) AS versions, min(ts) AS first_change, max(ts) AS last_change, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'delete' ELSE 'upsert' END AS operation FROM events WHERE ts > TIMESTAMP '2024-01-25' GROUP BY 1")
def workspace_diff(t):
    return temporal.changes_since(_versions(t), ts("2024-01-25"))


@query("SELECT event_id AS version_id, ts AS changed_at FROM events WHERE user_id = 5 ORDER BY ts DESC, event_id DESC LIMIT 100")
def node_history(t):
    return temporal.history(_versions(t), 5).select("version_id", "changed_at")


# --- windows -------------------------------------------------------------------


@query("WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m) SELECT user_id, event_id, event_type, CAST(run AS BIGINT) AS run, min(event_id) OVER (PARTITION BY user_id, run) AS run_first, max(event_id) OVER (PARTITION BY user_id, run) AS run_last, count(*) OVER (PARTITION BY user_id, run) AS run_rows FROM r")
def gaps_islands(t):
    return windows.runs(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("WITH m AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, event_id, event_type FROM m WHERE p IS DISTINCT FROM event_type")
def collapse_runs(t):
    return windows.collapse_runs(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("WITH v AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous, event_type FROM events), f AS (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS m FROM v) SELECT user_id, event_id FROM f WHERE previous IS DISTINCT FROM event_type OR event_id = m")
def noop_versions(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = t.events.select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("previous"))
    return windows.drop_noop_versions(rows, "user_id", "event_id", "previous", "event_type").select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, rank FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 3")
def top_k_by_key(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_partkey")
    return paging.top_k_by(rows, "l_suppkey", 3, F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "rank")


# --- graph ----------------------------------------------------------------------


def _edges(t: Tables) -> DataFrame:
    """region - nation - customer - order, as text ids."""
    e = lambda df, a, pa, b, pb, r: df.select(F.concat(F.lit(pa), F.col(a).cast("string")).alias("src"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("dst"), F.lit(r).alias("relation"))
    out = e(t.nation, "n_nationkey", "n", "n_regionkey", "r", "in_region").unionByName(e(t.customer, "c_custkey", "c", "c_nationkey", "n", "in_nation")).unionByName(e(t.orders, "o_orderkey", "o", "o_custkey", "c", "placed_by"))
    return out.withColumns({"valid_to": F.lit(None).cast("timestamp"), "score": (F.pmod(F.xxhash64("src"), F.lit(1000)) / 1000.0)})


_EDGES_SQL = "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in_region' AS relation FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in_nation' FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'placed_by' FROM orders"


def _nodes(t: Tables) -> DataFrame:
    n = lambda df, c, p, kind: df.select(F.concat(F.lit(p), F.col(c).cast("string")).alias("id"), F.lit(kind).alias("type"), F.concat(F.lit(kind), F.lit(" "), F.col(c).cast("string")).alias("label"))
    return n(t.region, "r_regionkey", "r", "region").unionByName(n(t.nation, "n_nationkey", "n", "nation")).unionByName(n(t.customer, "c_custkey", "c", "customer")).unionByName(n(t.orders, "o_orderkey", "o", "order"))


def _ids(t: Tables, *ids: str) -> DataFrame:
    return t.spark.createDataFrame([(i,) for i in ids], "id string")


@query(f"WITH e AS ({_EDGES_SQL}) SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1")
def union_degree(t):
    return graph.degrees(_edges(t))


@query(f"WITH e AS ({_EDGES_SQL}) SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_hubs(t):
    return graph.top_hubs(_edges(t), 20)


@query(f"WITH RECURSIVE e AS ({_EDGES_SQL}), b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), w(id, depth) AS (SELECT 'n3', 0 UNION SELECT b.b, depth + 1 FROM w JOIN b ON b.a = w.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM w WHERE id <> 'n3' GROUP BY 1")
def bfs_depth(t):
    return graph.traverse(_edges(t), _ids(t, "n3"), 2).select("id", "depth")


@query(f"WITH e AS ({_EDGES_SQL}) SELECT src AS id, 1 AS depth, relation, 'in' AS direction FROM e WHERE dst = 'n3' UNION ALL SELECT dst, 1, relation, 'out' FROM e WHERE src = 'n3'")
def traverse_first_reach(t):
    return graph.traverse(_edges(t), _ids(t, "n3"), 1).select("id", "depth", "relation", "direction")


@query(f"WITH e AS ({_EDGES_SQL}) SELECT dst AS \"to\", 1 AS depth, relation, 'out' AS direction, 'c7' AS via FROM e WHERE src = 'c7' UNION ALL SELECT src, 1, relation, 'in', 'c7' FROM e WHERE dst = 'c7'")
def traverse_directed(t):
    return graph.traverse_directed(_edges(t), _ids(t, "c7"), 1)


@query(f"WITH e AS ({_EDGES_SQL}), k AS (SELECT src AS id FROM e WHERE dst = 'n4' UNION SELECT 'n4') SELECT src, dst, relation FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def subgraph_induced(t):
    near = graph.traverse(_edges(t), _ids(t, "n4"), 1, (graph.IN,)).select("id").union(_ids(t, "n4"))
    return graph.subgraph(_edges(t), near).select("src", "dst", "relation")


@query(f"WITH e AS ({_EDGES_SQL}) SELECT src AS \"to\", 'in' AS direction, relation, 'customer ' || substr(src, 2) AS label FROM e WHERE dst = 'n5' UNION ALL SELECT dst, 'out', relation, 'region ' || substr(dst, 2) FROM e WHERE src = 'n5'")
def neighbours(t):
    return graph.neighbours(_edges(t), _nodes(t), _ids(t, "n5")).select("to", "direction", "relation", "label")


@query(f"WITH e AS ({_EDGES_SQL}) SELECT 'customer ' || substr(id, 2) AS label FROM (SELECT 'c' || c_custkey AS id FROM customer) WHERE id NOT IN (SELECT 'c' || o_custkey FROM orders WHERE o_totalprice > 250000)")
def graph_orphans(t):
    dear = t.orders.where("o_totalprice > 250000").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"))
    placed = _edges(t).where("relation = 'placed_by'").join(dear, "src", "left_semi")
    return graph.orphans(_nodes(t).where("type = 'customer'"), placed).select("label")


@query(f"WITH e AS ({_EDGES_SQL}) SELECT 'region' AS type, count(*) AS count FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'order', count(*) FROM orders UNION ALL SELECT NULL, count(*) FROM e")
def graph_stats(t):
    return graph.stats(_nodes(t), _edges(t))


@query("SELECT 'order' AS from_group, 'customer' AS to_group, count(*) AS edges FROM orders UNION ALL SELECT 'customer', 'nation', count(*) FROM customer UNION ALL SELECT 'nation', 'region', count(*) FROM nation")
def topology_pairs(t):
    return graph.overview(_nodes(t), _edges(t), "type")[1]


@query("WITH l AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) SELECT a.id AS start, b.id AS id, 1 AS hop FROM l a JOIN l b ON a.nxt = b.id WHERE a.id <= 500 UNION ALL SELECT a.id, c.id, 2 FROM l a JOIN l b ON a.nxt = b.id JOIN l c ON b.nxt = c.id WHERE a.id <= 500 UNION ALL SELECT id, id, 0 FROM l WHERE id <= 500")
def lineage_chain(t):
    links = _next_orders(t)
    return graph.chain(links, links.where("id <= 500").select("id"), 2)


@query("WITH l AS (SELECT o_orderkey AS id, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT a.id AS start, b.id, b.k - a.k AS hop FROM l a JOIN l b ON a.c = b.c AND b.k >= a.k")
def lineage_chain_all(t):
    links = _next_orders(t)
    most = t.orders.groupBy("o_custkey").count().agg(F.max("count")).first()[0] or 0  # hops of the longest chain, and one
    return graph.chain(links, links.select("id"), most)


def _next_orders(t) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(w).alias("next"))


@query(f"WITH RECURSIVE e AS ({_EDGES_SQL}), w(id, depth) AS (SELECT 'r1', 0 UNION SELECT e.src, depth + 1 FROM w JOIN e ON e.dst = w.id WHERE e.relation IN ('in_region', 'in_nation')) SELECT id, min(depth) AS depth FROM w WHERE id LIKE 'c%' GROUP BY 1")
def scope_resolve(t):
    return graph.resolve_scope(_edges(t), _nodes(t), _ids(t, "r1"), ["in_region", "in_nation"], "down", ["customer"])


@query("SELECT 'u' || n_regionkey AS subject, 'viewer' AS relation, 'c' || c_custkey AS object FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'g' || n_regionkey, 'viewer', 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'g' || n_regionkey, 'viewer', 'n' || n_nationkey FROM nation UNION SELECT 'u' || n_regionkey, 'viewer', 'n' || n_nationkey FROM nation")
def rebac(t):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda df, s, r, o: df.select(s.alias("subject"), F.lit(r).alias("relation"), o.alias("object"))
    tuples = row(t.nation, text("g", "n_regionkey"), "viewer", text("n", "n_nationkey")).unionByName(row(t.region, text("u", "r_regionkey"), "member", text("g", "r_regionkey"))).unionByName(row(t.customer, text("c", "c_custkey"), "parent", text("n", "c_nationkey")))
    return graph.effective_relations(tuples)


@query("WITH c AS (SELECT c_custkey, c_acctbal FROM customer) SELECT c_custkey AS id, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS balance, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS revision FROM c UNION ALL SELECT c_custkey + 10000000, c_acctbal, 1 FROM c WHERE c_custkey % 50 = 0")
def upsert_nodes(t):
    now = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit(1).alias("revision"))
    new = now.where("id % 5 = 0").select("id", (F.col("balance") + 1).alias("balance")).unionByName(now.where("id % 50 = 0").select((F.col("id") + 10_000_000).alias("id"), "balance"))
    return graph.upsert(now, new, ["id"], revision="revision")


# --- text, search, fusion -------------------------------------------------------


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[''’‘`´]', '', 'g'), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM part")
def text_normalise(t):
    return t.part.select("p_partkey", S.alias_normalise(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"))


@query("SELECT sha AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, substr(sha1(text), 1, 16) AS sha FROM documents) GROUP BY 1 HAVING count(*) > 1")
def dedupe_exact_hash(t):
    return t.documents.groupBy(S.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(r"SELECT doc_id, CASE WHEN length(f) <= 120 THEN f ELSE substr(f, 1, 120) || '…' END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)")
def snippets(t):
    return t.documents.select("doc_id", S.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, n, substr(text, n * 360 + 1, 480) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 480) / 360.0) AS BIGINT), 0))) AS n FROM documents WHERE length(text) > 0)")
def piece_windows(t):
    return t.documents.select("doc_id", F.posexplode(S.char_windows(F.col("text"))).alias("n", "piece")).withColumn("n", F.col("n").cast("long"))


@query("SELECT p_partkey, CASE WHEN length(w) > 4 AND w LIKE '%e' THEN left(w, length(w) - 1) ELSE w END AS stem FROM (SELECT p_partkey, CASE WHEN length(p) > 4 AND p LIKE '%ies' THEN left(p, length(p) - 3) || 'y' WHEN p LIKE '%ing' AND length(p) >= 7 THEN left(p, length(p) - 3) WHEN p LIKE '%ed' AND length(p) >= 6 THEN left(p, length(p) - 2) WHEN p LIKE '%es' AND length(p) >= 6 THEN left(p, length(p) - 2) WHEN p LIKE '%ly' AND length(p) >= 6 THEN left(p, length(p) - 2) WHEN p LIKE '%s' AND p NOT LIKE '%ss' AND length(p) >= 4 THEN left(p, length(p) - 1) ELSE p END AS w FROM (SELECT p_partkey, lower(p_name) AS p FROM part))")
def light_stems(t):
    return t.part.select("p_partkey", S.light_stem(F.col("p_name")).alias("stem"))


_STOPS = "', '".join(S.STOP_WORDS)
_TERMS_SQL = f"SELECT doc_id, CASE WHEN w LIKE '%ing' AND length(w) > 6 THEN left(w, length(w) - 3) WHEN w LIKE '%ed' AND length(w) > 5 THEN left(w, length(w) - 2) WHEN w LIKE '%es' AND length(w) > 5 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) > 4 THEN left(w, length(w) - 1) ELSE w END AS term FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents) WHERE w <> '' AND w NOT IN ('{_STOPS}')"


def _asked(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("q1", "theblehe onnt edge"), ("q2", "eaux menter queque"), ("q3", "token password onea")], "query string, text string")


@query(f"WITH p AS (SELECT doc_id AS id, term, count(*) AS tf FROM ({_TERMS_SQL}) GROUP BY 1, 2), dl AS (SELECT id, sum(tf) AS dl FROM p GROUP BY 1), n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS avgdl), q(query, term) AS (VALUES ('q1', 'theblehe'), ('q1', 'onnt'), ('q1', 'edge'), ('q2', 'eaux'), ('q2', 'menter'), ('q2', 'queque'), ('q3', 'token'), ('q3', 'password'), ('q3', 'onea')), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), s AS (SELECT query, id, sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS raw FROM q JOIN p USING (term) JOIN df USING (term) JOIN dl USING (id), n GROUP BY 1, 2), r AS (SELECT query, id, raw / max(raw) OVER (PARTITION BY query) AS score FROM s) SELECT query, id, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10")
def bm25_topk(t):
    return search.bm25(t.documents, _asked(t), 10, "doc_id").select("query", "id", F.round("score", 6).alias("score"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM ({_TERMS_SQL}) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 0.2 * (SELECT count(*) FROM documents)")
def common_tokens(t):
    posted = search.postings(t.documents, "doc_id")
    n = t.documents.agg(F.count("*").alias("n"))
    return search.common_terms(posted, 0).crossJoin(F.broadcast(n)).where("df >= 0.2 * n").select("term", "df")


@query("SELECT * FROM (SELECT doc_id AS id, 4 * CAST(contains(l, 'the') AS INT) + 2 * CAST(contains(c, 'the') AS INT) + CAST(contains(g, 'the') AS INT) + 4 * CAST(contains(l, 'src1') AS INT) + 2 * CAST(contains(c, 'src1') AS INT) + CAST(contains(g, 'src1') AS INT) + CAST(contains(l, 'the src1') OR contains(c, 'the src1') AS INT) AS score FROM (SELECT doc_id, lower(substr(text, 1, 60)) AS l, lower(text) AS c, lower(source) AS g FROM documents) WHERE (contains(l, 'the') OR contains(c, 'the') OR contains(g, 'the')) AND (contains(l, 'src1') OR contains(c, 'src1') OR contains(g, 'src1'))) ORDER BY score DESC, id LIMIT 50")
def keyword_rank(t):
    nodes = t.documents.select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("label"), F.col("text").alias("content"), F.array("source").alias("tags"), F.lit(0).alias("updated_at"))
    return search.keyword_rank(nodes, ["the", "src1"], 50).select("id", "score")


_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT query, id, round(score, 6) AS score, rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, round({_COSINE}, 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COSINE}, 9) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5")
def lateral_topk(t):
    asked = t.embeddings.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query")
    return search.knn(t.embeddings, asked, 5, "vec_id", exclude_self=True).withColumn("score", F.round("score", 6))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE (a.vec_id % 50 = 0 OR b.vec_id % 50 = 0) AND round({_COSINE}, 9) >= 0.3")
def cosine_pairs_dup(t):
    asked = t.embeddings.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query")
    found = search.knn(t.embeddings, asked, 2**31 - 1, "vec_id", exclude_self=True, min_score=0.3)
    return linking.select_links(found, 2**31 - 1, 0.3).withColumn("score", F.round("score", 6))


@query(f"WITH k AS (SELECT a.vec_id AS x, b.vec_id AS y, round({_COSINE}, 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COSINE}, 9) DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND round({_COSINE}, 9) >= 0.25) SELECT least(x, y) AS a, greatest(x, y) AS b, round(max(score), 6) AS score FROM k WHERE r <= 3 GROUP BY 1, 2")
def link_topk(t):
    new = t.embeddings.where("vec_id % 50 = 0")
    return linking.link_vectors(t.embeddings, 3, 0.25, new, "vec_id").withColumn("score", F.round("score", 6))


@query("WITH l AS (SELECT 'a' AS list, o_custkey AS id, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS rank FROM orders GROUP BY o_custkey UNION ALL SELECT 'b', o_custkey, row_number() OVER (ORDER BY count(*) DESC, o_custkey) FROM orders GROUP BY o_custkey), t AS (SELECT * FROM l WHERE rank <= 200), r AS (SELECT id, sum(1.0 / (60 + rank)) AS raw, count(DISTINCT list) AS lists_matched FROM t GROUP BY 1) SELECT 'q' AS query, id, lists_matched, round(raw / max(raw) OVER (), 6) AS score FROM r")
def rrf_fusion(t):
    by = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    top = lambda name, c: paging.top_k(by, 200, F.col(c).desc(), F.col("id")).select(F.lit("q").alias("query"), F.lit(name).alias("list"), "id", F.row_number().over(Window.partitionBy(F.lit("q")).orderBy(F.col(c).desc(), "id")).alias("rank"))
    return search.rrf(top("a", "s").unionByName(top("b", "n"))).select("query", "id", "lists_matched", F.round("score", 6).alias("score"))


@query("SELECT event_id, round((CASE WHEN event_type = 'purchase' THEN 1.2 ELSE 1.0 END) * (0.85 + 0.15 * exp(-greatest(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)), 0) / 86400.0 / 30)), 6) AS score FROM events")
def rank_decay(t):
    curated = F.col("event_type") == "purchase"
    return t.events.select("event_id", F.round(S.rank_score(F.lit(1.0), F.lit("note"), F.col("ts"), ts("2024-02-01"), curated, F.lit(1.0)), 6).alias("score"))


@query("SELECT doc_id, round(CASE WHEN l > 0 THEN 1.0 * c / l ELSE 0.0 END, 6) AS share FROM (SELECT doc_id, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS c, length(text) AS l FROM documents)")
def char_share(t):
    return t.documents.select("doc_id", F.round(F.coalesce(F.regexp_count("text", F.lit("[a-zA-Z]")) / F.nullif(F.length("text"), F.lit(0)), F.lit(0.0)), 6).alias("share"))


@query("SELECT p_partkey, levenshtein(lower(p_type), 'standard') AS distance FROM part")
def edit_distance(t):
    return t.part.select("p_partkey", F.levenshtein(F.lower("p_type"), F.lit("standard")).alias("distance"))


@query("WITH w AS (SELECT doc_id, text, length(text) AS n FROM documents), c AS (SELECT doc_id, CAST(ceil(n / 4.0) AS BIGINT) AS tokens, sum(CAST(ceil(n / 4.0) AS BIGINT)) OVER (ORDER BY doc_id) AS s FROM w) SELECT doc_id, tokens FROM c WHERE s <= 5000")
def token_budget(t):
    return paging.token_budget(t.documents.select("doc_id", "text"), "text", 5000, F.col("doc_id")).select("doc_id", "tokens")


@query("WITH r AS (SELECT o_custkey AS query, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderstatus FROM orders), g AS (SELECT query, id, CASE WHEN rank <= 5 THEN rank END AS rank FROM r WHERE o_orderstatus = 'F'), o AS (SELECT query, count(*) AS n, count(rank) AS h, min(rank) AS r, sum(CASE WHEN rank IS NULL THEN 0 ELSE 1 / log2(rank + 1) END) AS d FROM g GROUP BY 1), i AS (SELECT n, sum(1 / log2(k + 1)) AS ideal FROM (SELECT DISTINCT n FROM o), range(1, 6) t(k) WHERE k <= n GROUP BY 1) SELECT count(*) AS queries, round(avg(CAST(h > 0 AS INT)), 6) AS hit, round(avg(h / n), 6) AS recall, round(avg(h / 5), 6) AS precision, round(avg(coalesce(1 / r, 0)), 6) AS mrr, round(avg(d / ideal), 6) AS ndcg FROM o JOIN i USING (n)")
def retrieval_metrics(t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    ranked = t.orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), F.row_number().over(w).alias("rank"))
    gold = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"))
    out = search.metrics(ranked, gold, 5)
    return out.select("queries", *[F.round(c, 6).alias(c) for c in ("hit", "recall", "precision", "mrr", "ndcg")])


# --- records, diffs, lifecycle ---------------------------------------------------


@query("SELECT user_id, arg_max(value, event_id) AS value, arg_min(event_type, event_id) AS event_type, count(*) AS records, max(event_id) AS event_id FROM events GROUP BY 1")
def dedupe_newest_wins(t):
    return linking.merge_records(t.events.select("user_id", "event_id", "value", "event_type"), "user_id", "event_id", {"event_type": "oldest-wins"})


@query("WITH l AS (SELECT user_id AS k, count(*) AS s FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1), r AS (SELECT user_id AS k, count(*) AS s FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-19' GROUP BY 1) SELECT coalesce(l.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'drop' WHEN l.k IS NULL OR l.s IS DISTINCT FROM r.s THEN 'pull' ELSE 'unchanged' END AS action FROM l FULL JOIN r ON l.k = r.k")
def set_diff(t):
    part = lambda where: t.events.where(where).groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("s"))
    return linking.reconcile(part(F.col("ts") < ts("2024-01-10")), part((F.col("ts") >= ts("2024-01-10")) & (F.col("ts") < ts("2024-01-19"))), "k", "s")


@query("SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'keep' WHEN d - a <= 0 THEN x ELSE 'pending' END AS action, CASE WHEN event_type <> 'view' AND d - a > 0 THEN d - a END AS eligible_in_days FROM (SELECT event_id, event_type, CAST(floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400) AS BIGINT) AS a, CASE event_type WHEN 'purchase' THEN 20 ELSE 10 END AS d, CASE event_type WHEN 'purchase' THEN 'warm' ELSE 'delete' END AS x FROM events WHERE event_type IN ('view', 'purchase', 'click'))")
def retention_plan(t):
    rows = t.events.where("event_type in ('view', 'purchase', 'click')").select(F.col("event_id").alias("id"), "event_type", "ts")
    return lifecycle.retention_plan(rows, {"purchase": ("warm", 20), "click": ("delete", 10)}, ts("2024-02-01"), "ts", "event_type")


@query("SELECT workspace, CAST(bytes AS BIGINT) AS bytes, round(bytes / 1e6, 6) AS share, CASE WHEN bytes / 1e6 < 0.7 THEN 'green' WHEN bytes / 1e6 < 0.85 THEN 'yellow' WHEN bytes / 1e6 < 0.95 THEN 'orange' ELSE 'red' END AS level FROM (SELECT source AS workspace, sum(n_chars) AS bytes FROM documents GROUP BY 1)")
def quota(t):
    return lifecycle.quota(t.documents.select(F.col("source").alias("workspace"), F.col("n_chars").alias("bytes")), 1e6).withColumn("share", F.round("share", 6))


@query("SELECT event_type AS name, count(*) AS rows, CASE event_type WHEN 'click' THEN 'clicks' END AS suggestion FROM events WHERE event_type NOT IN ('view', 'clicks') AND event_type = 'click' GROUP BY 1")
def vocabulary_check(t):
    return lifecycle.check_vocabulary(t.events.where("event_type = 'click'"), "event_type", ["view", "clicks"])


@query("SELECT sum(CAST(p_partkey AS BIGINT)) AS keys, count(*) AS rows, max(CASE WHEN k THEN 'integer' ELSE 'string' END) AS size_kind FROM part, (SELECT bool_and(regexp_matches(CAST(p_size AS VARCHAR), '^[+-]?[0-9]+$')) AS k FROM part)")
def type_inference(t):
    kinds = readers.infer_kinds(t.part.select(F.col("p_size").cast("string").alias("p_size")), ["p_size"])
    return t.part.crossJoin(F.broadcast(kinds)).agg(F.sum("p_partkey").alias("keys"), F.count("*").alias("rows"), F.max("kind").alias("size_kind"))


_HTML = "html"
for _step in (r"regexp_replace({}, '(?is)<(script|style|noscript|template)\b.*?</(script|style|noscript|template)\s*>', ' ', 'g')", r"regexp_replace({}, '(?s)<!--.*?-->', ' ', 'g')", r"regexp_replace({}, '(?i)<(br|/p|/div|/li|/tr|/h[1-6]|/section|/article|/title)\b[^>]*>', chr(10), 'g')", r"regexp_replace({}, '(?s)<[^>]*>', ' ', 'g')", "replace({}, '&nbsp;', ' ')", "replace({}, '&lt;', '<')", "replace({}, '&gt;', '>')", "replace({}, '&quot;', '\"')", "replace({}, '&#39;', '''')", "replace({}, '&apos;', '''')", "replace({}, '&amp;', '&')", r"regexp_replace({}, '(?is)</?(script|style|iframe|object)\b[^>]*>', ' ', 'g')", r"regexp_replace({}, '[ \t\r\f\x{{a0}}]+', ' ', 'g')", r"regexp_replace({}, ' ?\n[ \n]*', chr(10), 'g')", r"regexp_replace({}, '^\s+|\s+$', '', 'g')"):
    _HTML = _step.format(_HTML)


@query(f"SELECT page_id, trim({_HTML}) AS text FROM pages")
def html_text(t):
    return t.pages.select("page_id", extract.html_text(F.col("html")).alias("text"))


@query("SELECT event_id, CASE WHEN k = 'graph.node' THEN k ELSE 'verbatim' END AS target FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'graph.node' ELSE 'x' END AS k FROM events)")
def row_router(t):
    named = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.lit("n").alias("type"), F.lit("l").alias("label")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("text"))))
    return readers.route(t.events.select("event_id", named.alias("json"))).select("event_id", "target")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, try_cast(substr(event_type, 1, 1) || event_id AS BIGINT) AS value, substr(event_type, 1, 1) || event_id AS value_raw FROM events")
def coerce_raw(t):
    rows = t.events.select("event_id", F.concat(F.substring("event_type", 1, 1), F.col("event_id").cast("string")).alias("value"))
    return readers.coerce(rows, {"event_id": "string", "value": "integer"}).withColumn("event_id", F.col("event_id").cast("long"))


@query()
def table_digest(t):
    return tables.digest(t.orders)


@query("SELECT 'done' AS disposition, count(*) FILTER (WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0) AS rows FROM orders UNION ALL SELECT 'conflict', count(*) FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT 'copy', count(*) FROM orders WHERE o_orderkey % 11 = 0")
def table_copy_plan(t):
    source = t.orders.select("o_orderkey", "o_totalprice")
    target = source.where("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.lit(-1.0)).otherwise(F.col("o_totalprice")))
    return tables.plan_copy(source, target, "o_orderkey")


@query("SELECT c_custkey, c_name, CASE WHEN c_nationkey = 2 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE NOT (c_acctbal < 0)")
def update_delete(t):
    rows = tables.update(t.customer, {"eq": {"c_nationkey": 2}}, {"c_mktsegment": "moved"})
    return tables.delete(rows, {"lt": {"c_acctbal": 0}}).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey <= 10 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT 1000001, NULL, 5.0")
def upsert_rows(t):
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    new = rows.where("s_suppkey <= 10").select("s_suppkey", F.lit(0.0).alias("s_acctbal")).unionByName(t.spark.createDataFrame([(1000001, 5.0)], "s_suppkey long, s_acctbal double"))
    return tables.upsert(rows, new, "s_suppkey")


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN 'changed' ELSE n_name END AS name, n_regionkey AS region FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100, 'new', 9")
def table_transaction(t):
    """A typed store in the shared folder: create, insert, update, upsert and delete in one commit."""
    store = tables.Store(t.spark, folders.shared(t.spark, "tables"))
    schema = TableSchema("nation", (ColumnSpec("id", "integer", primary=True), ColumnSpec("name", required=True), ColumnSpec("region", "integer")))
    store.create(schema)
    rows = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    store.transaction("nation", [("insert", rows), ("update", {"eq": {"region": 1}}, {"name": "changed"}, False), ("delete", {"eq": {"region": 2}}, False), ("upsert", [{"id": 100, "name": "new", "region": 9}])])
    return store.read("nation")


# --- streams ---------------------------------------------------------------------


def _stream(t: Tables, build: Callable[[DataFrame], DataFrame], mode: str, name: str) -> DataFrame:
    folder = folders.shared(t.spark, name)
    # a file source watches a folder; the table is one file or a folder of files
    watched = _watched(t, folder)
    source = t.spark.readStream.schema(t.spark.read.parquet(watched).schema).parquet(watched)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    build(source).writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").drop("batch")


def _watched(t: Tables, folder: str) -> str:
    t.events.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("overwrite").parquet(f"{folder}/in")
    return f"{folder}/in"


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS count, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    return _stream(t, lambda e: jobs.tumbling(e, "ts", "1 day", "5 minutes", "event_type"), "complete", "tumbling").withColumns({"value": F.round("value", 4), "start": F.col("start").cast("timestamp_ntz")})


@query("WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS events FROM s GROUP BY user_id, n")
def stream_session(t):
    return _stream(t, lambda e: jobs.sessions(e, "ts", "user_id", "6 hours", "1 second"), "complete", "session").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT CAST(user_id AS VARCHAR) AS node_id, event_type AS field, arg_max(props, event_id) AS value FROM events GROUP BY 1, 2")
def lww_merge(t):
    changes = t.events.select(F.col("user_id").cast("string").alias("node_id"), F.col("event_type").alias("field"), F.col("props").alias("value"), F.lit(0).cast("long").alias("wall_clock_ms"), F.col("event_id").alias("lamport"), F.lit("d").alias("device_id"))
    return linking.lww(changes)


@query("SELECT CAST(user_id AS VARCHAR) AS node_id, event_type AS field, arg_max(props, event_id) AS value, true AS applied FROM events GROUP BY 1, 2")
def stream_lww(t):
    def changes(e: DataFrame) -> DataFrame:
        return jobs.lww_stream(e.select(F.col("user_id").cast("string").alias("node_id"), F.col("event_type").alias("field"), F.col("props").alias("value"), F.lit(0).cast("long").alias("wall_clock_ms"), F.col("event_id").alias("lamport"), F.lit("d").alias("device_id")))

    return _stream(t, changes, "update", "lww")
