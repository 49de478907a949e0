"""One object with the entry points of the engine, over typed tables, nodes, edges and texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import scalar
from quern.operators import aggregates, filters, graph, joins, paging, recall, search, temporal
from quern.operators.tables import Store
from quern.plans.execute import execute, report
from quern.types import TableSchema


class Engine:
    """Tables live in a folder; the graph, the texts and their vectors are DataFrames given at construction."""

    def __init__(self, spark: SparkSession, folder: str, nodes: DataFrame | None = None, edges: DataFrame | None = None, texts: DataFrame | None = None, vectors: DataFrame | None = None, versions: DataFrame | None = None):
        self.spark, self.store = spark, Store(spark, folder)
        self.nodes, self.edges, self.texts, self.vectors, self.versions = nodes, edges, texts, vectors, versions

    # tables

    def create(self, schema: TableSchema) -> None:
        self.store.create(schema)

    def schemas(self) -> list[dict]:
        return self.store.list()

    def insert(self, table: str, rows: DataFrame | Sequence[Mapping]) -> None:
        self.store.insert(table, rows)

    def bulk_insert(self, table: str, rows: Sequence[Mapping]) -> int:
        return self.store.bulk_insert(table, rows)

    def get(self, table: str, key) -> DataFrame:
        return self.store.get(table, key)

    def query(self, table: str, where: Mapping | None = None, **options) -> DataFrame:
        return self.store.query(table, where, **options)

    def count(self, table: str, where: Mapping | None = None) -> int:
        return self.store.count(table, where)

    def update_by_query(self, table: str, where: Mapping, patch: Mapping, all_rows: bool = False) -> int:
        n = self.store.count(table, where)
        self.store.update(table, where, patch, all_rows)
        return n

    def delete_by_query(self, table: str, where: Mapping, all_rows: bool = False) -> int:
        filters.guard(where, all_rows)
        n = self.store.count(table, where)
        self.store.delete(table, where, all_rows)
        return n

    def truncate(self, table: str) -> int:
        return self.store.truncate(table)

    def transaction(self, table: str, ops: Sequence[tuple]) -> None:
        self.store.transaction(table, ops)

    def join(self, start: str, hops: Sequence[joins.Hop], where: Mapping | None = None, **options) -> DataFrame:
        named = {n: self.store.read(n) for n in {start, *(h.table for h in hops)}}
        return joins.join_many(named, start, hops, where, **options)

    def aggregate(self, table: str, kind: str, field: str | None = None, where: Mapping | None = None, key: str | None = None, limit: int | None = None) -> DataFrame:
        rows = self.store.read(table)
        return aggregates.scalar(rows, kind, field, where) if key is None else aggregates.group_by(rows, key, kind, field, where, limit)

    def time_series(self, table: str, time: str, unit: str, kind: str, field: str | None = None, where: Mapping | None = None) -> DataFrame:
        return aggregates.time_series(self.store.read(table), time, unit, kind, field, where)

    def _catalogue(self) -> dict[str, TableSchema]:
        return {t["name"]: self.store.schema(t["name"]) for t in self.store.list(limit=10_000)}

    def plan(self, plan: Mapping) -> DataFrame:
        catalogue = self._catalogue()
        return execute(plan, {n: self.store.read(n) for n in catalogue}, catalogue)

    def plan_report(self, plan: Mapping, **limits) -> dict:
        catalogue = self._catalogue()
        return report(plan, {n: self.store.read(n) for n in catalogue}, catalogue, **limits)

    # graph and time

    def _ids(self, ids: Sequence) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], f"id {self.nodes.schema['id'].dataType.simpleString()}")

    def traverse(self, ids: Sequence, depth: int = 2, cap: int = graph.NODE_CAP) -> DataFrame:
        return graph.traverse(self.edges, self._ids(ids), depth, node_cap=cap)

    def subgraph(self, ids: Sequence, depth: int = 1) -> DataFrame:
        near = graph.traverse(self.edges, self._ids(ids), depth).select("id").union(self._ids(ids))
        return graph.subgraph(self.edges, near)

    def lineage(self, ids: Sequence) -> DataFrame:
        return graph.lineage(self.nodes, self._ids(ids))

    def topology(self, by: str = "project") -> tuple[DataFrame, DataFrame]:
        return graph.overview(self.nodes, self.edges, by)

    def nodes_as_of(self, at) -> DataFrame:
        return temporal.nodes_as_of(self.nodes, F.lit(at).cast("timestamp"))

    def node_history(self, ident, limit: int = 100) -> DataFrame:
        return temporal.history(self.versions, ident, limit)

    def diff_workspace(self, since) -> DataFrame:
        return temporal.changes_since(self.versions, F.lit(since).cast("timestamp"))

    def export_snapshot(self, at) -> DataFrame:
        return temporal.snapshot(self.versions, F.lit(at).cast("timestamp"))

    # retrieval

    def search(self, query: str, k: int = 20) -> DataFrame:
        return search.keyword_rank(self.nodes, scalar.keyword_terms(query), k)

    def search_texts(self, query: str, k: int = 20) -> DataFrame:
        return self.bulk_search([query], k)

    def bulk_search(self, queries: Sequence[str], k: int = 20) -> DataFrame:
        asked = self.spark.createDataFrame([(q, q) for q in dict.fromkeys(queries)], "query string, text string")
        return search.bm25(self.texts, asked, k)

    def recall(self, queries: Sequence[str], k: int = 10, query_vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        asked = self.spark.createDataFrame([(q, q) for q in dict.fromkeys(queries)], "query string, text string")
        return recall.recall(self.nodes, asked, k, self.vectors, query_vectors, edges=self.edges)

    def structured_query(self, where: Mapping | None = None, **options) -> DataFrame:
        return paging.query(self.nodes, where, **options)

    def expand(self, ids: Sequence) -> DataFrame:
        return recall.expand(self.texts, ids)

    def corpus_health(self) -> DataFrame:
        return aggregates.corpus_health(self.nodes)
