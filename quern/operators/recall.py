"""Recall from end to end: legs, fusion, ranking, supersession, expansion, presentation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators import graph, paging, search


def canonical(history: DataFrame, ident: str = "id", version: str = "version") -> DataFrame:
    """The live view of append-only texts: the last row of each id, without tombstones."""
    rest = [c for c in history.columns if c != ident]
    return history.groupBy(ident).agg(F.max_by(F.struct(*rest), version).alias("_v")).select(ident, "_v.*").where(~F.coalesce("is_tombstone", F.lit(False)))


def seed_union(hits: DataFrame, scoped: DataFrame, k: int) -> DataFrame:
    """Two heads of seeds as one, so that rows of the own scope aren't starved by shared ones: first come, first kept."""
    both = hits.withColumn("_s", F.lit(0)).unionByName(scoped.withColumn("_s", F.lit(1)))
    first = Window.partitionBy("query", "id").orderBy("_s", "rank")
    return search.head(both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_s", "rank"), k)


def recall(
    nodes: DataFrame,
    queries: DataFrame,
    k: int = 10,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    where: Column | None = None,
    today: Column | None = None,
    edges: DataFrame | None = None,
    per_hit: int = 3,
    fetch: int = 50,
) -> tuple[DataFrame, DataFrame | None]:
    """(hits, related) of all queries (query, text) at once.

    nodes: id, text, type, updated_at, curated, superseded_by. The filter comes
    before scoring. Without vectors the lexical leg stands alone. Hits carry
    query, rank, id, score; superseded ones give way to their last successors.
    """
    live = nodes if where is None else nodes.where(where)
    lexical = search.bm25(live, queries, fetch)
    if vectors is not None and query_vectors is not None:
        semantic = search.knn(vectors.join(live.select("id"), "id", "left_semi"), query_vectors, fetch)
        fused = search.hybrid(lexical, semantic, fetch)
    else:
        fused = search.head(search.rrf(lexical.select("query", "id", "rank", F.lit("lexical").alias("list"))), fetch)
    now = F.current_timestamp() if today is None else today
    known = live.select("id", "type", "updated_at", "curated")
    scored = fused.select("query", "id", F.col("score").alias("_base")).join(known, "id")
    scored = scored.withColumn("score", S.rank_score(F.col("_base"), F.col("type"), F.col("updated_at"), now, F.coalesce("curated", F.lit(False)), F.lit(1.0)))
    ranked = search.head(scored.select("query", "id", "score"), fetch)
    starts = ranked.select("id").distinct()
    moved = search.replace_superseded(ranked, graph.chain(nodes.select("id", F.col("superseded_by").alias("next")), starts))
    hits = search.head(moved.select("query", "id", "score"), k)
    if edges is None:
        return hits, None
    near = graph.steps(graph.live(edges)).select(F.col("from").alias("seed"), F.col("to").alias("id"), F.lit(1).alias("depth"), F.lit(None).cast("double").alias("strength"), F.col("relation").alias("label"))
    return hits, search.related(hits, near, per_hit)


def cross_workspace(hits: DataFrame, workspaces: Sequence[str], k: int, budget: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Hits of several workspaces (workspace, query, id, score), best first, within a budget of tokens if texts are given."""
    kept = hits.where(F.col("workspace").isin(list(workspaces)))
    best = kept.groupBy("query", "id").agg(F.max_by(F.struct("workspace", "score"), "score").alias("_b")).select("query", "id", "_b.workspace", "_b.score")
    out = search.head(best, k)
    if budget is None or texts is None:
        return out
    cost = S.estimate_tokens(F.col("text"))
    running = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return out.join(texts, "id").withColumn("tokens", cost).withColumn("_t", F.sum("tokens").over(running)).where(F.col("_t") <= budget).drop("_t", "text")


def expand(texts: DataFrame, ids: Sequence, most: int = 50) -> DataFrame:
    """Whole texts of at most fifty ids."""
    return texts.where(F.col("id").isin(list(ids)[:most]))


def context(hits: DataFrame, texts: DataFrame, characters: int = 4000) -> DataFrame:
    """query, context: the leading hits as lines, as many as fit."""
    line = F.concat(F.lit("- "), S.snippet(F.col("text"), 240))
    running = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = hits.join(texts, "id").withColumn("_l", line).withColumn("_n", F.sum(F.length("_l") + 1).over(running)).where(F.col("_n") <= characters)
    return kept.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_l"))), lambda s: s["_l"]), "\n").alias("context"))


def report(nodes: DataFrame, edges: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """What a report of a graph shows, each a small table: types, tiers, hubs, recent, orphans."""
    out = {"types": nodes.groupBy("type").agg(F.count("*").alias("nodes")).orderBy(F.col("nodes").desc(), "type"), "hubs": graph.top_hubs(edges, n), "orphans": graph.orphans(nodes, edges).select("id", "type").orderBy("id").limit(n)}
    if "confidence" in edges.columns:
        out["tiers"] = graph.live(edges).groupBy("confidence").agg(F.count("*").alias("edges")).orderBy("confidence")
    if "updated_at" in nodes.columns:
        out["recent"] = paging.top_k(nodes.select("id", "type", "updated_at"), n, F.col("updated_at").desc(), F.col("id"))
    return out


def render(report_tables: Mapping[str, DataFrame], form: str = "markdown") -> str:
    """A report as markdown or HTML; its tables are small by construction."""
    import html

    parts = []
    for name, df in report_tables.items():
        rows = [df.columns, *[[str(v) for v in r] for r in df.collect()]]
        if form == "html":
            cells = ["<tr>" + "".join(f"<{'th' if not i else 'td'}>{html.escape(v)}</{'th' if not i else 'td'}>" for v in r) + "</tr>" for i, r in enumerate(rows)]
            parts.append(f"<h2>{html.escape(name)}</h2><table>{''.join(cells)}</table>")
        else:
            lines = ["| " + " | ".join(v.replace("|", "\\|") for v in r) + " |" for r in rows]
            parts.append("\n".join([f"## {name}", "", lines[0], "|" + "-|" * len(df.columns), *lines[1:]]))
    body = "\n\n".join(parts)
    return f"<!doctype html><meta charset=utf-8><title>Report</title>{body}" if form == "html" else body
