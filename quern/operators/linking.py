"""Similarity links, duplicates, link diffs and record merging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.search import knn

MIN_SIM, DUP_SIM, PER_NODE, SUPERSEDE_SIM = 0.80, 0.95, 5, 0.97
EPSILON = 1e-5
PROTECTED = ("id", "type", "workspace", "ingested_at", "created_by")


def select_links(neighbours: DataFrame, k: int = PER_NODE, min_sim: float = MIN_SIM) -> DataFrame:
    """a < b, score: the best k neighbours (query, id, score) of each node, as undirected pairs."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    best = neighbours.where(F.col("score") >= min_sim).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return best.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def link_vectors(vectors: DataFrame, k: int = PER_NODE, min_sim: float = MIN_SIM, new: DataFrame | None = None, id_column: str = "id", vector: str = "embedding") -> DataFrame:
    """Links of all vectors, or of the new ones with all: exact search, new vectors in blocks against every vector."""
    asked = (vectors if new is None else new).withColumnRenamed(id_column, "query")
    found = knn(vectors, asked, k, id_column, vector, exclude_self=True, min_score=min_sim)
    return select_links(found, k, min_sim)


def duplicates(links: DataFrame, dup_sim: float = DUP_SIM) -> DataFrame:
    return links.where(F.col("score") >= dup_sim)


def diff(wanted: DataFrame, existing: DataFrame, policy: str = "similarity", epsilon: float = EPSILON) -> DataFrame:
    """a, b, action: insert, refresh, invalidate, unchanged or kept_foreign, of wanted and existing pairs.

    existing has origin; pairs of another origin are never touched.
    """
    old = existing.select("a", "b", F.col("score").alias("_old"), F.col("origin"))
    out = wanted.select("a", "b", F.col("score").alias("_new")).join(old, ["a", "b"], "full_outer")
    foreign = F.col("origin").isNotNull() & (F.col("origin") != policy)
    action = F.when(foreign, "kept_foreign").when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "invalidate").when(F.abs(F.col("_old") - F.col("_new")) > epsilon, "refresh").otherwise("unchanged")
    return out.select("a", "b", action.alias("action"), F.col("_new").alias("score"))


def reconcile(local: DataFrame, remote: DataFrame, key: str, signature: str, deferred: DataFrame | None = None) -> DataFrame:
    """key, action: pull what is new or changed remotely, drop what is gone (drop-deferred while in use), unchanged."""
    out = local.select(key, F.col(signature).alias("_l"), F.lit(True).alias("_in_l")).join(remote.select(key, F.col(signature).alias("_r"), F.lit(True).alias("_in_r")), key, "full_outer")
    if deferred is not None:
        out = out.join(deferred.select(key).distinct().withColumn("_used", F.lit(True)), key, "left")
    used = F.coalesce("_used", F.lit(False)) if deferred is not None else F.lit(False)
    return out.select(key, F.when(F.col("_in_r").isNull(), F.when(used, "drop-deferred").otherwise("drop")).when(F.col("_in_l").isNull() | ~F.col("_l").eqNullSafe(F.col("_r")), "pull").otherwise("unchanged").alias("action"))


def type_pairs(pairs: DataFrame, nodes: DataFrame, supersede_sim: float = SUPERSEDE_SIM) -> DataFrame:
    """older, newer, verdict: a proposal that the newer of a very similar pair supersedes the other; related otherwise."""
    side = lambda end: nodes.select(F.col("id").alias(end), F.col("created_at").alias(f"_{end}"))
    out = pairs.join(side("a"), "a").join(side("b"), "b")
    newer_b = F.col("_b") > F.col("_a")
    sure = (F.col("score") >= supersede_sim) & (F.col("_a") != F.col("_b"))
    return out.select(F.when(newer_b, F.col("a")).otherwise(F.col("b")).alias("older"), F.when(newer_b, F.col("b")).otherwise(F.col("a")).alias("newer"), "score", F.when(sure, "supersedes").otherwise("related_to").alias("verdict"))


def supersession_candidates(neighbours: DataFrame, nodes: DataFrame, types: Sequence[str], min_sim: float = 0.78, k: int = 5) -> DataFrame:
    """older, newer, score of similar nodes of the same curated type, each pair once."""
    kind = nodes.where(F.col("type").isin(list(types))).select("id", "type", "created_at")
    best = select_links(neighbours, k, min_sim)
    out = best.join(kind.select(F.col("id").alias("a"), F.col("type").alias("_ta"), F.col("created_at").alias("_ca")), "a").join(kind.select(F.col("id").alias("b"), F.col("type").alias("_tb"), F.col("created_at").alias("_cb")), "b").where("_ta = _tb")
    newer_b = F.struct("_cb", "b") > F.struct(F.col("_ca").alias("_cb"), F.col("a").alias("b"))
    return out.select(F.when(newer_b, F.col("a")).otherwise(F.col("b")).alias("older"), F.when(newer_b, F.col("b")).otherwise(F.col("a")).alias("newer"), "score")


# --- records ---------------------------------------------------------------


def fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the columns as JSON."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def merge_records(records: DataFrame, key: str, order: str, policies: Mapping[str, str]) -> DataFrame:
    """One row a key, each column by its policy over the records in order.

    newest-wins takes the last value, nulls included; oldest-wins the first;
    first-non-null the first that is neither null nor blank; append all distinct
    values of an array column, in order. Columns of ``PROTECTED`` keep the first.
    """
    built = []
    for c in records.columns:
        if c in (key, order):
            continue
        policy = "oldest-wins" if c in PROTECTED else policies.get(c, "newest-wins")
        value = F.col(c)
        if policy == "newest-wins":
            built.append(F.max_by(F.struct(value.alias("v")), order)["v"].alias(c))
        elif policy == "oldest-wins":
            built.append(F.min_by(F.struct(value.alias("v")), order)["v"].alias(c))
        elif policy == "first-non-null":
            filled = value.isNotNull() & (F.trim(value.cast("string")) != "")
            built.append(F.min_by(value, F.when(filled, F.col(order))).alias(c))
        elif policy == "append":
            built.append(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"]))).alias(c))
        else:
            raise ValueError(f"unknown policy {policy}")
    return records.groupBy(key).agg(*built, F.count("*").alias("records"), F.max(order).alias(order))


def ingest(current: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """incoming with an outcome: created, merged or unchanged against current."""
    known = current.select(key, fingerprint(current, columns).alias("_have"))
    out = incoming.withColumn("_is", fingerprint(incoming, columns)).join(known, key, "left")
    return out.withColumn("outcome", F.when(F.col("_have").isNull(), "created").when(F.col("_have") == F.col("_is"), "unchanged").otherwise("merged")).drop("_have", "_is")


def skip_identical(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows without those stored with the same keys and content."""
    return incoming.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def duplicate_ids(rows: DataFrame, ident: str, signature: Column) -> DataFrame:
    """Ids of several rows: rows, distinct contents and whether they differ."""
    return rows.groupBy(ident).agg(F.count("*").alias("rows"), F.countDistinct(signature).alias("contents")).where("rows > 1").withColumn("differing", F.col("contents") > 1)


def lww(changes: DataFrame) -> DataFrame:
    """node_id, field, value: the last write wins, by wall clock, then Lamport time, then device; deletes hide a node's older fields."""
    stamp = F.struct("wall_clock_ms", "lamport", "device_id")
    last = changes.groupBy("node_id", "field").agg(F.max_by(F.struct("value"), stamp).alias("_v"), F.max(stamp).alias("_at"))
    gone = last.where("field = '__delete'").select("node_id", F.col("_at").alias("_gone"))
    return last.where("field <> '__delete'").join(gone, "node_id", "left").where("_gone is null or _at > _gone").select("node_id", "field", F.col("_v.value").alias("value"))


def conflicts(changes: DataFrame) -> DataFrame:
    """Writes that lost to another device's: node_id, field, device_id, value, winner."""
    stamp = F.struct("wall_clock_ms", "lamport", "device_id")
    w = Window.partitionBy("node_id", "field")
    out = changes.withColumn("_win", F.max(stamp).over(w))
    return out.where((F.col("_win.device_id") != F.col("device_id"))).select("node_id", "field", "device_id", "value", F.col("_win.device_id").alias("winner"))


# --- links on arrival, and what is decided of proposals -------------------------

#: Neighbours looked at before walls, so that walls don't starve a node of its links.
WIDEST = 400


def link_on_arrival(vectors: DataFrame, nodes: DataFrame, new: DataFrame, k: int = PER_NODE, min_sim: float = MIN_SIM, dup_sim: float = DUP_SIM, widest: int = WIDEST, id_column: str = "id", vector: str = "embedding") -> DataFrame:
    """a < b, score, duplicate: links of new vectors with all, within the walls of nodes (id, scopes, ecosystem, opted_out).

    Both ends have the same set of scopes; a node of an ecosystem links within
    it and with nodes of none (blank or a star), a node of none with all; a node
    that opted out begins no links. Walls hold among the ``widest`` nearest.
    """
    scope_set = F.array_sort(F.array_distinct(F.coalesce("scopes", F.array().cast("array<string>"))))
    home = F.coalesce(F.trim("ecosystem"), F.lit(""))
    known = nodes.select("id", scope_set.alias("scopes"), F.when(home == "*", "").otherwise(home).alias("home"), F.coalesce("opted_out", F.lit(False)).alias("out"))
    asked = new.join(known.where("not out").select(F.col("id").alias(id_column)), id_column, "left_semi").withColumnRenamed(id_column, "query")
    found = knn(vectors, asked, widest, id_column, vector, exclude_self=True, min_score=min_sim)
    ends = found.join(known.select(F.col("id").alias("query"), F.col("scopes").alias("_s"), F.col("home").alias("_h")), "query").join(known.select("id", "scopes", "home"), "id")
    inside = ends.where((F.col("_s") == F.col("scopes")) & ((F.col("_h") == "") | F.col("home").isin("") | (F.col("home") == F.col("_h"))))
    return select_links(inside.select("query", "id", "score"), k, min_sim).withColumn("duplicate", F.col("score") >= dup_sim)


def propose(typed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Typed pairs (older, newer, verdict) that weren't rejected under the same verdict before."""
    return typed.join(rejected.select("older", "newer", "verdict").distinct(), ["older", "newer", "verdict"], "left_anti")


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposals with a state: accepted or rejected as decided (older, newer, accepted), else open. Of several decisions a rejection holds."""
    said = decisions.groupBy("older", "newer").agg(F.min("accepted").alias("_yes"))
    out = proposals.join(said, ["older", "newer"], "left")
    return out.withColumn("state", F.when(F.col("_yes"), "accepted").when(~F.col("_yes"), "rejected").otherwise("open")).drop("_yes")
