"""Graph operators on nodes(id, ...) and edges(src, dst, relation, confidence, score, valid_to, ...).

Walks are loops over frontiers: each level is one join of the frontier with the
edges, and visited nodes are dropped by an anti join. Levels are written to the
checkpoint folder, so plans don't grow and lost executors cost one level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.checkpoints import checkpoint

NODE_CAP = 10_000
OUT, IN = "out", "in"


def live(edges: DataFrame) -> DataFrame:
    return edges.where("valid_to is null") if "valid_to" in edges.columns else edges


def query_edges(edges: DataFrame, source=None, target=None, relation: str | None = None, include_dead: bool = False, limit: int = 10_000, after: tuple | None = None) -> DataFrame:
    out = edges if include_dead else live(edges)
    for column, value in (("src", source), ("dst", target), ("relation", relation)):
        out = out if value is None else out.where(F.col(column) == value)
    if after is not None:
        s, d, r = after
        out = out.where(F.struct("src", "dst", "relation") > F.struct(F.lit(s).alias("src"), F.lit(d).alias("dst"), F.lit(r).alias("relation")))
    return out.orderBy("src", "dst", "relation").limit(limit)


def steps(edges: DataFrame, directions: Sequence[str] = (OUT, IN)) -> DataFrame:
    """from, to, relation, direction: edges as they are walked."""
    parts = []
    if OUT in directions:
        parts.append(edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "relation", F.lit(OUT).alias("direction")))
    if IN in directions:
        parts.append(edges.select(F.col("dst").alias("from"), F.col("src").alias("to"), "relation", F.lit(IN).alias("direction")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 2, directions: Sequence[str] = (OUT, IN), node_cap: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """id, depth, relation, place: nodes reached from seeds (id) within 1 to 5 levels, at their first reach.

    A node's relation is that of the first edge to reach it: frontier nodes in
    the order of their own discovery, outgoing edges first, then by relation
    and id. ``allowed`` (id) walls the walk in. ``node_cap`` keeps the first
    discovered. Ranks are taken by range-partitioned sorts of a level only.
    """
    walked = steps(live(edges), directions).withColumn("_out", (F.col("direction") == IN).cast("int"))
    if allowed is not None:
        walked = walked.join(allowed.select(F.col("id").alias("to")).distinct(), "to", "left_semi")
    number = seeds.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    last = F.lpad(F.col("_first.t").cast("string"), 20, "0") if number else F.col("_first.t").cast("string")
    frontier = checkpoint(seeds.select("id").distinct().select("id", F.struct(F.lit(0).alias("d"), F.lit("").alias("path")).alias("_key")))
    visited, levels = frontier.select("id"), []
    for level in range(1, min(max(depth, 1), 5) + 1):
        # the order of a node is the path of (direction, relation, id) that found it, compared as text of fixed parts
        reached = walked.join(frontier.withColumnRenamed("id", "from"), "from")
        reached = reached.join(visited.withColumnRenamed("id", "to"), "to", "left_anti")
        key = F.struct(F.col("_key.path").alias("p"), F.col("_out").alias("o"), F.col("relation").alias("r"), F.col("to").alias("t"))
        first = reached.groupBy(F.col("to").alias("id")).agg(F.min_by(F.struct("relation", "direction", F.col("from").alias("via")), key).alias("_by"), F.min(key).alias("_first"))
        # an unbounded level is ordered by path, not by one global number
        path = F.concat(F.col("_first.p"), F.lit("\u0001"), F.col("_first.o").cast("string"), F.lit("\u0002"), F.col("_first.r"), F.lit("\u0002"), last)
        found = checkpoint(first.select("id", F.lit(level).alias("depth"), "_by.relation", "_by.direction", "_by.via", F.struct(F.lit(level).alias("d"), path.alias("path")).alias("_key")))
        if found.isEmpty():
            break
        levels.append(found)
        frontier, visited = found.select("id", "_key"), visited.union(found.select("id"))
    if not levels:
        return edges.sparkSession.createDataFrame([], f"id {seeds.schema['id'].dataType.simpleString()}, depth int, relation string, direction string, via {seeds.schema['id'].dataType.simpleString()}")
    out = levels[0]
    for other in levels[1:]:
        out = out.unionByName(other)
    if node_cap is not None:
        out = out.orderBy("_key").limit(node_cap)
    return out.drop("_key")


def traverse_directed(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """to, depth, relation, direction, via: every distinct edge walked from first-reached nodes, parallel edges too."""
    reached = traverse(edges, seeds, depth)
    nodes = seeds.select("id", F.lit(0).alias("depth")).distinct().unionByName(reached.select("id", "depth"))
    walked = steps(live(edges)).join(nodes.where(F.col("depth") < min(max(depth, 1), 5)).withColumnRenamed("id", "from"), "from")
    return walked.select("to", (F.col("depth") + 1).alias("depth"), "relation", "direction", F.col("from").alias("via")).distinct()


def neighbours(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """from, to, direction, relation, confidence, label, type of the direct neighbours of ids."""
    both = steps(live(edges)).join(ids.withColumnRenamed("id", "from"), "from", "left_semi")
    return both.join(nodes.select(F.col("id").alias("to"), "label", "type"), "to")


def subgraph(edges: DataFrame, ids: DataFrame, inferred: bool = True) -> DataFrame:
    """Live edges with both ends among ids."""
    out = live(edges) if inferred else live(edges).where(~F.col("relation").startswith("inferred"))
    for end in ("src", "dst"):
        out = out.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return out.select(edges.columns)


def chain(links: DataFrame, starts: DataFrame, most: int = 8) -> DataFrame:
    """start, id, hop: followers of starts (id) along links (id -> next), cycle-safe, at most so many hops."""
    at = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hop"), F.array("id").alias("_seen"))
    out = at
    for hop in range(1, most + 1):
        at = at.join(links.select("id", F.col("next").alias("_next")), "id").where(F.col("_next").isNotNull() & ~F.array_contains("_seen", F.col("_next")))
        at = checkpoint(at.select("start", F.col("_next").alias("id"), F.lit(hop).alias("hop"), F.array_append("_seen", F.col("_next")).alias("_seen")))
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out.drop("_seen")


def lineage(nodes: DataFrame, starts: DataFrame, most: int = 8) -> DataFrame:
    """start, id, hop, direction: successors (superseded_by) and predecessors of starts."""
    forward = chain(nodes.select("id", F.col("superseded_by").alias("next")), starts, most).withColumn("direction", F.lit("forward"))
    back = chain(nodes.where("superseded_by is not null").select(F.col("superseded_by").alias("id"), F.col("id").alias("next")), starts, most).where("hop > 0").withColumn("direction", F.lit("back"))
    return forward.unionByName(back)


def resolve_scope(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, relations: Sequence[str], direction: str = "both", kinds: Sequence[str] | None = None, depth: int = 8) -> DataFrame:
    """id, depth of the nodes in scope: up follows outgoing edges, down incoming ones; kinds filter after the walk."""
    ways = {"up": (OUT,), "down": (IN,), "both": (OUT, IN)}[direction]
    allowed = steps(live(edges).where(F.col("relation").isin(list(relations))), ways).select("from", "to").distinct()
    frontier = checkpoint(seeds.select("id", F.lit(0).alias("depth")).distinct())
    out = frontier
    for level in range(1, depth + 1):
        found = allowed.join(frontier.select(F.col("id").alias("from")), "from").select(F.col("to").alias("id"), F.lit(level).alias("depth")).distinct()
        frontier = checkpoint(found.join(out, "id", "left_anti"))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    return out if kinds is None else out.join(nodes.where(F.col("type").isin(list(kinds))).select("id"), "id", "left_semi")


def effective_relations(tuples: DataFrame, depth: int = 8) -> DataFrame:
    """subject, relation, object that hold: directly, through groups (member) or on an object's ancestors (parent).

    tuples: subject, relation, object. Groups and parents are followed to a depth.
    """
    member = tuples.where("relation = 'member'").select(F.col("subject").alias("_s"), F.col("object").alias("_g")).distinct()
    parent = tuples.where("relation = 'parent'").select(F.col("subject").alias("_child"), F.col("object").alias("_up")).distinct()
    known = checkpoint(tuples.where("relation in ('owner', 'editor', 'viewer')").select("subject", "relation", "object").distinct())
    fresh = known
    for _ in range(depth):
        through_group = fresh.join(member, F.col("subject") == F.col("_g")).select(F.col("_s").alias("subject"), "relation", "object")
        through_parent = fresh.join(parent, F.col("object") == F.col("_up")).select("subject", "relation", F.col("_child").alias("object"))
        fresh = checkpoint(through_group.union(through_parent).distinct().join(known, ["subject", "relation", "object"], "left_anti"))
        if fresh.isEmpty():
            break
        known = known.union(fresh)
    return known


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree over both ends of live edges."""
    ends = live(edges)
    return ends.select(F.col("src").alias("id")).unionByName(ends.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


def top_hubs(edges: DataFrame, n: int = 20, visible: DataFrame | None = None) -> DataFrame:
    out = degrees(edges) if visible is None else degrees(edges).join(visible, "id", "left_semi")
    return out.orderBy(F.col("degree").desc(), "id").limit(n)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, other than notes, without a live edge."""
    return nodes.where("type <> 'note'").join(degrees(edges), "id", "left_anti")


def stats(nodes: DataFrame, edges: DataFrame, project: str | None = None) -> DataFrame:
    """One row a type: type, nodes; and the live edges with both ends in the project as type null."""
    own = nodes if project is None else nodes.where(F.col("project") == project)
    inside = live(edges)
    if project is not None:
        inside = subgraph(edges, own.select("id"))
    return own.groupBy("type").agg(F.count("*").alias("count")).unionByName(inside.agg(F.count("*").alias("count")).select(F.lit(None).cast("string").alias("type"), "count"))


def overview(nodes: DataFrame, edges: DataFrame, by: str = "project") -> tuple[DataFrame, DataFrame]:
    """(group, type, nodes) and (from_group, to_group, edges) between groups."""
    groups = nodes.groupBy(F.col(by).alias("group"), "type").agg(F.count("*").alias("nodes"))
    side = lambda end, name: nodes.select(F.col("id").alias(end), F.col(by).alias(name))
    pairs = live(edges).join(side("src", "from_group"), "src").join(side("dst", "to_group"), "dst").groupBy("from_group", "to_group").agg(F.count("*").alias("edges"))
    return groups, pairs


def topology_sample(nodes: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    kept = nodes.orderBy("id").limit(n)
    return kept, subgraph(edges, kept.select("id"))


def link_stats(edges: DataFrame, cap: int) -> DataFrame:
    """One row: live and dead links, mean strength of the live, stale ones, highest degree and nodes over the cap."""
    counts = edges.agg(F.count_if(F.col("valid_to").isNull()).alias("live"), F.count_if(F.col("valid_to").isNotNull()).alias("invalidated"), F.avg(F.when(F.col("valid_to").isNull(), F.col("score"))).alias("mean_strength"))
    over = degrees(edges).agg(F.max("degree").alias("max_degree"), F.count_if(F.col("degree") > cap).alias("nodes_over_cap"))
    return counts.crossJoin(over)  # one row by one row


# Writes, as functions from tables to tables


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], revision: str | None = None) -> DataFrame:
    """Rows of current replaced by those of incoming with the same keys, others added; revision counts replacements.

    Incoming rows must have distinct keys.
    """
    new = incoming.withColumn("_in", F.lit(True)).alias("b")
    both = current.alias("a").join(new, list(keys), "full_outer")
    columns = []
    for c in current.columns:
        old = F.col(f"a.{c}") if c not in keys else None
        if c in keys:
            columns.append(F.col(c))
        elif c == revision:
            columns.append(F.when(F.col("_in"), F.coalesce(old, F.lit(0)) + 1).otherwise(old).alias(c))
        elif c in incoming.columns:
            columns.append(F.when(F.col("_in"), F.col(f"b.{c}")).otherwise(old).alias(c))
        else:
            columns.append(old)
    return both.select(columns)


def supersede(nodes: DataFrame, old, new, reason: str, at: Column) -> DataFrame:
    """Marks a node as superseded; refused where that would close a cycle."""
    successors = chain(nodes.select("id", F.col("superseded_by").alias("next")), nodes.where(F.col("id") == new).select("id"), 64)
    if old == new or not successors.where(F.col("id") == old).isEmpty():
        raise ValueError(f"cycle: {new} already leads to {old}")
    hit = F.col("id") == old
    return nodes.withColumns({"superseded_by": F.when(hit, F.lit(new)).otherwise(F.col("superseded_by")), "superseded_at": F.when(hit, at).otherwise(F.col("superseded_at")), "superseded_reason": F.when(hit, F.lit(reason)).otherwise(F.col("superseded_reason"))})


def unsupersede(nodes: DataFrame, ident) -> DataFrame:
    hit = F.col("id") == ident
    return nodes.withColumns({c: F.when(~hit, F.col(c)) for c in ("superseded_by", "superseded_at", "superseded_reason")})


def mark_stale(nodes: DataFrame, condition: Column) -> DataFrame:
    return nodes.withColumn("stale", F.coalesce("stale", F.lit(False)) | F.coalesce(condition, F.lit(False)))


def prune_inferred(edges: DataFrame, prefix: str = "inferred") -> DataFrame:
    return edges.where(~F.col("relation").startswith(prefix))


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes and the edges that touch them."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return nodes.join(ids, "id", "left_anti"), out.select(edges.columns)


def archive(nodes: DataFrame, condition: Column) -> DataFrame:
    return nodes.withColumn("status", F.when(condition, "archived").otherwise(F.col("status")))


def blast_radius(nodes: DataFrame, edges: DataFrame, node_types: Sequence[str] = (), relations: Sequence[str] = ()) -> DataFrame:
    """kind, name, affected: nodes of the types and live edges of the relations that a schema change touches."""
    n = nodes.where(F.col("type").isin(list(node_types))).groupBy(F.lit("node").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("affected"))
    e = live(edges).where(F.col("relation").isin(list(relations))).groupBy(F.lit("edge").alias("kind"), F.col("relation").alias("name")).agg(F.count("*").alias("affected"))
    return n.unionByName(e)



