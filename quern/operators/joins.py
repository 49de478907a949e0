"""Joins with columns named table.column.

Physical strategies are left to adaptive execution: a side is broadcast only
where statistics or run-time sizes put it under the session's threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.filters import compile_filter
from quern.types import TableError

MAX_HOPS = 4
DEFAULT_LIMIT = 10_000


@dataclass(frozen=True)
class Hop:
    table: str
    left: str
    right: str
    kind: str = "inner"


def qualified(df: DataFrame, name: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(f"{name}.{c}") for c in df.columns])


def _resolver(tables: Mapping[str, DataFrame], order: Sequence[str]):
    """Qualified names as they are; a bare one belongs to the first table that has it."""

    def column(name: str) -> Column:
        if "." in name:
            return F.col(f"`{name}`")
        for table in order:
            if name in tables[table].columns:
                return F.col(f"`{table}.{name}`")
        raise TableError("unknown_field", name)

    return column


def join_many(tables: Mapping[str, DataFrame], start: str, hops: Sequence[Hop], where: Mapping | None = None, order_by: str | None = None, descending: bool = False, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """A chain of one to four inner or left joins, each from the table before it."""
    if not 1 <= len(hops) <= MAX_HOPS:
        raise TableError("join_hop_cap", f"1 to {MAX_HOPS} hops")
    out, before = qualified(tables[start], start), start
    for hop in hops:
        if hop.kind not in ("inner", "left"):
            raise TableError("join_kind", hop.kind)
        out = out.join(qualified(tables[hop.table], hop.table), F.col(f"`{before}.{hop.left}`") == F.col(f"`{hop.table}.{hop.right}`"), hop.kind)
        before = hop.table
    column = _resolver(tables, [start, *(h.table for h in hops)])
    out = out.where(compile_filter(where, column))
    if order_by:
        out = out.orderBy(column(order_by).desc_nulls_last() if descending else column(order_by).asc_nulls_first())
    return out if limit is None else out.limit(max(0, int(limit)))


def join(tables: Mapping[str, DataFrame], left: str, right: str, on: tuple[str, str], where: Mapping | None = None) -> DataFrame:
    """Two tables, inner, without a limit."""
    return join_many(tables, left, [Hop(right, *on)], where, limit=None)


def with_nodes(rows: DataFrame, nodes: DataFrame, kind: str = "inner", key: str = "_memory_node_id") -> DataFrame:
    """Table rows beside the graph nodes that they stand for."""
    return rows.join(qualified(nodes, "node"), F.col(key) == F.col("`node.id`"), kind)


def endpoints(edges: DataFrame, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Edges with columns of both ends, as src_<column> and dst_<column>."""
    out = edges
    for end in ("src", "dst"):
        side = nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
        out = out.join(side, end)
    return out


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


# Typed links between rows, and spellings


def current_links(links: DataFrame, at: Column | None = None) -> DataFrame:
    """Links valid at an instant (now where none is given): valid_from <= t < valid_to, blanks open."""
    t = F.current_timestamp() if at is None else at
    return links.where((F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def list_links(links: DataFrame, entity: str, direction: str = "both") -> DataFrame:
    out, into = F.col("from_id") == entity, F.col("to_id") == entity
    return links.where({"out": out, "in": into, "both": out | into}[direction])


def cardinality_violations(links: DataFrame, cardinality: str) -> DataFrame:
    """(end, id, links) of entities with more links than a cardinality such as 1-n allows."""
    left, _, right = cardinality.partition("-")
    parts = []
    for end, one in (("to_id", left == "1"), ("from_id", right == "1")):
        if one:
            parts.append(links.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("links")).where("links > 1").select(F.lit(end).alias("end"), "id", "links"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else links.sparkSession.createDataFrame([], "end string, id string, links long")


def spellings(values: DataFrame, column: str, aliases: DataFrame, given: Sequence[str], normalise) -> DataFrame:
    """Rows of values whose spelling belongs to the alias group of a given one.

    aliases: normalised, canonical. A spelling in no group stands for itself.
    """
    named = values.withColumn("_norm", normalise(F.col(column)))
    wanted = values.sparkSession.createDataFrame([(g,) for g in given], "given string").select(normalise(F.col("given")).alias("_norm"))
    group = F.coalesce("canonical", "_norm")
    wanted = wanted.join(aliases.withColumnRenamed("normalised", "_norm"), "_norm", "left").select(group.alias("_group")).distinct()
    return named.join(aliases.withColumnRenamed("normalised", "_norm"), "_norm", "left").withColumn("_group", group).join(wanted, "_group", "left_semi").select(values.columns)


# Extensions beyond the chain: joins that Spark has or that are composed


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: Sequence[str], width: float = 86_400) -> DataFrame:
    """Each left row with the latest right row of its key at or before it.

    No pair of rows is ever built. Rows of a key are cut by days (numbers by
    ``width``): a window over key and day finds the latest row of the day, and
    one over the days' last rows what is carried into a day, so a key of very
    many rows is spread. Rows of one key and time on the right are ordered by
    their columns.
    """
    kind = left.schema[left_time].dataType.typeName()
    cell = F.floor(F.col("_t") / width) if kind not in ("timestamp", "timestamp_ntz", "date") else F.to_date("_t")
    value = F.struct(*[F.col(c) for c in columns])
    first = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"))
    second = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("_row"), value.alias("_v"))
    both = first.unionByName(second).withColumn("_cell", cell)
    cells = both.groupBy("_k", "_cell").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_v"))).alias("_last"))
    carried = Window.partitionBy("_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("_k").alias("_ck"), F.col("_cell").alias("_cc"), F.last("_last", ignorenulls=True).over(carried)["_v"].alias("_before"))
    inside = Window.partitionBy("_k", "_cell").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_v", ignorenulls=True).over(inside)).where("_side = 1")
    found = found.join(cells, F.col("_k").eqNullSafe(F.col("_ck")) & F.col("_cell").eqNullSafe(F.col("_cc")), "left").withColumn("_found", F.coalesce("_own", "_before"))
    return found.select("_row.*", *[F.col("_found")[c].alias(c) for c in columns])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high), joined on bins of a width: ranges are copied once a bin that they touch."""
    cells = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_bin", F.floor(F.col(point) / width)).join(cells, "_bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin")
