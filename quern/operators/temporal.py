"""Valid time, recorded time, versions and conditional writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nodes_as_of(nodes: DataFrame, at: Column, valid_from: str = "valid_from", valid_until: str = "valid_until") -> DataFrame:
    """Nodes valid at an instant, the end included; blank and unreadable ends are open."""
    low, high = (F.col(c).try_cast("timestamp") for c in (valid_from, valid_until))
    return nodes.where((low.isNull() | (low <= at)) & (high.isNull() | (high >= at)))


def rows_as_of(rows: DataFrame, at: Column, valid_from: str = "_valid_from", valid_to: str = "_valid_to") -> DataFrame:
    """Table rows valid at an instant, the end excluded."""
    return rows.where((F.col(valid_from).isNull() | (F.col(valid_from) <= at)) & (F.col(valid_to).isNull() | (F.col(valid_to) > at)))


def recorded_as_of(values: DataFrame, at: Column, fields: Sequence[str], entity: str = "entity") -> DataFrame:
    """A row an entity from value rows (entity, field, value, recorded_at, superseded_at) known at an instant."""
    known = values.where((F.col("recorded_at") <= at) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > at)))
    return typed_view(known, fields, entity)


def typed_view(values: DataFrame, fields: Sequence[str], entity: str = "entity") -> DataFrame:
    """Value rows as columns, one aggregation for all fields."""
    return values.groupBy(entity).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


VOLATILE = ("updated_at", "revision", "last_accessed_at", "access_count", "stale", "synced_at")


def same_state(a: str, b: str, columns: Sequence[str], volatile: Sequence[str] = VOLATILE) -> Column:
    """Two structs agree in all but the volatile columns."""
    out = F.lit(True)
    for c in columns:
        if c not in volatile:
            out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def history(versions: DataFrame, node, limit: int = 100) -> DataFrame:
    """Versions of a node, newest first."""
    return versions.where(F.col("node_id") == node).orderBy(F.col("changed_at").desc(), F.col("version_id").desc()).limit(limit)


def changes_since(versions: DataFrame, since: Column) -> DataFrame:
    """node_id, versions, first and last change, last operation of nodes changed after an instant."""
    return versions.where(F.col("changed_at") > since).groupBy("node_id").agg(F.count("*").alias("versions"), F.min("changed_at").alias("first_change"), F.max("changed_at").alias("last_change"), F.max_by("operation", F.struct("changed_at", "version_id")).alias("operation"))


def snapshot(versions: DataFrame, at: Column) -> DataFrame:
    """node_id, state at an instant: the last version's, without deleted nodes."""
    last = versions.where(F.col("changed_at") <= at).groupBy("node_id").agg(F.max_by(F.struct("operation", "state"), F.struct("changed_at", "version_id")).alias("_v"))
    return last.where("_v.operation <> 'delete'").select("node_id", "_v.state")


def rollback(versions: DataFrame, changeset) -> DataFrame:
    """node_id, state to restore: what each node of a changeset was before its first version in it (null: it wasn't)."""
    return versions.where(F.col("changeset") == changeset).groupBy("node_id").agg(F.min_by("previous_state", F.struct("changed_at", "version_id")).alias("state"))


def check_conditions(writes: DataFrame, current: DataFrame) -> DataFrame:
    """writes with a conflict column: missing, exists or revision where if_absent or if_revision doesn't hold, else null."""
    now = current.select("id", F.col("revision").alias("_now"))
    out = writes.join(now, "id", "left")
    wrong = F.when(F.col("if_absent") & F.col("_now").isNotNull(), "exists").when(F.col("if_revision").isNotNull() & F.col("_now").isNull(), "missing").when(F.col("if_revision") != F.col("_now"), "revision")
    return out.withColumn("conflict", wrong).drop("_now")


def commit_batch(writes: DataFrame, current: DataFrame) -> DataFrame:
    """current with all writes applied, or an error and no change where any condition fails."""
    from quern.operators.graph import upsert

    bad = check_conditions(writes, current).where("conflict is not null").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['conflict']}: {bad[0]['id']}")
    return upsert(current, writes.drop("if_absent", "if_revision"), ["id"], revision="revision")


def intervals(df: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """Each row with the time of the key's next one as valid_to; equal times are ordered by ties."""
    return df.withColumn("valid_to", F.lead(at).over(Window.partitionBy(key).orderBy(at, *ties)))
