"""Retention, maintenance, vocabulary, quota and review."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import closest, glob_match

DAY = 86_400


def age_days(at: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))) / DAY)


def retention_plan(nodes: DataFrame, policy: Mapping[str, tuple[str, int | None]], now: Column, at: str = "updated_at", kind: str = "type") -> DataFrame:
    """id, action and days until it is due: keep, warm or delete by type; pending before it is due. Unknown types are kept."""
    age = age_days(F.col(at), now)
    action, days = F.lit("keep"), F.lit(None).cast("int")
    for name, (what, after) in policy.items():
        action = F.when(F.col(kind) == name, what).otherwise(action)
        days = F.when(F.col(kind) == name, F.lit(after).cast("int")).otherwise(days)
    left = days - age
    return nodes.select("id", F.when(action == "keep", "keep").when(left <= 0, action).otherwise("pending").alias("action"), F.when((action != "keep") & (left > 0), left.cast("long")).alias("eligible_in_days"))


def cold_nodes(nodes: DataFrame, now: Column, days: int = 90, signal: str = "last_retrieved_at", protected: Sequence[str] = ("pinned", "protected")) -> DataFrame:
    """Active nodes not used for so long, without protected tags or a legal hold."""
    last = F.coalesce(F.col(signal), F.col("updated_at"))
    tagged = F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, protected))), F.lit(False))
    return nodes.where((F.coalesce("status", F.lit("active")) == "active") & ~tagged & ~F.coalesce("legal_hold", F.lit(False)) & (age_days(last, now) >= days))


def ephemeral_workspaces(workspaces: DataFrame, patterns: Sequence[str], now: Column, days: int = 14) -> DataFrame:
    """Workspaces with a matching name and no activity for so long; the default one never."""
    return workspaces.where(glob_match(F.col("workspace"), list(patterns)) & (F.col("workspace") != "default") & (age_days(F.col("last_activity"), now) >= days))


def expired(nodes: DataFrame, now: Column) -> DataFrame:
    """Ephemeral nodes past their time to live (ttl_ms after creation)."""
    return nodes.where(F.col("ttl_ms").isNotNull() & (F.unix_millis("created_at") + F.col("ttl_ms") <= F.unix_millis(now)))


def sweep(nodes: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """id, action of the first rule that a node meets; nodes of none aren't listed. A plan only: nothing is changed."""
    action = F.lit(None).cast("string")
    for condition, what in reversed(rules):
        action = F.when(condition, what).otherwise(action)
    return nodes.select("id", action.alias("action")).where("action is not null")


def quota(used: DataFrame, budget: float) -> DataFrame:
    """workspace, bytes, share, level: green under 70 %, yellow 85, orange 95, red."""
    share = F.sum("bytes") / F.lit(float(budget))
    out = used.groupBy("workspace").agg(F.sum("bytes").alias("bytes"), share.alias("share"))
    return out.withColumn("level", F.when(F.col("share") < 0.7, "green").when(F.col("share") < 0.85, "yellow").when(F.col("share") < 0.95, "orange").otherwise("red"))


def budget_bytes(free: int) -> int:
    """A fifth of the free disk, 1 to 50 GB."""
    return max(1 << 30, min(50 << 30, free // 5))


def promotions(candidates: DataFrame, thresholds: DataFrame, default: float = 0.8) -> DataFrame:
    """Candidates (workspace, confidence) with a disposition: applied from the workspace's threshold on, else queued."""
    out = candidates.join(thresholds, "workspace", "left")
    return out.withColumn("disposition", F.when(F.col("confidence") >= F.coalesce("threshold", F.lit(default)), "applied").otherwise("queued")).drop("threshold")


def anchors(nodes: DataFrame, stale: Column | None = None) -> DataFrame:
    """id, anchor of nodes with anchors; with a condition also whether they are stale."""
    out = nodes.select("id", F.explode("anchors").alias("anchor"))
    return out if stale is None else out.withColumn("anchor_stale", stale)


def orphan_aliases(aliases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Alias rows (id = parent#qN) whose parent is gone."""
    return aliases.withColumn("_p", F.regexp_replace("id", r"#q\d+$", "")).join(nodes.select(F.col("id").alias("_p")), "_p", "left_anti").drop("_p")


def check_vocabulary(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct names that aren't allowed, their rows, and the nearest that is."""
    return rows.where(~F.col(column).isin(list(allowed))).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("rows")).withColumn("suggestion", closest(F.col("name"), list(allowed)))


def flag_review(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.withColumn("needs_attention", F.coalesce("needs_review", F.lit(False)) | (F.coalesce("confidence", F.lit(1.0)) < threshold))


def decompose(change: Mapping[str, str]) -> list[dict[str, str]]:
    """A destructive schema change (drop, rename, retype of a field) as expand, migrate and contract steps; others in one."""
    kind, name = change["kind"], change["field"]
    if kind in ("add", "index"):
        return [{"phase": "expand", "do": f"{kind} {name}"}]
    if kind == "rename":
        return [{"phase": "expand", "do": f"add {change['to']}"}, {"phase": "migrate", "do": f"copy {name} to {change['to']}"}, {"phase": "contract", "do": f"drop {name}"}]
    if kind == "retype":
        return [{"phase": "expand", "do": f"add {name}_new as {change['to']}"}, {"phase": "migrate", "do": f"cast {name} into {name}_new"}, {"phase": "contract", "do": f"drop {name}, rename {name}_new"}]
    if kind == "drop":
        return [{"phase": "migrate", "do": f"stop writing {name}"}, {"phase": "contract", "do": f"drop {name}"}]
    raise ValueError(f"unknown change {kind}")


def compact(df: DataFrame, bytes_: int, target: int = 128 << 20) -> DataFrame:
    """The same rows in files of about a target size."""
    return df.coalesce(max(1, -(-bytes_ // target)))


def drop_old_versions(versions: DataFrame, now: Column, days: int = 7, keep: int = 1) -> DataFrame:
    """Versions younger than so many days, and the last few of every node whatever their age."""
    from pyspark.sql import Window

    w = Window.partitionBy("node_id").orderBy(F.col("changed_at").desc(), F.col("version_id").desc())
    return versions.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= keep) | (age_days(F.col("changed_at"), now) < days)).drop("_r")
