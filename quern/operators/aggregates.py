"""Scalar, grouped and time-bucketed aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.filters import compile_filter
from quern.types import TableError

SCAN_CAP = 200_000
GROUP_CAP = 10_000
AGGREGATES = ("count", "sum", "avg", "min", "max")
BUCKETS = ("minute", "hour", "day", "week", "month", "quarter", "year")


def measure(kind: str, field: str | None = None) -> Column:
    """count counts rows; sum and avg of nothing are 0; min and max of nothing are null."""
    match kind:
        case "count":
            return F.count(F.lit(1))
        case "sum" | "avg":
            return F.coalesce(getattr(F, kind)(field).cast("double"), F.lit(0.0))
        case "min" | "max":
            return getattr(F, kind)(field)
    raise TableError("unknown_aggregate", kind)


def scalar(df: DataFrame, kind: str, field: str | None = None, where: Mapping | None = None) -> DataFrame:
    """One row, one column value."""
    return df.where(compile_filter(where)).agg(measure(kind, field).alias("value"))


def group_limit(limit: int | None) -> tuple[int, bool]:
    """(limit, clamped): the cap holds, and counts as clamping where no limit was asked for."""
    return (GROUP_CAP, True) if limit is None or limit > GROUP_CAP else (max(0, int(limit)), False)


def check_scan(df: DataFrame, cap: int = SCAN_CAP) -> DataFrame:
    """Refuses more rows than the cap; reads no more than it takes to know. An optional guard."""
    if df.limit(cap + 1).count() > cap:
        raise TableError("scan_cap", f"more than {cap} rows match")
    return df


def group_by(df: DataFrame, key: str, kind: str, field: str | None = None, where: Mapping | None = None, limit: int | None = None, scan_cap: int | None = None) -> DataFrame:
    """key, value, count by ascending key, nulls first; a null value counts as 0."""
    rows = df.where(compile_filter(where))
    rows = rows if scan_cap is None else check_scan(rows, scan_cap)
    value = measure(kind, field)
    value = F.coalesce(value.cast("double"), F.lit(0.0))
    out = rows.groupBy(F.col(key).alias("key")).agg(value.alias("value"), F.count(F.lit(1)).alias("count"))
    out = out.orderBy(F.col("key").asc_nulls_first())
    return out if limit is None else out.limit(max(0, int(limit)))


def distinct_values(df: DataFrame, field: str, where: Mapping | None = None, limit: int | None = None) -> DataFrame:
    out = df.where(compile_filter(where)).select(F.col(field).alias("value")).distinct().orderBy(F.col("value").asc_nulls_first())
    return out if limit is None else out.limit(max(0, int(limit)))


def bucket(time: Column, unit: str) -> Column:
    """A label of the bucket of a timestamp; weeks are Monday-based, week 0 before the first Monday."""
    match unit:
        case "minute":
            return F.date_format(time, "yyyy-MM-dd'T'HH:mm")
        case "hour":
            return F.date_format(time, "yyyy-MM-dd'T'HH:00")
        case "day":
            return F.date_format(time, "yyyy-MM-dd")
        case "week":
            week = F.floor((F.dayofyear(time) + 6 - F.weekday(time)) / 7)
            return F.concat(F.date_format(time, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
        case "month":
            return F.date_format(time, "yyyy-MM")
        case "quarter":
            return F.concat(F.date_format(time, "yyyy"), F.lit("-Q"), F.quarter(time).cast("string"))
        case "year":
            return F.date_format(time, "yyyy")
    raise TableError("unknown_bucket", unit)


def time_series(df: DataFrame, time: str, unit: str, kind: str, field: str | None = None, where: Mapping | None = None, scan_cap: int | None = None) -> DataFrame:
    """bucket, value, count by bucket; rows whose time can't be parsed are dropped."""
    rows = df.where(compile_filter(where)).withColumn("_time", F.col(time).try_cast("timestamp")).where("_time is not null")
    rows = rows if scan_cap is None else check_scan(rows, scan_cap)
    value = F.coalesce(measure(kind, field).cast("double"), F.lit(0.0))
    return rows.groupBy(bucket(F.col("_time"), unit).alias("bucket")).agg(value.alias("value"), F.count(F.lit(1)).alias("count")).orderBy("bucket")


def money(df: DataFrame, kind: str, field: str, where: Mapping | None = None) -> DataFrame:
    """value, currency of an aggregate of money; several currencies are refused, counting is free of them."""
    rows = df.where(compile_filter(where))
    if kind == "count":
        return rows.agg(F.count(F.lit(1)).alias("value"), F.lit(None).cast("string").alias("currency"))
    out = rows.agg(getattr(F, kind)(f"{field}.amount").alias("value"), F.min(f"{field}.currency").alias("currency"), F.max(f"{field}.currency").alias("_other"))
    mixed = F.col("currency") != F.col("_other")
    return out.select(F.when(mixed, F.raise_error(F.concat(F.lit("mixed_currency: "), "currency", F.lit(", "), "_other")).cast("decimal(38,18)")).otherwise(F.col("value")).alias("value"), "currency")


def freshness(df: DataFrame, synced: str, now: Column, ttl_seconds: int = 86_400, id_column: str = "id", most: int = 100) -> DataFrame:
    """One row: fresh, stale and never synced counts, percent of the synced that are fresh, ends and the first stale ids."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col(synced))
    known = F.col(synced).isNotNull()
    first = df.where(known & (age > ttl_seconds)).orderBy(id_column).limit(most).agg(F.array_sort(F.collect_list(id_column)).alias("stale_ids"))
    counts = df.agg(F.count_if(known & (age <= ttl_seconds)).alias("fresh"), F.count_if(known & (age > ttl_seconds)).alias("stale"), F.count_if(~known).alias("never"), F.min(synced).alias("oldest"), F.max(synced).alias("newest"))
    share = F.when(F.col("fresh") + F.col("stale") > 0, F.round(100.0 * F.col("fresh") / (F.col("fresh") + F.col("stale")), 4)).otherwise(100.0)
    return counts.withColumn("percent_fresh", share).crossJoin(first)  # one row by one row


def outcomes(events: DataFrame, node: str = "node_id", status: str = "status") -> DataFrame:
    """success, failure, partial a node, and the confirmation score."""
    out = events.groupBy(node).agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("success", "failure", "partial")])
    return out.withColumn("confirmation_score", confirmation_score(F.col("success"), F.col("failure"), F.col("partial")))


def confirmation_score(success: Column, failure: Column, partial: Column) -> Column:
    total = success + failure + 0.5 * partial
    return F.when(total > 0, F.round(success / total, 3)).otherwise(0.0)


def corpus_health(nodes: DataFrame) -> DataFrame:
    """One row of counts by status and classification, of stale nodes, and the mean positive confirmation."""
    status, kind = F.coalesce("status", F.lit("active")), F.coalesce("classification", F.lit("tactical"))
    by = lambda c, values, name: [F.count_if(c == v).alias(f"{name}_{v}") for v in values]
    return nodes.agg(
        F.count("*").alias("nodes"),
        *by(status, ("active", "superseded", "archived", "stale"), "status"),
        *by(kind, ("foundational", "tactical", "observational"), "classification"),
        F.count_if(F.col("stale")).alias("stale"),
        F.count_if(F.col("anchor_stale")).alias("anchor_stale"),
        F.round(F.coalesce(F.avg(F.when(F.col("confirmation_score") > 0, F.col("confirmation_score"))), F.lit(0.0)), 4).alias("mean_confirmation"),
    )


def robust_scale(df: DataFrame, field: str) -> DataFrame:
    """n, median, q1, q3 and the interquartile range over 1.349, with linear interpolation."""
    cuts = F.percentile(field, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.agg(F.count(field).alias("n"), cuts.alias("_c"))
    return out.select("n", F.col("_c")[1].alias("median"), F.col("_c")[0].alias("q1"), F.col("_c")[2].alias("q3"), ((F.col("_c")[2] - F.col("_c")[0]) / 1.349).alias("scale"))


def visible_count(df: DataFrame, condition: Column, cap: int) -> DataFrame:
    """Rows that meet a condition among the first cap + 1, and whether the count is a lower bound."""
    seen = df.limit(cap + 1)
    return seen.agg(F.least(F.count_if(condition), F.lit(cap)).alias("visible"), (F.count("*") > cap).alias("lower_bound"))


def unresolved(values: DataFrame, column: str, aliases: DataFrame, normalise) -> DataFrame:
    """Normalised spellings in no alias group: rows, distinct spellings and the most frequent one (first by text among equals)."""
    counted = values.where(F.col(column).isNotNull()).groupBy(normalise(F.col(column)).alias("normalised"), F.col(column).alias("spelling")).agg(F.count("*").alias("n"))
    out = counted.groupBy("normalised").agg(F.sum("n").alias("rows"), F.count("*").alias("spellings"), F.min_by("spelling", F.struct(-F.col("n"), "spelling")).alias("example"))
    return out.join(aliases, "normalised", "left_anti")


def provenance(refs: DataFrame, node: str, ref: str) -> DataFrame:
    """Distinct references a node, sorted."""
    return refs.groupBy(node).agg(F.array_sort(F.collect_set(ref)).alias("refs"))
