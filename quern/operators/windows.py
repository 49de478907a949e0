"""Runs, versions and per-key ranks by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, key: str, order: str, signature: str) -> DataFrame:
    """Gaps and islands: rows of a key with the run of equal consecutive signatures that they are in, and its ends."""
    w = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("_new", (F.row_number().over(w) == 1) | ~F.lag(signature).over(w).eqNullSafe(F.col(signature)))
    numbered = marked.withColumn("run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy(key, "run")
    return numbered.withColumns({"run_first": F.min(order).over(r), "run_last": F.max(order).over(r), "run_rows": F.count("*").over(r)}).drop("_new")


def collapse_runs(df: DataFrame, key: str, order: str, signature: str, canonical: str | None = None) -> DataFrame:
    """One row a run: the canonical one where the run has it, else the first."""
    rank = Window.partitionBy(key, "run").orderBy(*([F.col(canonical).desc()] if canonical else []), order)
    return runs(df, key, order, signature).withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").select(df.columns)


def drop_noop_versions(df: DataFrame, key: str, order: str, previous: str, new: str) -> DataFrame:
    """Versions without those whose states are equal, but never without a key's first."""
    first = F.min(order).over(Window.partitionBy(key))
    return df.withColumn("_first", first).where(~F.col(previous).eqNullSafe(F.col(new)) | (F.col(order) == F.col("_first"))).drop("_first")


def cap_links(edges: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted): an edge stays if it is among the strongest cap of both of its ends; ties by the other end."""
    ranked = edges
    for end, other in (("src", "dst"), ("dst", "src")):
        ranked = ranked.withColumn(f"_{end}", F.row_number().over(Window.partitionBy(end).orderBy(F.col("score").desc(), other)))
    keep = (F.col("_src") <= cap) & (F.col("_dst") <= cap)
    return ranked.where(keep).select(edges.columns), ranked.where(~keep).select(edges.columns)


def verify_chain(df: DataFrame, order: str, payload: str, hash_column: str, previous: str, partition: str | None = None) -> DataFrame:
    """Entries of a hash chain that don't follow: a wrong link to the entry before or a wrong own hash.

    Chains are per partition column; without one the log is a single chain.
    """
    w = Window.partitionBy(partition).orderBy(order) if partition else Window.orderBy(order)
    own = F.sha2(F.concat(F.coalesce(previous, F.lit("")), F.col(payload)).cast("binary"), 256)
    out = df.withColumns({"bad_link": ~F.coalesce(F.lag(hash_column).over(w), F.lit("")).eqNullSafe(F.coalesce(previous, F.lit(""))), "bad_hash": ~own.eqNullSafe(F.col(hash_column))})
    return out.where("bad_link or bad_hash")
