"""Orders, limits, keyset pages and bounded probes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.checkpoints import checkpoint
from quern.operators.filters import compile_filter

DEFAULT_LIMIT = 10_000


def query(df: DataFrame, where: Mapping | None = None, order_by: str | None = None, descending: bool = False, limit: int | None = DEFAULT_LIMIT, case_sensitive: bool = False) -> DataFrame:
    out = df.where(compile_filter(where, case_sensitive=case_sensitive))
    if order_by:
        out = out.orderBy(F.col(order_by).desc_nulls_last() if descending else F.col(order_by).asc_nulls_first())
    return out if limit is None else out.limit(max(0, int(limit)))


def by_key(df: DataFrame, primary: str, key) -> DataFrame:
    return df.where(F.col(primary) == key).limit(1)


def keyset_page(df: DataFrame, size: int, after: tuple | None = None, time: str = "updated_at", id_column: str = "id", columns: Sequence[str] | None = None) -> DataFrame:
    """The next page by (time descending, id ascending) after a cursor, one row more than asked for as a look-ahead.

    Wanted columns that don't exist come back as nulls.
    """
    if after is not None:
        t, i = after
        df = df.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(id_column) > i)))
    if columns is not None:
        df = df.select(id_column, time, *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns if c not in (id_column, time)])
    return df.orderBy(F.col(time).desc(), F.col(id_column).asc()).limit(size + 1)


def bounded_count(df: DataFrame, cap: int) -> DataFrame:
    """Rows up to cap + 1."""
    return df.limit(cap + 1).agg(F.count("*").alias("count"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, key: str | Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def token_budget(df: DataFrame, text: str, budget: int, *order: Column) -> DataFrame:
    """The leading rows whose estimated tokens (a quarter of the characters, rounded up) fit a budget.

    The running sum is of each partition of the sorted rows, on top of the sums
    of those before it: no partition holds them all.
    """
    ranked = df.withColumn("tokens", F.ceil(F.length(text) / 4)).orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ranked = checkpoint(ranked)  # sorted once: parts and rows stay as they are
    before = ranked.groupBy("_part").agg(F.sum("tokens").alias("_sum"))
    before = before.select("_part", F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    so_far = F.sum("tokens").over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("_own", so_far).join(before, "_part").withColumn("tokens_so_far", F.col("_own") + F.coalesce("_before", F.lit(0)))
    return out.where(F.col("tokens_so_far") <= budget).drop("_part", "_row", "_own", "_before")
