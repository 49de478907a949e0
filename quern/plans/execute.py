"""Lowering of checked plans to one lazy DataFrame."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.validate import Ref, Step, validate
from quern.types import TableSchema

MAX_ROWS_A_STEP, MAX_ROWS = 10_000, 50_000
_OPS: dict[str, Callable[[Column, Any], Column]] = {"eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}


class Capped(ValueError):
    """A step leaves more rows than the caller allows."""


def _column(ref: Ref) -> Column:
    name = ref.field.removesuffix("__currency") if ref.kind == "currency" else ref.field
    found = F.col(f"`{ref.alias}.{name}`")
    return found["currency"] if ref.kind == "currency" else found


def _money(column: Column, op: str, value: tuple[str, str]) -> Column:
    """Holds within the literal's currency only, inequality too."""
    return (column["currency"] == value[1]) & _OPS[op](column["amount"], F.lit(value[0]).cast("decimal(38,18)"))


def _predicate(ref: Ref, op: str, value: Any, groups: Mapping[str, Sequence[str]] | None = None) -> Column:
    column = _column(ref)
    if op in ("is_null", "not_null"):
        return column.isNull() if op == "is_null" else column.isNotNull()
    if ref.kind == "money":
        return reduce(lambda a, b: a | b, [_money(column, "eq", v) for v in value]) if op == "in" else _money(column, op, value)
    if op == "contains":
        return F.contains(F.lower(column), F.lit(value.lower()))
    if op == "starts_with":
        return F.startswith(F.lower(column), F.lit(value.lower()))
    if op in ("eq", "in") and groups and ref.kind == "string":
        given = value if op == "in" else [value]
        return column.isin(sorted({s for g in given for s in groups.get(g, [g])}))
    return column.isin(value) if op == "in" else _OPS[op](column, F.lit(value))


def _as_of(df: DataFrame, alias: str, at: Column) -> DataFrame:
    """Rows valid at an instant: [valid from, valid to), blanks open; tables without these columns always are."""
    for name, rule in (("_valid_from", lambda c: c <= at), ("_valid_to", lambda c: c > at)):
        if f"{alias}.{name}" in df.columns:
            column = F.col(f"`{alias}.{name}`")
            df = df.where(column.isNull() | rule(column))
    return df


def lower(steps: Sequence[Step], tables: Mapping[str, DataFrame], catalogue: Mapping[str, TableSchema], now: datetime.datetime | None = None, groups: Mapping[str, Mapping[str, Sequence[str]]] | None = None, probe: Callable[[Step, DataFrame], None] | None = None) -> DataFrame:
    """One DataFrame of all steps. The last as_of holds for every source.

    groups: spellings by "alias.field" that stand for the same thing; equality
    and membership match all of them. probe: called with each step's relation.
    """
    dates = [s.args["date"] for s in steps if s.op == "as_of"]
    at = F.lit(now or datetime.datetime.now(datetime.UTC)) if dates and dates[-1] == "today" else F.lit(dates[-1]) if dates else None
    out: DataFrame | None = None
    aliases: list[tuple[str, str]] = []
    money: dict[str, str] = {}
    aggregated = False
    keys: list[str] = []

    def source(name: str, alias: str) -> DataFrame:
        aliases.append((alias, name))
        df = tables[name].select([F.col(f"`{c}`").alias(f"{alias}.{c}") for c in tables[name].columns])
        return df if at is None else _as_of(df, alias, at)

    for step in steps:
        a = step.args
        match step.op:
            case "filter":
                out = source(a["type"], a["alias"]) if a["type"] else out
                for ref, op, value in a["where"]:
                    out = out.where(_predicate(ref, op, value, (groups or {}).get(ref.name)))
            case "join":
                out = out.join(source(a["type"], a["alias"]), _column(a["left"]) == _column(a["right"]), "inner")
            case "aggregate":
                keys, aggregated = [k.name for k in a["keys"]], True
                built = []
                for name, (fn, ref) in a["measures"].items():
                    if ref is None:
                        built.append(F.count(F.lit(1)).alias(name))
                    elif ref.kind == "money" and fn != "count":
                        money[name] = ref.name
                        column = _column(ref)
                        built += [getattr(F, fn)(column["amount"]).alias(f"_a.{name}"), F.min(column["currency"]).alias(f"_c.{name}"), F.max(column["currency"]).alias(f"_d.{name}")]
                    else:
                        value = getattr(F, fn)(_column(ref))
                        built.append((F.coalesce(value, F.lit(0)) if fn in ("sum", "avg") else value).alias(name))
                out = out.groupBy(*[_column(k).alias(k.name) for k in a["keys"]]).agg(*built)
                for name in money:
                    mixed = F.col(f"`_c.{name}`") != F.col(f"`_d.{name}`")
                    amount = F.when(mixed, F.raise_error(F.concat(F.lit(f"mixed_currency in {name}: "), F.col(f"`_c.{name}`"), F.lit(", "), F.col(f"`_d.{name}`"))).cast("decimal(38,18)")).otherwise(F.col(f"`_a.{name}`"))
                    out = out.withColumn(name, F.struct(amount.cast("decimal(38,18)").alias("amount"), F.col(f"`_c.{name}`").alias("currency")))
                out = out.select([F.col(f"`{c}`") for c in [*keys, *a["measures"]]])
                for name, op, value in a["having"]:
                    out = out.where(_money(F.col(name), op, value) if name in money else _OPS[op](F.col(name), F.lit(value)))
            case "order":
                built = []
                for name, kind, direction in a["by"]:
                    column = F.col(f"`{name}`") if kind != "currency" else F.col(f"`{name}`" if aggregated else f"`{name.removesuffix('__currency')}`")
                    parts = [column["currency"], column["amount"]] if kind == "money" else [column if kind != "currency" or aggregated else column["currency"]]
                    built += [p.desc_nulls_last() if direction == "desc" else p.asc_nulls_first() for p in parts]
                ties = [F.col(f"`{k}`") for k in keys] if aggregated else [F.col(f"`{alias}.{catalogue[name].primary}`") for alias, name in aliases]
                out = out.orderBy(*built, *ties)
            case "limit":
                out = out.limit(a["n"])
        if probe and out is not None:
            probe(step, out)
    return out


def execute(plan: Any, tables: Mapping[str, DataFrame], catalogue: Mapping[str, TableSchema], now: datetime.datetime | None = None, groups: Mapping[str, Mapping[str, Sequence[str]]] | None = None) -> DataFrame:
    """Validates and lowers a plan. Lazy: nothing runs until the result is read."""
    return lower(validate(plan, catalogue), tables, catalogue, now, groups)


def report(plan: Any, tables: Mapping[str, DataFrame], catalogue: Mapping[str, TableSchema], now: datetime.datetime | None = None, a_step: int = MAX_ROWS_A_STEP, total: int = MAX_ROWS) -> dict:
    """Runs a plan under the caller's caps: status ok, empty or capped, rows after each step and the rows.

    Each step is probed by a count that stops one row past its cap.
    """
    steps, seen, used = [], 0, 0

    def probe(step: Step, df: DataFrame) -> None:
        nonlocal seen, used
        seen += 1
        rows = df.limit(a_step + 1).count()
        if rows > a_step and step.op in ("filter", "join", "aggregate"):
            raise Capped(f"step {seen} leaves more than {a_step} rows")
        used += rows
        if used > total:
            raise Capped(f"more than {total} rows in all steps")
        steps.append({"op": step.op, "rows": rows})

    try:
        out = lower(validate(plan, catalogue), tables, catalogue, now, probe=probe)
    except Capped as e:
        return {"status": "capped", "message": str(e), "steps": steps, "rows": []}
    rows = [r.asDict(recursive=True) for r in out.limit(a_step).collect()]
    return {"status": "ok" if rows else "empty", "steps": steps, "columns": out.columns, "rows": rows, "row_count": len(rows)}


def unreviewed(rows: DataFrame, values: DataFrame, key: str, threshold: float) -> DataFrame:
    """rows with a flag: does a value they rest on need review or lie under the confidence threshold?

    values: entity, needs_review, confidence.
    """
    open_values = values.where(F.col("needs_review") | (F.col("confidence") < threshold)).select(F.col("entity").alias(key)).distinct().withColumn("unreviewed", F.lit(True))
    return rows.join(open_values, key, "left").withColumn("unreviewed", F.coalesce("unreviewed", F.lit(False)))
