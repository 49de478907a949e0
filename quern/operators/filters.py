"""Filter trees as Column expressions.

A leaf maps operators (eq, contains, startsWith, gt, gte, lt, lte, in) to
{field: value}; everything in it holds together. Nodes are {"and": [...]},
{"or": [...]}, {"not": node}. An empty leaf is true, blank text operators are
ignored, ``in`` of nothing is false, and nesting is at most 8.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.types import TableError

MAX_NESTING = 8
_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c.isNull() if v is None else c == v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)) if v else F.lit(False),
}


def _text(column: Column, value: str, prefix: bool, sensitive: bool) -> Column | None:
    if not isinstance(value, str) or not value.strip():
        return None
    text, value = (column.cast("string"), value) if sensitive else (F.lower(column.cast("string")), value.lower())
    return text.startswith(value) if prefix else text.contains(value)


def leaf(node: Mapping[str, Mapping[str, Any]], column: Callable[[str], Column] = F.col, case_sensitive: bool = False) -> Column:
    parts: list[Column] = []
    for op, fields in node.items():
        if op not in _COMPARE and op not in ("contains", "startsWith"):
            raise TableError("unknown_operator", op)
        for name, value in (fields or {}).items():
            found = _COMPARE[op](column(name), value) if op in _COMPARE else _text(column(name), value, op == "startsWith", case_sensitive)
            if found is not None:
                parts.append(found)
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if parts else F.lit(True)


def compile_filter(node: Mapping | None, column: Callable[[str], Column] = F.col, case_sensitive: bool = False, depth: int = 0) -> Column:
    """The Column of a filter tree."""
    if not node:
        return F.lit(True)
    if depth > MAX_NESTING:
        raise TableError("filter_too_nested", f"more than {MAX_NESTING} levels")
    below = lambda n: compile_filter(n, column, case_sensitive, depth + 1)
    for name, join in (("and", lambda a, b: a & b), ("or", lambda a, b: a | b)):
        if isinstance(node.get(name), (list, tuple)):
            if not node[name]:
                raise TableError("empty_branch", name)
            return reduce(join, map(below, node[name]))
    if isinstance(node.get("not"), Mapping):
        return ~below(node["not"])
    return leaf(node, column, case_sensitive)


def scope(node: Mapping | None, depth: int = 0) -> str:
    """ALL, NONE, SCOPED or INVALID: what a filter can match, from its shape alone."""
    if not node:
        return "ALL"
    if depth > MAX_NESTING:
        return "INVALID"
    if isinstance(node.get("not"), Mapping):
        inner = scope(node["not"], depth + 1)
        return {"ALL": "NONE", "NONE": "ALL"}.get(inner, inner)
    for name, wins, needs in (("and", "NONE", "ALL"), ("or", "ALL", "NONE")):
        if isinstance(node.get(name), (list, tuple)):
            parts = {scope(n, depth + 1) for n in node[name]}
            if not parts or "INVALID" in parts:
                return "INVALID"
            return wins if wins in parts else needs if parts == {needs} else "SCOPED"
    if any(not v for v in (node.get("in") or {}).values()):
        return "NONE"
    text = any(isinstance(v, str) and v.strip() for op in ("contains", "startsWith") for v in (node.get(op) or {}).values())
    return "SCOPED" if text or any(node.get(op) for op in _COMPARE) else "ALL"


def guard(node: Mapping | None, all_rows: bool) -> None:
    """Refuses a destructive filter that may match every row unless all_rows is set."""
    found = scope(node)
    if found == "INVALID":
        raise TableError("invalid_filter", "malformed tree")
    if found == "ALL" and not all_rows:
        raise TableError("all_rows", "the filter matches every row; pass all_rows=True")


# The hosted algebra: "all", {"field": ...}, {"id_eq": id}, and/or/not, with thirteen operators.


def engine_filter(node: Any, id_column: str = "id") -> Column:
    if node == "all":
        return F.lit(True)
    if "id_eq" in node:
        return F.col(id_column) == node["id_eq"]
    if "and" in node or "or" in node:
        name = "and" if "and" in node else "or"
        if not node[name]:
            raise TableError("empty_branch", name)
        return reduce((lambda a, b: a & b) if name == "and" else (lambda a, b: a | b), [engine_filter(n, id_column) for n in node[name]])
    if "not" in node:
        return ~engine_filter(node["not"], id_column)
    clause = node["field"]
    column, op, value = F.col(clause["field"]), clause["operator"], _value(clause.get("value"))
    match op:
        case "ne":
            return column != value
        case "nin":
            return ~column.isin(value)
        case "contains":
            return column.contains(value)
        case "starts_with":
            return column.startswith(value)
        case "ends_with":
            return column.endswith(value)
        case "exists":
            return column.isNotNull() if value in (True, None) else column.isNull()
        case "regex":
            return column.rlike(value)
        case _ if op in _COMPARE:
            return _COMPARE[op](column, value)
    raise TableError("unknown_operator", op)


def _value(value: Any) -> Any:
    if isinstance(value, Mapping):
        kind, inner = next(iter(value.items()))
        return [_value(v) for v in inner] if kind == "array" else inner
    return None if value == "null" else value


def has_all(column: Column, values: list[str]) -> Column:
    """An array column holds every value."""
    return F.size(F.array_except(F.array(*map(F.lit, values)), F.coalesce(column, F.array().cast("array<string>")))) == 0 if values else F.lit(True)


def delimited_has_all(column: Column, values: list[str], mark: str = ",") -> Column:
    """A delimited list in a string column holds every value."""
    return has_all(F.transform(F.split(F.coalesce(column, F.lit("")), mark), lambda v: F.trim(v)), values)


def json_has_all(column: Column, path: str, values: list[str]) -> Column:
    """The array at a path of a JSON column holds every value."""
    return has_all(F.from_json(F.get_json_object(column, path), "array<string>"), values)


def in_ecosystem(column: Column, scope_name: str | None) -> Column:
    """Rows of the ecosystem and rows of none: blank or a star; no scope matches all."""
    if scope_name is None or scope_name in ("", "*"):
        return F.lit(True)
    return F.coalesce(F.trim(column), F.lit("")).isin(scope_name, "", "*")


def visible(scopes: Column, actor: list[str] | None) -> Column:
    """Row-level scopes: no actor sees all, rows without scopes are public, else the scopes must meet."""
    if actor is None:
        return F.lit(True)
    public = F.coalesce(F.size(scopes), F.lit(0)) <= 0
    return public | F.arrays_overlap(scopes, F.array(*map(F.lit, actor))) if actor else public


def id_prefix(column: Column, prefix: str) -> Column:
    """Ids with a prefix, as a range that reaches the scan."""
    return column.startswith(prefix)


def by_ids(df: DataFrame, ids: list, id_column: str = "id") -> DataFrame:
    """Rows of the ids given, in their order; unknown ids are left out, repeated ones repeat."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"_place long, {id_column} {df.schema[id_column].dataType.simpleString()}")
    return df.join(F.broadcast(wanted) if len(ids) <= 10_000 else wanted, id_column).orderBy("_place").drop("_place").select(df.columns)
