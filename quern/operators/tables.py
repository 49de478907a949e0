"""Typed tables in a folder of Parquet, with versions swapped whole.

A table is a folder of data and of commits (00000001, ...), each a file that
names the schema and the data of a version. A write stages its data and then
creates the commit after the one that it began from, with its content at once
and only if there is none: readers see all of a change or none, a lost job
leaves the old version, and of two writers that began from the same version one
is refused and may try again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import paging
from quern.operators.filters import compile_filter, guard
from quern.operators.linking import fingerprint
from quern.sources.folders import Folder
from quern.types import KINDS, ColumnSpec, TableError, TableSchema

MAX_OPS, MAX_BULK, MAX_BULK_BYTES = 100, 1000, 16 << 20


def issues(schema: TableSchema, columns: Sequence[str], mode: str = "insert") -> Column:
    """The first reason to refuse a row, or null: an unknown column, a missing required or a mistyped value (as text)."""
    unknown = [c for c in columns if schema.get(c) is None]
    if unknown:
        return F.lit(f"unknown_column: {unknown[0]}")
    out = F.lit(None).cast("string")
    for c in schema.columns:
        need = c.primary or c.required and mode != "update"
        if c.name in columns:
            out = F.coalesce(out, F.when(F.col(c.name).isNull(), f"required: {c.name}") if need else F.lit(None).cast("string"))
        elif need:
            out = F.coalesce(out, F.lit(f"required: {c.name}"))
    return out


def update(rows: DataFrame, where: Mapping | None, patch: Mapping[str, Any], all_rows: bool = False) -> DataFrame:
    """Rows with a patch where the filter holds (a null test is false)."""
    guard(where, all_rows)
    hit = F.coalesce(compile_filter(where), F.lit(False))
    return rows.withColumns({c: F.when(hit, F.lit(v).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in patch.items()})


def delete(rows: DataFrame, where: Mapping | None, all_rows: bool = False) -> DataFrame:
    guard(where, all_rows)
    return rows.where(~F.coalesce(compile_filter(where), F.lit(False)))


def upsert(rows: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Supplied columns replace those of known keys; other keys are added. One full join on the key."""
    new = incoming.select([F.col(c).alias(f"_n_{c}") if c != key else F.col(c) for c in incoming.columns] + [F.lit(True).alias("_in")])
    out = rows.join(new, key, "full_outer")
    return out.select([F.when(F.col("_in"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c != key and c in incoming.columns else F.col(c) for c in rows.columns])


def union_schema(existing: TableSchema, new: TableSchema) -> TableSchema:
    """Known columns as they are, new ones after them."""
    return TableSchema(existing.name, existing.columns + tuple(c for c in new.columns if existing.get(c.name) is None))


def evolution(old: TableSchema, new: TableSchema) -> list[tuple[str, str]]:
    """Steps from a schema to the next: add_column, add_index, extract. Anything else is refused."""
    steps = []
    for c in old.columns:
        now = new.get(c.name)
        if now is None:
            raise TableError("drop_column", c.name)
        if now.kind != c.kind or now.primary != c.primary:
            raise TableError("retype_column", c.name)
        if now.unique and not c.unique:
            raise TableError("add_unique", c.name)
        steps += [("add_index", c.name)] if now.indexed and not c.indexed else []
        steps += [("extract", f"{c.name}__{k}") for k, kind in now.extracted if (k, kind) not in c.extracted]
    for c in new.columns:
        if old.get(c.name) is None:
            if c.unique:
                raise TableError("add_unique", c.name)
            steps.append(("add_column", c.name))
    return steps


def evolve(rows: DataFrame, old: TableSchema, new: TableSchema) -> DataFrame:
    """rows with the new columns: required ones filled with 0 or empty text, extracted ones read from their JSON."""
    for step, name in evolution(old, new):
        if step == "add_column":
            spec = new.get(name)
            fill = {"integer": 0, "float": 0.0, "boolean": False}.get(spec.kind, "") if spec.required else None
            rows = rows.withColumn(name, F.lit(fill).cast(KINDS[spec.kind]))
    return extract(rows, new)


def extract(rows: DataFrame, schema: TableSchema) -> DataFrame:
    """The typed columns of JSON keys, column__key."""
    return rows.withColumns({f"{c.name}__{key}": F.get_json_object(c.name, f"$.{key}").try_cast(KINDS[kind]) for c in schema.columns for key, kind in c.extracted}) if any(c.extracted for c in schema.columns) else rows


def digest(rows: DataFrame) -> DataFrame:
    """rows, digest: a digest of all rows that doesn't depend on their order; equal tables have equal ones.

    Each row's SHA-256 is added up in four 16-hex-digit parts.
    """
    code = fingerprint(rows, sorted(rows.columns))
    parts = [F.coalesce(F.sum(F.conv(F.substring(code, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(4)]
    return rows.agg(F.count("*").alias("rows"), F.concat_ws("-", *parts).alias("digest"))


def plan_copy(source: DataFrame, target: DataFrame | None, key: str) -> DataFrame:
    """disposition, rows of a copy: copy (absent), done (equal), conflict (another row of the key), extra (only in the target)."""
    if target is None:
        return source.agg(F.lit("copy").alias("disposition"), F.count("*").alias("rows"))
    if source.dtypes != target.dtypes:
        raise TableError("schema_mismatch", f"{source.dtypes} and {target.dtypes}")
    side = lambda df, name: df.select(key, fingerprint(df, df.columns).alias(name))
    both = side(source, "_s").join(side(target, "_t"), key, "full_outer")
    return both.groupBy(F.when(F.col("_t").isNull(), "copy").when(F.col("_s").isNull(), "extra").when(F.col("_s") == F.col("_t"), "done").otherwise("conflict").alias("disposition")).agg(F.count("*").alias("rows"))


class Store:
    """Typed tables under a folder, of any file system, that the driver and the executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Folder(spark, folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")

    def version(self, name: str) -> int:
        """The current version, 0 where there is no such table."""
        return max((int(n) for n in self.folder.names(f"{name}/commits") if n.isdigit()), default=0)

    def _read_commit(self, name: str, version: int | None = None) -> tuple[int, TableSchema, str]:
        version = self.version(name) if version is None else version
        if not version:
            raise TableError("unknown_table", name)
        raw = json.loads(self.folder.read(f"{name}/commits/{version:08d}"))
        return version, TableSchema(name, tuple(ColumnSpec(**c | {"extracted": tuple(map(tuple, c["extracted"]))}) for c in raw["columns"])), raw["data"]

    def schema(self, name: str) -> TableSchema:
        return self._read_commit(name)[1]

    def create(self, schema: TableSchema) -> None:
        """Idempotent for the same shape, an error for another."""
        if not self.version(schema.name):
            try:
                return self._commit(0, schema, self.spark.createDataFrame([], schema.struct()))
            except TableError as e:
                if e.code != "write_conflict":
                    raise
        if self.schema(schema.name).columns != schema.columns:
            raise TableError("schema_conflict", schema.name)

    def _commit(self, base: int, schema: TableSchema, rows: DataFrame) -> None:
        """Writes rows as the version after base."""
        data = f"{schema.name}/data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder.uri}/{data}")
        if not self.folder.create(f"{schema.name}/commits/{base + 1:08d}", json.dumps({"columns": [asdict(c) for c in schema.columns], "data": data})):
            raise TableError("write_conflict", f"{schema.name} has a version after {base}")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        _, schema, data = self._read_commit(name, version)
        return self.spark.read.schema(schema.struct()).parquet(f"{self.folder.uri}/{data}")

    def list(self, counts: bool = False, after: str = "", limit: int = 100) -> list[dict]:
        names = [n for n in self.folder.names() if n > after and self.version(n)][:limit]
        return [{"name": n, "columns": len(self.schema(n).columns)} | ({"rows": self.read(n).count()} if counts else {}) for n in names]

    def _checked(self, schema: TableSchema, rows: DataFrame, mode: str) -> DataFrame:
        bad = rows.withColumn("_bad", issues(schema, rows.columns, mode)).where("_bad is not null").select("_bad").limit(1).collect()
        if bad:
            raise TableError("invalid_row", bad[0]["_bad"])
        kinds = schema.kinds()
        full = rows.select([F.col(c).cast(KINDS[kinds[c]]) for c in rows.columns])
        missing = [c.name for c in schema.columns if c.name not in rows.columns]
        full = full.withColumns({c: F.lit(None).cast(KINDS[kinds[c]]) for c in missing}) if missing and mode == "insert" else full
        return extract(full, schema).select(schema.struct().names) if mode == "insert" else full

    def _unique(self, schema: TableSchema, rows: DataFrame) -> None:
        for c in schema.columns:
            if c.primary or c.unique:
                if not rows.where(F.col(c.name).isNotNull()).groupBy(c.name).count().where("count > 1").isEmpty():
                    raise TableError("duplicate_key", c.name)

    def insert(self, name: str, rows: DataFrame | Sequence[Mapping]) -> None:
        """All rows or none."""
        self.transaction(name, [("insert", rows)])

    def bulk_insert(self, name: str, records: Sequence[Mapping]) -> int:
        if len(records) > MAX_BULK or len(json.dumps(list(records), default=str)) > MAX_BULK_BYTES:
            raise TableError("bulk_limit", f"{MAX_BULK} records and {MAX_BULK_BYTES} bytes")
        self.insert(name, records)
        return len(records)

    def query(self, name: str, where: Mapping | None = None, **options) -> DataFrame:
        return paging.query(self.read(name), where, **options)

    def get(self, name: str, key) -> DataFrame:
        return paging.by_key(self.read(name), self.schema(name).primary, key)

    def count(self, name: str, where: Mapping | None = None) -> int:
        return self.read(name).where(compile_filter(where)).count()

    def update(self, name: str, where: Mapping | None, patch: Mapping, all_rows: bool = False) -> None:
        self.transaction(name, [("update", where, patch, all_rows)])

    def delete(self, name: str, where: Mapping | None, all_rows: bool = False) -> None:
        self.transaction(name, [("delete", where, all_rows)])

    def upsert(self, name: str, rows: DataFrame | Sequence[Mapping]) -> None:
        self.transaction(name, [("upsert", rows)])

    def truncate(self, name: str) -> int:
        version, schema, _ = self._read_commit(name)
        before = self.read(name, version)
        n = before.count()
        self._commit(version, schema, before.limit(0))
        return n

    def evolve(self, new: TableSchema) -> list[tuple[str, str]]:
        version, old, _ = self._read_commit(new.name)
        steps, rows = evolution(old, new), evolve(self.read(new.name, version), old, new)
        self._commit(version, new, rows.select(new.struct().names))
        return steps

    def _frame(self, schema: TableSchema, rows: DataFrame | Sequence[Mapping]) -> DataFrame:
        if isinstance(rows, DataFrame):
            return rows
        names = list(dict.fromkeys(c for r in rows for c in r))
        unknown = [c for c in names if schema.get(c) is None]
        if unknown:
            raise TableError("unknown_column", unknown[0])
        kinds = ", ".join(f"`{c}` {KINDS[schema.get(c).kind].simpleString()}" for c in names)
        return self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], kinds)

    def transaction(self, name: str, ops: Sequence[tuple]) -> None:
        """At most 100 ops in order, folded into one plan and committed once; an error names the op that failed.

        Keys are checked once, after the last op; if one is there twice, op by op, to name it.
        """
        if len(ops) > MAX_OPS:
            raise TableError("too_many_ops", f"at most {MAX_OPS}")
        version, schema, _ = self._read_commit(name)
        before = self.read(name, version)
        rows = self._apply(schema, before, ops)
        try:
            self._unique(schema, rows)
        except TableError:
            self._apply(schema, before, ops, check=True)
            raise
        self._commit(version, schema, rows.select(schema.struct().names))

    def _apply(self, schema: TableSchema, rows: DataFrame, ops: Sequence[tuple], check: bool = False) -> DataFrame:
        for i, (op, *args) in enumerate(ops):
            try:
                match op:
                    case "insert":
                        rows = rows.unionByName(self._checked(schema, self._frame(schema, args[0]), "insert"))
                    case "upsert":
                        new = self._frame(schema, args[0])
                        self._unique(TableSchema(schema.name, tuple(c for c in schema.columns if c.primary)), new)
                        rows = extract(upsert(rows, self._checked(schema, new, "upsert"), schema.primary), schema)
                    case "update":
                        rows = extract(update(rows, *args), schema)
                    case "delete":
                        rows = delete(rows, *args)
                    case _:
                        raise TableError("unknown_op", op)
                if check:
                    self._unique(schema, rows)
            except Exception as e:
                e.add_note(f"failed op {i}: {op}")
                raise
        return rows


def fold(rows: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Edits of a changeset one after another, as one plan."""
    return reduce(lambda df, f: f(df), steps, rows)
