"""Bulk readers, the row router, type inference and sinks of files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.scalar import sanitise_identifier
from quern.types import KINDS, ColumnSpec, TableSchema, decode

#: From the narrowest kind to the widest.
INFERRED = ("integer", "float", "boolean", "date", "datetime")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken lines): a line that isn't JSON is set aside and doesn't stop the load."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_r"))
    return parsed.where("_r._corrupt is null").select("_r.*").drop("_corrupt"), parsed.where("_r._corrupt is not null").select(F.col("value").alias("line"))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """id, text and the whole row as JSON in metadata, of a file with a header and quotes doubled in quotes."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    pick = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(pick("id").alias("id"), pick("text").alias("text"), F.to_json(F.struct(*rows.columns)).alias("metadata"))


def route(objects: DataFrame, column: str = "json") -> DataFrame:
    """objects with a target: named by themselves, else by shape: edges have two ends, vectors numbers, texts a text, nodes a type."""
    field = lambda *names: F.coalesce(*[F.get_json_object(column, f"$.{n}") for n in names])
    named = field("target")
    known = ("graph.node", "graph.edge", "vector", "verbatim")
    shape = F.when(field("source", "source_id").isNotNull() & field("to", "target_id").isNotNull(), "graph.edge").when(field("vector", "embedding").isNotNull(), "vector").when(field("type").isNotNull() & field("label").isNotNull(), "graph.node").when(field("text").isNotNull(), "verbatim")
    return objects.withColumn("target", F.when(named.isin(*known), named).otherwise(F.coalesce(shape, F.lit("unknown"))))


def reject_reason(df: DataFrame, workspace: str) -> Column:
    """Why a bulk row is refused, or null: no id, another workspace, an edge without both ends and a relation."""
    has = lambda c: F.col(c).isNotNull() if c in df.columns else F.lit(False)
    edge = F.col("target") == "graph.edge" if "target" in df.columns else F.lit(False)
    other = F.col("workspace").isNotNull() & (F.col("workspace") != workspace) if "workspace" in df.columns else F.lit(False)
    return F.when(other, "workspace_mismatch").when(edge & ~(has("source_id") & has("target_id") & has("relation")), "edge_incomplete").when(~edge & ~has("id"), "missing_id")


def infer_kinds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, kind: the narrowest kind that every value that isn't blank can be read as; text where none is. One pass."""
    built = []
    for i, c in enumerate(columns):
        text = F.col(f"`{c}`").cast("string")
        filled = text.isNotNull() & (F.trim(text) != "")
        built += [F.coalesce(F.min(F.when(filled, decode(text, k).isNotNull())), F.lit(False)).alias(f"{i}_{k}") for k in INFERRED]
    flags = df.agg(*built)
    rows = []
    for i, c in enumerate(columns):
        kind = F.lit("string")
        for k in reversed(INFERRED):
            kind = F.when(F.col(f"{i}_{k}"), k).otherwise(kind)
        rows.append(F.struct(F.lit(c).alias("column"), kind.alias("kind")))
    return flags.select(F.inline(F.array(*rows)))


def infer_schema(df: DataFrame, name: str) -> TableSchema:
    """Clean, distinct column names with inferred kinds, after the trace columns of an import."""
    spark, names = df.sparkSession, []
    clean = spark.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "i int, c string").select("i", sanitise_identifier(F.col("c")).alias("c")).orderBy("i").collect()
    taken = {"_row_id", "_import_id", "_source_file", "_source_row", *(r["c"] for r in clean)}
    for r in clean:
        name, n = r["c"], 1
        while name in names or n > 1 and name in taken:  # a suffix never makes a name that another column has
            n += 1
            name = f"{r['c']}_{n}"
        names.append(name)
    kinds = {r["column"]: r["kind"] for r in infer_kinds(df, df.columns).collect()}
    trace = (ColumnSpec("_row_id", primary=True), ColumnSpec("_import_id"), ColumnSpec("_source_file"), ColumnSpec("_source_row", "integer"))
    return TableSchema(name, trace + tuple(ColumnSpec(n, kinds[c]) for n, c in zip(names, df.columns, strict=True)))


def coerce(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Text columns as their kinds, blanks null; what can't be read stays as text in <column>_raw."""
    built = []
    for c in df.columns:
        kind, text = kinds.get(c, "string"), F.col(c).cast("string")
        blank = F.trim(text) == ""
        value = F.when(~blank, decode(text, kind)).cast(KINDS[kind])
        built.append(value.alias(c))
        if kind != "string":
            built.append(F.when(~blank & value.isNull(), text).alias(f"{c}_raw"))
    return df.select(built)


def write_structured(results: DataFrame, folder: str, job: str = "job_id") -> None:
    """Items of extraction jobs, a partition a job; a job written again replaces its own rows only."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(job).parquet(folder)


def structured_items(results: DataFrame, column: str = "result", job: str = "job_id") -> DataFrame:
    """job_id, item, key, value, kind of a JSON list of flat objects; nested values stay JSON."""
    items = results.select(job, F.posexplode(F.from_json(column, "array<map<string,string>>")).alias("item", "_m"))
    out = items.select(job, "item", F.explode("_m").alias("key", "value"))
    text = F.col("value")
    kind = F.when(text.rlike(r"^-?\d+$"), "integer").when(text.rlike(r"^-?\d+\.\d+$"), "float").when(F.lower(text).isin("true", "false"), "boolean").when(text.rlike(r"^\s*[\[{]"), "json").otherwise("string")
    return out.withColumn("kind", kind)


def files(spark: SparkSession, folder: str, glob: str = "*", contents: bool = False) -> DataFrame:
    """path, length, modified (and content) of files under a folder."""
    out = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return out.select("path", "length", F.col("modificationTime").alias("modified"), *(["content"] if contents else []))


def archive(df: DataFrame, folder: str, content: str = "content") -> DataFrame:
    """Moves contents to a store addressed by SHA-256 and keeps the reference. Equal contents are stored once."""
    marked = df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    marked.select("sha256", content).dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(folder)
    return marked.withColumn("source_ref", F.concat(F.lit("sha256:"), "sha256")).drop(content, "sha256")


def backup(tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """A bundle of tables with a manifest of their digests."""
    from quern.operators.tables import digest

    rows = None
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        one = digest(df).withColumn("table", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    rows.coalesce(1).write.mode("overwrite").json(f"{folder}/_manifest")
    return rows


def verify_backup(spark: SparkSession, folder: str) -> DataFrame:
    """table, ok of a bundle: do the tables still have the digests of the manifest?"""
    from quern.operators.tables import digest

    out = None
    for r in spark.read.json(f"{folder}/_manifest").collect():  # a row a table
        one = digest(spark.read.parquet(f"{folder}/{r['table']}")).select(F.lit(r["table"]).alias("table"), ((F.col("rows") == r["rows"]) & (F.col("digest") == r["digest"])).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out
