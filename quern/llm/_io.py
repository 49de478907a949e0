"""Tables, shared folders and Arrow helpers of the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.session import ship


#: Rows of an Arrow batch at most: batches of whole texts then take a few MB.
ARROW_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get, where the session has the default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a local one is set only where the session names none and all of Spark is on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        known = context._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch that gives a batch or a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of runs of rows of equal keys."""
    change = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(keys[0])]
    return list(zip(edges[:-1], edges[1:], strict=True)) if len(keys[0]) else []


def whole(batches: Iterator[pa.RecordBatch], keys: Sequence[str], function: Callable[[pa.Table], Iterator], least: int = 1, spill: Callable[[pa.Table], Iterator] | None = None, most: int = 0) -> Iterator:
    """What function gives of tables of sorted rows in which no run of equal keys is cut, each of so many rows at least where there are more.

    spill: is given a run's rows instead, as soon as there are more than most of them.
    """
    held, rows, over = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        ends = tuple(batch.column(k)[-1].as_py() for k in keys)
        begins = tuple(held[0].column(k)[0].as_py() for k in keys)
        if begins == ends:
            if spill and rows > most:
                yield from spill(pa.Table.from_batches(held).combine_chunks())
                held, rows, over = [], 0, ends
            continue
        if rows < least:
            continue
        part = pa.Table.from_batches(held).combine_chunks()
        first, end = runs(*(part.column(k).to_numpy() for k in keys))[-1]
        ready, held, rows = part.slice(0, first), part.slice(first).to_batches(), end - first
        if over is not None:  # the rest of a run of which rows were given to spill
            first, end = runs(*(ready.column(k).to_numpy() for k in keys))[0]
            if tuple(ready.column(k)[0].as_py() for k in keys) == over:
                yield from spill(ready.slice(0, end).combine_chunks())
                ready = ready.slice(end)
            over = None
        if ready.num_rows:
            yield from function(ready.combine_chunks())
    if held:
        part = pa.Table.from_batches(held).combine_chunks()
        if over is not None and tuple(part.column(k)[0].as_py() for k in keys) == over:
            first, end = runs(*(part.column(k).to_numpy() for k in keys))[0]
            yield from spill(part.slice(0, end).combine_chunks())
            part = part.slice(end)
        if part.num_rows:
            yield from function(part.combine_chunks())


def release(spark: SparkSession) -> None:
    """Has Spark drop the shuffle files of what is done, which it else does whenever the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def packed(docs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """docs (or some columns of theirs) as one struct column _row: no name of theirs can clash with what is added."""
    small_batches(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)]).alias("_row"))


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A field of the struct column _row; null where the row is."""
    return pc.struct_field(batch.column("_row"), [batch.column("_row").type.get_field_index(name)])


def beside(docs: DataFrame, name: str, function: Callable[[], Callable[[pa.Array], dict]], new: dict[str, str], order: Sequence[str]) -> DataFrame:
    """docs with new columns (name: type) that a function makes of one column's batches, in the order given.

    function() is called once a task. Columns of the names replace those of
    docs; the others go along as they are, whatever their names.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c in order and c not in new]
    kept = [c for c in rest if c != name]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("nothing"))
    source = docs.select(row.alias("_row"), F.col(f"`{name}`").alias("_in"))
    made = [f"c{i}" for i in range(len(new))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = function()
        for batch in batches:
            out = one(batch.column("_in"))
            back = [batch.column("_in")] if name in rest else []
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *back, *(out[n] for n in new)], ["_row", *["_in"][: len(back)], *made])

    fields = [source.schema["_row"], *([source.schema["_in"]] if name in rest else []), *StructType.fromDDL(", ".join(f"c{i} {kind}" for i, kind in enumerate(new.values())) or "x int").fields[: len(new)]]
    out = source.mapInArrow(run, StructType(fields))
    at = {n: F.col(f"c{i}") for i, n in enumerate(new)} | {c: F.col(f"_row.`{c}`") for c in kept} | ({name: F.col("_in")} if name in rest else {})
    return out.select(*[at[c].alias(c) for c in order])


def carried(df: DataFrame, schema: str) -> StructType:
    """The schema of _row and of the columns named."""
    return StructType([df.schema["_row"], *StructType.fromDDL(schema).fields])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def widened(df: DataFrame, columns: Sequence[str], new: dict[str, Column]) -> DataFrame:
    """The columns packed in _row and new ones, which replace those of their names."""
    made = df.select("_row", F.struct(*[c.alias(n) for n, c in new.items()]).alias("_new"))
    return made.select(*[F.col(f"_row.`{c}`") for c in columns if c not in new], *[F.col(f"_new.`{n}`") for n in new])


def sampled(df: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most so many rows: all of them where there are no more, else those whose key's hash lies under a bound.

    The sample doesn't depend on partitions, and no more than it reaches one task.
    """
    n = df.count()
    if n <= most:
        return df
    bound = int(0.95 * most / n * (1 << 32))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 32)) < bound).limit(most)


def crc_fold(column: str = "doc_id"):
    """crc32 of a column's text, modulo 3: the fold by which labels are held out where it is 1."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3
