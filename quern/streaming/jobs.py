"""Structured Streaming: ingestion, event-time windows, last-write-wins state."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = T.StructType([*(T.StructField(n, T.StringType()) for n in ("id", "workspace", "operation_kind", "payload")), T.StructField("received_at", T.TimestampType())])


def files(spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream, so many a batch at most."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)


def validated(events: DataFrame, line_bytes: int = 1 << 20) -> DataFrame:
    """Events with an error: no id, another operation than stream.event, a payload that is no JSON or too long; else null."""
    bad_json = F.get_json_object("payload", "$").isNull()
    return events.withColumn("error", F.when(F.col("id").isNull(), "missing_id").when(F.col("operation_kind") != "stream.event", "bad_kind").when(F.octet_length("payload") > line_bytes, "too_long").when(bad_json, "bad_payload"))


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes what is there now, batch by batch, and returns; a restart goes on after the last batch that ended."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def outbox(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes good events and dead letters apart, a folder a batch, so that a batch done twice is there once."""

    def write(batch: DataFrame, number: int) -> None:
        checked = validated(batch).persist()
        checked.where("error is null").drop("error").write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        checked.where("error is not null").write.mode("overwrite").parquet(f"{folder}/dead/batch={number}")
        checked.unpersist()

    return write


def latest_per_key(batch: DataFrame, key: str, sequence: str) -> DataFrame:
    """One entry a key: queued upserts that a newer upsert or delete follows are skipped."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), sequence).alias("_v")).select(key, "_v.*")


def tumbling(events: DataFrame, time: str, width: str, late: str = "5 minutes", *keys: str) -> DataFrame:
    """Counts and sums by window; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("count"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *keys, "count", "value")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "5 minutes") -> DataFrame:
    """A row a session: runs of a key's events with gaps below the given one."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def deduplicated(events: DataFrame, ident: str, time: str, late: str = "5 minutes") -> DataFrame:
    """Rows once an id, re-sent ones within the watermark dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([ident])


def access_stamps(reads: DataFrame, ident: str = "id", time: str = "at") -> DataFrame:
    """Many reads of an id as one stamp: id, last_accessed_at, accesses."""
    return reads.groupBy(ident).agg(F.max(time).alias("last_accessed_at"), F.count("*").alias("accesses"))


_LWW_STATE = "value string, wall long, lamport long, device string"


def lww_stream(changes: DataFrame) -> DataFrame:
    """node_id, field, value, applied of each batch's winner a field, against the state of all batches before.

    Later by wall clock, then Lamport time, then device; an exact tie keeps what is there.
    """

    def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get if state.exists else None
        before = current
        for batch in batches:
            for r in batch.itertuples(index=False):
                stamp = (int(r.wall_clock_ms), int(r.lamport), r.device_id)
                if current is None or stamp > tuple(current[1:]):
                    current = (r.value, *stamp)
        state.update(current)
        yield pd.DataFrame({"node_id": [key[0]], "field": [key[1]], "value": [current[0]], "applied": [current != before]})

    return changes.groupBy("node_id", "field").applyInPandasWithState(merge, "node_id string, field string, value string, applied boolean", _LWW_STATE, "update", GroupStateTimeout.NoTimeout)


def mirror(stream: DataFrame, adapters: dict[str, Callable[[DataFrame], None]], checkpoint: str) -> None:
    """Every batch to every registered target."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for adapter in adapters.values():
            adapter(held)
        held.unpersist()

    run(stream, write, checkpoint)


def incremental(rows: DataFrame, updated: str, watermark, overlap: str = "5 minutes") -> DataFrame:
    """Rows of a pass: changed since the last watermark less an overlap, in which late ones are seen again."""
    return rows.where(F.col(updated) >= F.lit(watermark).cast("timestamp") - F.expr(f"interval {overlap}"))


class Slots:
    """At most so many jobs of a workspace at once, and of all: a job that finds no slot is told when to come again."""

    def __init__(self, each: int = 2, total: int = 8, retry_seconds: int = 5):
        self.each, self.total, self.retry_seconds, self.held, self._lock = each, total, retry_seconds, {}, threading.Lock()

    def enter(self, workspace: str) -> int:
        """0 if the job may run, else the seconds to wait before another try."""
        with self._lock:
            if self.held.get(workspace, 0) >= self.each or sum(self.held.values()) >= self.total:
                return self.retry_seconds
            self.held[workspace] = self.held.get(workspace, 0) + 1
            return 0

    def leave(self, workspace: str) -> None:
        with self._lock:
            n = self.held.get(workspace, 0) - 1
            self.held.pop(workspace, None) if n <= 0 else self.held.update({workspace: n})
