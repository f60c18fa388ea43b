"""The job queue as a stream: results once per key, and queue metrics, over a directory of events."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import shared_folder

_STATE_CLASS = "spark.sql.streaming.stateStore.providerClass"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An unbounded table of the files under ``path``, which may be a pattern; the schema is the present files'."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)
    return events.withColumn("at", F.col("ts").cast("timestamp"))


def once_per_key(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key: a repeated result of a job is accepted once.

    There is no watermark, as files come in any order of time: every key stays in the state, and no event is late.
    """
    return events.dropDuplicates(keys)


def queue_metrics(events: DataFrame) -> DataFrame:
    """Counts by state and day, kept up to date."""
    return events.groupBy("event_type", F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("oldest"))


_LEASE = "status string, attempts int, owner string, until long"


def lease_states(events: DataFrame, lease_ms: int, max_attempts: int) -> DataFrame:
    """(audit_id, status, attempts, owner), a row whenever an audit's state may have changed.

    Events are (audit_id, seq, at, worker, kind) with kind claim, finish or release; ``at`` is event time and ``seq`` orders
    what is of the same time. The state is the lease alone, however many events an audit has. A timer of event time ends a
    lease that nobody finished: the audit is queued again, without a new event.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, owner, until = state.get if state.exists else ("queued", 0, None, -1)
        if state.hasTimedOut:
            status, owner, until = "queued", None, -1
        else:
            for _, worker, kind, at in sorted(row for part in parts for row in zip(part["seq"], part["worker"], part["kind"], part["ms"], strict=True)):
                held = status == "running" and owner == worker and until >= at
                if kind == "claim" and (status == "queued" or (status == "running" and until < at)):
                    failed = attempts >= max_attempts
                    status, attempts, owner, until = ("failed", attempts, None, -1) if failed else ("running", attempts + 1, worker, int(at) + lease_ms)
                elif kind in ("finish", "release") and held:
                    status, owner, until = "complete" if kind == "finish" else "queued", None, -1
        state.update((status, attempts, owner, until))
        if status == "running":
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"audit_id": [key[0]], "status": [status], "attempts": [attempts], "owner": pd.Series([owner], dtype=object)})

    kind = dict(events.dtypes)["audit_id"]
    rows = events.withWatermark("at", "0 seconds").select("audit_id", "seq", "worker", "kind", "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("audit_id").applyInPandasWithState(fold, f"audit_id {kind}, status string, attempts int, owner string", _LEASE, "update", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB while a stream is started, so that keys needn't fit in memory; what the session had comes back."""
    given = spark.conf.get(_STATE_CLASS, None)
    spark.conf.set(_STATE_CLASS, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(_STATE_CLASS)
        else:
            spark.conf.set(_STATE_CLASS, given)


def drain_latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`drain_append` for updates: the last row of each key; a batch has one row a key at most."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    with _state_on_disk(spark):
        rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/out")
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "batch").alias("last"))
    return last.select(*keys, "last.*")


def drain_append(rows: DataFrame) -> DataFrame:
    """Runs the stream over what is there and returns what it wrote. State is kept on disk, so keys needn't fit in memory."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "stream")
    with _state_on_disk(spark):
        rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def drain_complete(rows: DataFrame) -> DataFrame:
    """As :func:`drain_append` for aggregates: the last version of the whole result."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "stream")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")
