"""Structured Streaming over the job event log: states, change feed, stalls, rates.

An event is job_id, seq (ascending), ts, kind and, for some kinds, group_id and attempts' cap. States follow the same rules whether events arrive at once or bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S

EVENT = "job_id string, seq long, ts timestamp, kind string"
STATE = T.StructType([T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("seq", T.LongType())])
CHANGE = "job_id string, seq long, before string, status string, attempts int"


def step(status: str | None, attempts: int, kind: str) -> tuple[str | None, int]:
    """The status and attempts after an event. Events that a status doesn't admit change nothing; ended jobs stay ended."""
    ended = status in S.TERMINAL
    if kind == "enqueue" and status is None:
        return "queued", 0
    if status is None or ended and kind not in ("done", "error", "cancelled"):
        return status, attempts
    if kind in ("done", "error", "cancelled"):
        return kind, attempts
    if kind in ("claim", "promote") and status == "queued":
        return "processing", attempts
    if kind == "cancel":
        return ("cancelled" if status == "queued" else "cancel_requested"), attempts
    if kind == "stale" and status == "cancel_requested":
        return "cancelled", attempts
    if kind == "crash" or kind == "stale" and status == "processing":
        return ("error", attempts) if attempts + 1 >= S.MAX_ATTEMPTS else ("queued", attempts + 1)
    if kind == "drain" and status in ("queued", "processing", "saving"):
        return "queued", attempts
    return status, attempts


def fold(events: pd.DataFrame, status: str | None = None, attempts: int = 0) -> Iterator[tuple[int, str | None, str | None, int]]:
    """seq, status before, status and attempts after each event that changes either, by seq."""
    for seq, kind in events.sort_values("seq", kind="stable")[["seq", "kind"]].itertuples(index=False):
        new = step(status, attempts, kind)
        if new != (status, attempts):
            yield int(seq), status, *new
        status, attempts = new


class JobStates(StatefulProcessor):
    """One row for each change of a job's state. An event that is not behind the last one seen is dropped: the log is ordered by job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, attempts, last = self.state.get() if self.state.exists() else (None, 0, -1)
        events = pd.concat(list(rows))
        events = events[events["seq"] > last]
        if len(events):
            changes = list(fold(events, status, attempts))
            if changes:
                status, attempts = changes[-1][2], changes[-1][3]
            self.state.update((status, attempts, int(events["seq"].max())))
            if changes:
                yield pd.DataFrame([(key[0], *c) for c in changes], columns=["job_id", "seq", "before", "status", "attempts"])

    def close(self) -> None:
        pass


def job_states(events: DataFrame) -> DataFrame:
    """A stream of changes (CHANGE) from a stream of events; needs the RocksDB state store."""
    return events.groupBy("job_id").transformWithStateInPandas(JobStates(), CHANGE, "Append", "None")


def job_states_batch(events: DataFrame) -> DataFrame:
    """The same changes from a whole log. Events without seq have no place in it and are left out; those without job_id are one job's; of one job's that share a seq the order is by kind.

    One sort by job and seq, and a task walks its rows once: it holds a batch and the state of the job it is at, so neither many short jobs nor a long one cost more than their rows.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("job_id", pa.string()), ("seq", pa.int64()), ("before", pa.string()), ("status", pa.string()), ("attempts", pa.int32())])
        job, status, attempts = "", None, 0
        for batch in it:
            changes = []
            for event_job, seq, kind in zip(*(batch.column(c).to_pylist() for c in ("job_id", "seq", "kind")), strict=True):
                if event_job != job:
                    job, status, attempts = event_job, None, 0
                new = step(status, attempts, kind)
                if new != (status, attempts):
                    changes.append((job, seq, status, *new))
                status, attempts = new
            if changes:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*changes, strict=True), schema, strict=True)], schema=schema)

    rows = events.where(F.col("seq").isNotNull()).select("job_id", F.col("seq").cast("long").alias("seq"), "kind")
    return rows.repartition("job_id").sortWithinPartitions("job_id", "seq", "kind").mapInArrow(run, CHANGE)


def change_feed(jobs: DataFrame, publish) -> Any:
    """A writer for a stream of job rows (id, status, ...): each tick gives ``publish`` the jobs that are active and those that ended since the last tick."""

    def tick(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("id").agg(F.max_by("status", "updated_at").alias("status"))
        publish(number, newest.where(~F.col("status").isin(*S.TERMINAL)), newest.where(F.col("status").isin(*S.TERMINAL)))

    return jobs.writeStream.foreachBatch(tick)


def stalls(heartbeats: DataFrame, idle_s: int = S.IDLE_S, late: str = "1 minute") -> DataFrame:
    """Spells of each watched group (group, ts) without a gap of idle_s; a spell that closes is a stall unless the job has ended."""
    beats = heartbeats.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    spells = beats.groupBy("group", F.session_window("ts", f"{idle_s} seconds").alias("spell")).agg(F.count(F.lit(1)).alias("beats"))
    return spells.select("group", F.col("spell.start").alias("first"), F.col("spell.end").alias("stalled_at"), "beats")


def request_rates(requests: DataFrame, limit: int = S.RATE, late: str = "1 minute") -> DataFrame:
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    n = rows.groupBy("key", F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return n.select("key", F.col("w.start").alias("minute"), "requests", F.greatest(F.lit(0), F.col("requests") - limit).alias("refused"))
