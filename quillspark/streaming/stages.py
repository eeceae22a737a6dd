"""Progress events: server-sent frames, and the state of each stage, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The stage that an event's name belongs to.
STAGES = (("guidelines", "guidelines"), ("sufficiency", "sufficiency"), ("pubmed", "pubmed"), ("generation", "generation"), ("safety", "safety"), ("repair", "safety"), ("save", "save"))


def stage_of(event: Column) -> Column:
    out = F.when(event == "complete", "save")
    for prefix, stage in STAGES:
        out = out.when(event.startswith(prefix), stage)
    return out


def status_of(event: Column) -> Column:
    return F.when(event.endswith("_started"), "active").when(event == "error", "error").otherwise("done")


def stage_status(events: DataFrame, key: str, event: str, order: list[str]) -> DataFrame:
    """key, stage, status: the last event of a stage sets it; a stage left active is done once another has become active."""
    rows = events.select(key, stage_of(F.col(event)).alias("stage"), status_of(F.col(event)).alias("status"), F.struct(*order).alias("at")).where("stage is not null")
    last = rows.groupBy(key, "stage").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
    active = rows.where("status = 'active'").groupBy(F.col(key).alias("quill_key")).agg(F.max("at").alias("active_at"))
    both = last.join(active, last[key].eqNullSafe(F.col("quill_key")), "left")
    return both.select(key, "stage", F.when((F.col("status") == "active") & (F.col("at") < F.col("active_at")), "done").otherwise(F.col("status")).alias("status"))


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state with timers is kept by RocksDB; a session that has another store is set to it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LastOfStages(StatefulProcessor):
    """Of each stage of a key its last event by time, and the last time any stage became active; whatever order events come in, the state is the same.

    A timer at the key's last event and its time to keep removes the state: finished_ms after a key that is complete, idle_ms otherwise.
    """

    def __init__(self, finished_ms: int, idle_ms: int):
        self.finished_ms, self.idle_ms = finished_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stages = handle.getMapState("stages", "stage string", "at long, tie string, status string")
        self.marks = handle.getValueState("marks", "active_at long, active_tie string, last_at long, finished boolean, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        now = {stage[0]: (value[0], value[1], value[2]) for stage, value in self.stages.iterator()}
        before = dict(now)
        active, last, finished, timer = (), None, False, None
        if self.marks.exists():
            active_at, active_tie, last, finished, timer = self.marks.get()
            active = () if active_at is None else (active_at, active_tie)
        for batch in rows:
            for stage, status, event, at, tie in zip(*(batch[c] for c in ("stage", "status", "event", "at", "tie")), strict=True):
                now[stage] = max(now.get(stage, (at, tie, status)), (at, tie, status))
                if status == "active":
                    active = max(active, (at, tie))
                last, finished = at if last is None else max(last, at), finished or event == "complete"
        for stage, value in now.items():
            if before.get(stage) != value:
                self.stages.updateValue((stage,), value)
        due = last // 1000 + (self.finished_ms if finished else self.idle_ms)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.marks.update((*(active or (None, None)), last, finished, due))
        status = ["done" if s == "active" and (at, tie) < active else s for at, tie, s in now.values()]
        yield pd.DataFrame({"key": [key[0]] * len(now), "stage": [*now], "status": status}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.stages.clear()
        self.marks.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_stage_status(events: DataFrame, key: str, event: str, at: str, tie: str | None = None, late: str = "1 hour", keep_finished: str = "1 hour", keep_idle: str = "7 days") -> DataFrame:
    """stage_status over a stream, by event time (a timestamp; equal times by tie): each batch gives the present state of the keys it touched.

    Events may come in any order within the watermark of so much lateness. A key's state is a few values a stage and goes when the watermark has passed its last event
    by keep_finished, if it is complete, or by keep_idle. Null keys, and events of no stage, are left out.
    """
    keep_state_in_rocksdb(events.sparkSession)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("quill_time", F.col(at).cast("timestamp")).withWatermark("quill_time", late)
    rows = rows.select(
        F.col(key).cast("string").alias("key"), stage_of(F.col(event)).alias("stage"), status_of(F.col(event)).alias("status"), F.col(event).alias("event"), micros.alias("at"),
        (F.lit("") if tie is None else F.lpad(F.col(tie).cast("string"), 20, "0")).alias("tie"), "quill_time",
    ).where("stage is not null")
    keep = [int(pd.Timedelta(x).total_seconds() * 1000) for x in (keep_finished, keep_idle)]
    return rows.groupBy("key").transformWithStateInPandas(LastOfStages(*keep), "key string, stage string, status string", "update", "eventTime")


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def sse_frame(stage: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), stage, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def sse_events(streams: DataFrame, key: str, stream: str, schema: str) -> DataFrame:
    """key, at, stage, data: the frames of a buffer, each ended by a blank line; of each the first data line, parsed. What follows the last blank line is not whole and gives none."""
    whole = F.split(stream, "\n\n")
    return parsed_frames(streams.select(key, F.posexplode(F.slice(whole, 1, F.size(whole) - 1)).alias("at", "frame")), key, schema)


def parsed_frames(frames: DataFrame, key: str, schema: str) -> DataFrame:
    line = lambda name: F.regexp_extract("frame", rf"(?m)^{name}: (.*)$", 1)
    return frames.where(F.col("frame").rlike("(?m)^data: ")).select(key, "at", line("event").alias("stage"), F.from_json(line("data"), schema).alias("data"))


class Frames(StatefulProcessor):
    """Carries what is cut off at a chunk's end, bytes of half a character included, and chunks that come before their turn, to the next batch of their stream.

    Chunks are numbered from 0; one that comes again changes nothing. When the watermark has passed a stream's last chunk by idle_ms its state goes.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", "rest binary, due long, frames long, last_ms long, timer long")
        self.early = handle.getMapState("early", "at long", "chunk binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rest, due, frames, last, timer = self.carry.get() if self.carry.exists() else (b"", 0, 0, 0, None)
        kept, fresh = {at[0]: bytes(chunk[0]) for at, chunk in self.early.iterator()}, {}
        for batch in rows:
            fresh |= {int(at): bytes(chunk) for at, chunk in zip(batch["at"], batch["chunk"], strict=True)}
            last = max(last, int(batch["ms"].max()))
        waiting = fresh | kept
        parts = [bytes(rest)]
        while due in waiting:
            parts.append(waiting[due])
            due += 1
        *whole, rest = b"".join(parts).split(b"\n\n")
        for at in kept:
            if at < due:
                self.early.removeKey((at,))
        for at, chunk in fresh.items():
            if at > due and at not in kept:
                self.early.updateValue((at,), (chunk,))
        if timer != last + self.idle_ms:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle_ms)
        self.carry.update((rest, due, frames + len(whole), last, last + self.idle_ms))
        yield pd.DataFrame({"key": [key[0]] * len(whole), "at": [*range(frames, frames + len(whole))], "frame": [f.decode("utf-8", "replace") for f in whole]}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.carry.clear()
        self.early.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_sse_events(chunks: DataFrame, key: str, at: str, chunk: str, time: str, schema: str, late: str = "1 minute", idle: str = "10 minutes") -> DataFrame:
    """sse_events over a stream of numbered chunks (bytes or text) with their times, cut anywhere: key, at (the frame's number), stage and data as frames become whole.

    A stream's state goes when the watermark, which lags by so much lateness, has passed its last chunk by the idle time.
    """
    keep_state_in_rocksdb(chunks.sparkSession)
    rows = chunks.select(
        F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"), F.col(chunk).cast("binary").alias("chunk"), F.unix_millis(F.col(time).cast("timestamp")).alias("ms"),
        F.col(time).cast("timestamp").alias("quill_time"),
    ).where("key is not null and at >= 0 and chunk is not null and ms is not null").withWatermark("quill_time", late)
    frames = rows.groupBy("key").transformWithStateInPandas(Frames(int(pd.Timedelta(idle).total_seconds() * 1000)), "key string, at long, frame string", "append", "eventTime")
    return parsed_frames(frames, "key", schema)
