"""Structured Streaming over event logs: windowed counts with a watermark, and run-by-run state machines.

Event time is the event's own; events more than an hour late are dropped by the watermark, and windows are appended once
they close. The state machines are plain folds that a batch query, a test and the stream share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"
#: Drifting runs that lock a key out, the runs it stays locked, and the bounds of a chunk delta.
DRIFTS, LOCKED, STEP, TOTAL = 3, 5, 2.0, 20.0
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_log(spark: SparkSession, path: str, schema: str = SCHEMA, **options) -> DataFrame:
    """A stream of JSON lines; malformed lines become null rows and are dropped."""
    return spark.readStream.schema(schema).options(mode="PERMISSIVE", **options).json(path).where("event_id is not null")


def unique(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts, failures and mean by window and type; tumbling, or sliding with ``slide``."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", LATE).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def locked_out(drifting: bool, drifts: int, left: int) -> tuple[int, int]:
    """Next (consecutive drifts, runs left in lockout): a lockout counts down, else drifts add up until they start one."""
    if left > 0:
        return 0, left - 1
    drifts = drifts + 1 if drifting else 0
    return (0, LOCKED) if drifts >= DRIFTS else (drifts, 0)


def chunk_delta(total: float, delta: float, revert: bool) -> float:
    """Next accumulated delta: steps and the sum are clamped, a revert starts at 0."""
    return 0.0 if revert else round(max(-TOTAL, min(TOTAL, total + max(-STEP, min(STEP, delta)))), 2)


def escalation(events: DataFrame) -> DataFrame:
    """(user_id, event_id, drifts, locked, delta) of each event in order of id, with both state machines kept by user.

    Out-of-order arrival between micro-batches is taken as it comes. State is three numbers a user.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        drifts, left, total = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(frames)).sort_values("event_id")
        out = []
        for event_id, kind, value in rows[["event_id", "event_type", "value"]].itertuples(index=False):
            drifts, left = locked_out(kind == "error", drifts, left)
            total = chunk_delta(total, value - 50.0, kind == "signup")
            out.append((key[0], event_id, drifts, left, total))
        state.update((drifts, left, total))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "drifts", "locked", "delta"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, event_id bigint, drifts int, locked int, delta double", "drifts int, locked int, delta double", "append", GroupStateTimeout.NoTimeout)
