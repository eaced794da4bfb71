"""Keyed state over streams of frames: the step functions of operators.folds, carried from batch to batch.

State is a few numbers a key and goes when the key has been silent for the timeout, if one is given (an endless stream
needs one; it also keeps an availableNow query from ending). Rows of a key are put in order within a batch, and keyed_fold
drops frames at or before one that was seen, as the loop they come from is strictly ordered; frame_loop gives them out, marked.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import folds
from ..scratch import scratch_dir


def _in_order(batches: Iterator[pd.DataFrame], order: str, size: int = 2000) -> Iterator[list[dict]]:
    """A key's rows of a batch in order, as records of some rows at a time."""
    rows = pd.concat(list(batches)).sort_values(order, kind="stable")
    for at in range(0, len(rows), size):
        yield rows.iloc[at : at + size].to_dict("records")


def keyed_fold(df: DataFrame, group: str, order: str, step: Callable[[object, dict], tuple[object, dict]], schema: str, timeout_ms: int | None = None) -> DataFrame:
    """step over a stream's rows by key; its state must survive json (tuples come back as lists)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, inner = (state.get[0], json.loads(state.get[1])) if state.exists else (None, None)
        parts = []
        for records in _in_order(batches, order):
            rows = []
            for row in records:
                if last is not None and row[order] <= last:
                    continue
                inner, out = step(inner, row)
                last = int(row[order])
                rows.append(out)
            parts.append(pd.DataFrame(rows, columns=names))
        if last is not None:
            state.update((last, json.dumps(inner)))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield from parts

    return df.groupBy(group).applyInPandasWithState(run, schema, "last long, inner string", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


SMOOTHED = "grp long, frame long, label string, confidence double, raw_label string, status string"


def smoothed(df: DataFrame, how: folds.Smoothing = folds.Smoothing(), timeout_ms: int | None = None) -> DataFrame:
    """folds.smoothed over a stream (grp, frame, probs)."""
    def step(state, row):
        state, out = folds.smooth(state, list(row["probs"]), how)
        return state, {"grp": row["grp"], "frame": row["frame"], **{k: out[k] for k in ("label", "confidence", "raw_label", "status")}}

    return keyed_fold(df, "grp", "frame", step, SMOOTHED, timeout_ms)


def cadence(df: DataFrame, interval: int, burst: int, stable_needed: int = 4, least_confidence: float = 0.6, timeout_ms: int | None = None) -> DataFrame:
    """folds.cadence over a stream."""
    def step(state, row):
        state, out = folds.observe(state, list(row["probs"]), interval, burst, stable_needed, least_confidence)
        return state, {"grp": row["grp"], "frame": row["frame"], **{k: out[k] for k in ("label", "observed", "burst")}}

    return keyed_fold(df, "grp", "frame", step, "grp long, frame long, label string, observed boolean, burst boolean", timeout_ms)


def gate_latch(df: DataFrame, window: int = 12, confidence_below: float = 0.82, ratio_above: float = 0.018, most_accepts: int = 0, timeout_ms: int | None = None) -> DataFrame:
    """The rolling gate over a stream (grp, frame, accepted, confidence, ratio): the last rows and the latch are the state."""
    def step(state, row):
        rows, latched = state or [[], False]
        rows = [*rows, [bool(row["accepted"]), float(row["confidence"]), float(row["ratio"])]][-window:]
        fires = folds.gate_fires(rows, window, confidence_below, ratio_above, most_accepts)
        return [rows, latched or fires], {"grp": row["grp"], "frame": row["frame"], "fires": fires, "latched": latched}

    return keyed_fold(df, "grp", "frame", step, "grp long, frame long, fires boolean, latched boolean", timeout_ms)


def track_identity(df: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """The preferred track over a stream (grp, frame, found: array of structs x1, y1, x2, y2, conf, cls)."""
    def step(state, row):
        found = [{"box": [float(d[c]) for c in ("x1", "y1", "x2", "y2")], "conf": float(d["conf"]), "track": int(d["cls"])} for d in row["found"]]
        state, out = folds.pick(state, found)
        return state, {"grp": row["grp"], "frame": row["frame"], "track": out["chosen"] and out["chosen"]["track"], "source": out["source"], "carried": out["carried"]}

    return keyed_fold(df, "grp", "frame", step, "grp long, frame long, track long, source string, carried boolean", timeout_ms)


LOOP = (
    "grp long, frame long, late boolean, track long, source string, carried boolean, missing_streak long, label string, observed boolean, fires boolean, latched boolean, "
    "line_asked boolean, line_again boolean, line_source string, line_age long, line_lost boolean, line_x double, line_y double"
)


@dataclass(frozen=True)
class LoopPolicy:
    """Cadence of labels, the gate over the last frames, the line's policy, and the silence after which a video is released."""

    interval: int = 10
    burst: int = 2
    window: int = 12
    confidence_below: float = 0.3
    ratio_above: float = 0.018
    line: folds.StringPolicy = folds.StringPolicy()
    release_ms: int | None = None


@dataclass
class Carried:
    """What a video carries from frame to frame."""

    last: int | None = None
    gone: int = 0
    latched: bool = False
    track: dict | None = None
    label: dict | None = None
    gate: list = field(default_factory=list)
    line: tuple | None = None


def loop_step(now: Carried, row: dict, how: LoopPolicy = LoopPolicy()) -> dict:
    """One frame of a video's loop; now is brought up to date. row: grp, frame, found (detections), probs, ratio, seen, shift.

    The track that is followed and how long it is gone, the label at its adaptive cadence, the latch of the gate over the
    last frames, and the line that is asked for or carried. A frame at or before the last one is late: it changes nothing
    and is given out as such.
    """
    empty = dict.fromkeys(c.split()[0] for c in LOOP.split(", "))
    if now.last is not None and row["frame"] <= now.last:
        return empty | {"grp": row["grp"], "frame": row["frame"], "late": True}
    found = [{"box": [float(d[c]) for c in ("x1", "y1", "x2", "y2")], "conf": float(d["conf"]), "track": int(d["cls"])} for d in row["found"]]
    now.track, picked = folds.pick(now.track, found)
    one = picked["chosen"]
    now.gone = 0 if one else now.gone + 1
    now.label, said = folds.observe(now.label, [float(p) for p in row["probs"]], how.interval, how.burst, 4, 0.6)
    now.gate = [*now.gate, (one is not None and picked["source"] == "preferred_track", float(one["conf"]) if one else 0.0, float(row["ratio"]))][-how.window :]
    fires = folds.gate_fires(now.gate, how.window, how.confidence_below, how.ratio_above)
    before, now.latched, now.last = now.latched, now.latched or fires, int(row["frame"])
    shift = None if row["shift"] is None else [float(v) for v in row["shift"]]
    seen = None if row["seen"] is None else {"points": [float(v) for v in row["seen"]["points"]], "ambiguous": row["seen"]["ambiguous"], "mismatch": row["seen"]["mismatch"]}
    now.line, line = folds.carry_line(now.line, int(row["frame"]), one is not None, seen, shift, how.line)
    return empty | {
        "grp": row["grp"], "frame": row["frame"], "late": False, "track": one and one["track"], "source": picked["source"], "carried": picked["carried"], "missing_streak": now.gone,
        "label": said["label"], "observed": said["observed"], "fires": fires, "latched": before, **{f"line_{k}": line[k] for k in ("asked", "again", "source", "age", "lost", "x", "y")},
    }


class FrameLoop(StatefulProcessor):
    """loop_step over a stream. Each part of what is carried is a typed state of its own, so a change of one leaves the others
    as they are in the store; a timer releases a video that has been silent."""

    STATES = {
        "clock": "last long, gone long, latched boolean",
        "track": "track long, box array<double>, gap long, trusted boolean",
        "label": "index long, next long, stable long, label string, mean array<double>, leader long, candidate long, count long",
        "line": "rows long, last long, age long, points array<double>",
    }

    def __init__(self, how: LoopPolicy) -> None:
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = {name: handle.getValueState(name, kind) for name, kind in self.STATES.items()}
        self.gate = handle.getListState("gate", "accepted boolean, confidence double, ratio double")

    def read(self) -> Carried:
        now = Carried()
        clock, track, label, line = (self.values[name].get() if self.values[name].exists() else None for name in self.STATES)
        if clock:
            now.last, now.gone, now.latched = clock
        if track:
            now.track = {"track": track[0], "box": track[1] and list(track[1]), "gap": track[2], "trusted": track[3]}
        if label:
            known = None if label[4] is None else (tuple(label[4]), label[5], label[6], label[7])
            now.label = {"index": label[0], "next": label[1], "stable": label[2], "label": label[3], "filter": known}
        if line:
            now.line = (line[0], line[1], line[2], list(line[3]))
        now.gate = [tuple(g) for g in self.gate.get()] if self.gate.exists() else []
        return now

    def write(self, now: Carried) -> None:
        self.values["clock"].update((now.last, now.gone, now.latched))
        self.values["track"].update((now.track["track"], now.track["box"], now.track["gap"], now.track["trusted"]))
        mean, leader, candidate, count = now.label["filter"] or (None, None, None, None)
        self.values["label"].update((now.label["index"], now.label["next"], now.label["stable"], now.label["label"], mean and list(mean), leader, candidate, count))
        self.values["line"].update((now.line[0], now.line[1], now.line[2], list(now.line[3])))
        self.gate.put(now.gate)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = self.read()
        out = [pd.DataFrame([loop_step(now, row, self.how) for row in records]).astype(_NULLABLE) for records in _in_order(rows, "frame")]
        self.write(now)
        if self.how.release_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.how.release_ms)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        for state in (*self.values.values(), self.gate):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


_NULLABLE = {name: {"long": "Int64", "boolean": "boolean", "double": "float64", "string": "object"}[kind] for name, kind in (c.split() for c in LOOP.split(", "))}
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def frame_loop(df: DataFrame, how: LoopPolicy = LoopPolicy()) -> DataFrame:
    """loop_step over a stream (grp, frame, found, probs, ratio, seen, shift): LOOP, with late frames marked and without values.

    With release_ms the query runs on, as a timer may be due at any time; availableNow doesn't end it. Spark keeps the states in its RocksDB store; this sets it for the session, as typed states ask for it.
    """
    df.sparkSession.conf.set(*_STORE)
    return df.groupBy("grp").transformWithStateInPandas(FrameLoop(how), LOOP, "append", "processingTime" if how.release_ms else "none")


def frame_loop_replay(df: DataFrame, how: LoopPolicy = LoopPolicy()) -> DataFrame:
    """The same over a table, video by video in the order of frames."""

    def step(now: Carried, row: dict) -> tuple[Carried, dict]:
        return now, loop_step(now, row, how)

    return folds.fold(df, "grp", "frame", Carried, step, LOOP)


#: Rows of a key in one step of drain_in_steps: what a Python worker holds at once of a key.
STEP = 20_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each job that begins inside go when it ends, not when the driver happens to collect its plan."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _run(stream: DataFrame, base: str) -> None:
    stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{base}/out").awaitTermination()


def drain(stream: DataFrame, label: str) -> DataFrame:
    """All that a stream gives from the input that is there now, through files in the shared folder."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _run(stream, base)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_in_steps(rows: DataFrame, step: Column, run: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """All that run makes of rows as a stream that comes step by step: the rows with the least number first, and those of each
    number in a batch of its own, after the batch before has ended. So of a key a batch holds no more than a step has of it,
    however long the key is, if steps follow the key's order; state goes from batch to batch in the checkpoint.
    """
    spark = rows.sparkSession
    base = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _swept(spark):
        rows.withColumn("_step", step.cast("long")).write.partitionBy("_step").parquet(f"{base}/rows")
        kept = spark.read.schema(StructType([*rows.schema, StructField("_step", LongType())])).parquet(f"{base}/rows")
        for number in sorted(r[0] for r in kept.select("_step").distinct().collect()) or [0]:
            kept.where(F.col("_step") == number).drop("_step").write.mode("append").parquet(f"{base}/in")
            stream = run(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
            _run(stream, base)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
