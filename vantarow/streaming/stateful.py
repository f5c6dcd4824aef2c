"""Operators with state and timers on live streams: admission of requests, and gates that wait for a decision.

Both keep their state in Spark's state store (list and value state), set timers in event time, and go on from a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ADMISSIONS = "caller long, at timestamp, request_id long, admitted boolean, retry_after double"
GATES = "thread_id string, version int, status string, principal string, at timestamp"


def with_state_store(spark: SparkSession) -> None:
    """State with timers and several columns needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Admission(StatefulProcessor):
    """Admitted requests of a caller that the window still holds: at most ``per_caller``, oldest first."""

    def __init__(self, per_caller: int, seconds: float) -> None:
        self.per_caller, self.micros = per_caller, int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.admitted.get()]
        before = list(held)
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.assign(micros=batch["at"].astype("datetime64[us]").astype("int64")).sort_values(["micros", "request_id"])
        admitted, wait = [], []
        for at in batch["micros"].tolist():
            while held and held[0] <= at - self.micros:
                held.pop(0)
            admitted.append(len(held) < self.per_caller)
            wait.append(None if admitted[-1] else (held[0] + self.micros - at) / 1e6)
            if admitted[-1]:
                held.append(at)
        if held != before:
            self.admitted.put([(x,) for x in held])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            # once the newest admission has left the window the caller needs no state
            self.handle.registerTimer(-(-(held[-1] + self.micros) // 1000))
        yield pd.DataFrame({"caller": batch["caller"], "at": batch["at"], "request_id": batch["request_id"], "admitted": admitted, "retry_after": pd.Series(wait, index=batch.index, dtype="float64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.admitted.clear()
        yield pd.DataFrame({"caller": pd.Series([], dtype="int64"), "at": pd.Series([], dtype="datetime64[us]"), "request_id": pd.Series([], dtype="int64"), "admitted": pd.Series([], dtype="bool"), "retry_after": pd.Series([], dtype="float64")})

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, per_caller: int = 3, seconds: float = 60.0, late: str = "0 seconds") -> DataFrame:
    """Admission of a stream of requests (caller, at timestamp, request_id); refused ones don't count towards the limit.

    A micro-batch is taken in the order of (at, request_id); requests behind the watermark are dropped, as late. Replayed in
    order it gives what :func:`vantarow.operators.response.rate_limit` gives. ``retry_after``: seconds until one is allowed.
    """
    with_state_store(requests.sparkSession)
    typed = requests.select(F.col("caller").cast("long").alias("caller"), F.col("at").cast("timestamp").alias("at"), F.col("request_id").cast("long").alias("request_id"))
    return typed.withWatermark("at", late).groupBy("caller").transformWithStateInPandas(_Admission(per_caller, seconds), ADMISSIONS, "Append", "EventTime")


class _Gate(StatefulProcessor):
    """A thread that waits for approval: its version, status and until when it waits (milliseconds)."""

    def __init__(self, minutes: float) -> None:
        self.millis = int(minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gate", "version int, status string, due long")

    def _moved(self, key, version: int, status: str, principal: str | None, at, due: int = 0) -> dict:
        self.state.update((version, status, due))
        return {"thread_id": key[0], "version": version, "status": status, "principal": principal, "at": at}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        # a thread opens before it is decided; of decisions at one time an approval comes first, then the lesser principal
        batch = batch.assign(first=batch["kind"].ne("opened"), who=batch["principal"].fillna("")).sort_values(["at", "first", "kind", "who"])
        out = []
        for kind, principal, at in zip(batch["kind"], batch["principal"], batch["at"]):
            version, status, due = self.state.get() if self.state.exists() else (0, "", 0)
            now = pd.Timestamp(at).value // 1_000_000
            if status == "awaiting_approval" and now >= due:
                # rows of a batch come before its timers: what is due by a row's own time closes first
                out.append(self._closed(key, version, due))
            elif kind == "opened" and not status:
                out.append(self._moved(key, 1, "awaiting_approval", None, at, now + self.millis))
                self.handle.registerTimer(now + self.millis)
            elif kind in ("approve", "reject") and status == "awaiting_approval":
                out.append(self._moved(key, version + 1, "complete" if kind == "approve" else "rejected", principal, at))
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
        yield _gates(out)

    def _closed(self, key, version: int, due: int) -> dict:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return self._moved(key, version + 1, "expired", None, pd.Timestamp(due, unit="ms"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, status, due = self.state.get() if self.state.exists() else (0, "", 0)
        yield _gates([self._closed(key, version, due)] if status == "awaiting_approval" else [])

    def close(self) -> None:
        pass


def _gates(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["thread_id", "version", "status", "principal", "at"])
    return frame.astype({"thread_id": "object", "version": "int32", "status": "object", "principal": "object", "at": "datetime64[us]"})


def approval_gates(events: DataFrame, minutes: float = 30.0, late: str = "0 seconds") -> DataFrame:
    """Versions of threads from a stream of (thread_id, at, kind, principal); kind: opened, approve or reject.

    An opened thread waits; its first decision resumes it, later ones and those of threads that don't wait change nothing.
    A thread that nobody decides is closed as expired, once the watermark is ``minutes`` past its opening.
    """
    with_state_store(events.sparkSession)
    typed = events.select(F.col("thread_id").cast("string").alias("thread_id"), F.col("at").cast("timestamp").alias("at"), F.col("kind").cast("string").alias("kind"), F.col("principal").cast("string").alias("principal"))
    return typed.withWatermark("at", late).groupBy("thread_id").transformWithStateInPandas(_Gate(minutes), GATES, "Append", "EventTime")
