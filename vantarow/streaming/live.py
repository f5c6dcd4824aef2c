"""Live scoring of metric points, and event-time windows over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vantarow.operators.series import Geometry

SCORED = "series_id string, start int, score double"


def window_spread_stream(points: DataFrame, metrics: tuple[str, ...], g: Geometry = Geometry()) -> DataFrame:
    """Score of every full window as soon as its last step is in: the largest population deviation of a metric.

    ``points``: a stream of (series_id, t, standard scores). State of a series is its last steps, one window at
    most and whatever has come too early; steps before the window that waits are late and are ignored.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, held = (state.get if state.exists else (0, "{}"))
        rows = {int(k): v for k, v in json.loads(held).items()}
        for batch in batches:
            for t, *values in batch[["t", *metrics]].itertuples(index=False):
                if t >= start:
                    rows[int(t)] = [float(v) for v in values]
        out = []
        while all(start + i in rows for i in range(g.window)):
            x = np.array([rows[start + i] for i in range(g.window)])
            out.append((key[0], start, float(x.std(axis=0).max())))
            start += g.stride
            rows = {t: v for t, v in rows.items() if t >= start}
        state.update((start, json.dumps(rows)))
        if out:
            yield pd.DataFrame(out, columns=["series_id", "start", "score"])

    return points.groupBy("series_id").applyInPandasWithState(step, SCORED, "start int, held string", "append", GroupStateTimeout.NoTimeout)


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late else events


def counts_by_window(events: DataFrame, length: str = "60 minutes", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """Events by type and tumbling or sliding window of event time, with a watermark for late ones (None: it has one)."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _marked(events, late).groupBy("event_type", window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = "10 minutes") -> DataFrame:
    """Sessions of users: events less than ``gap`` apart."""
    return _marked(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def without_repeats(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
