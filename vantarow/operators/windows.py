"""Sliding windows inside series: index, labels, statistics and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantarow.operators.intervals import overlaps
from vantarow.operators.series import NORMAL_EVENT, Geometry
from vantarow.sources.telemetry import METRICS

#: Steps of one part of a long series; parts overlap by a window less one, so frames never need a whole series.
PART = 1 << 16


def window_index(points: DataFrame, incidents: DataFrame, g: Geometry = Geometry()) -> DataFrame:
    """Windows (series_id, start, label, event_id); short series have none.

    Any overlap with an incident labels a window 1; it belongs to the event that covers most of it, of
    equals to the smallest id.
    """
    sizes = points.groupBy("series_id").agg((F.max("t") + 1).alias("n")).where(F.col("n") >= g.window)
    starts = sizes.select("series_id", F.explode(F.sequence(F.lit(0), F.col("n") - g.window, F.lit(g.stride))).alias("start"))
    events = incidents.select("series_id", "event_id", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    met = overlaps(starts.withColumn("end", F.col("start") + g.window), events, "series_id", 4 * g.window)
    cover = F.least("o_end", "end") - F.greatest("o_start", "start")
    owner = met.groupBy("series_id", "start").agg(F.max_by("event_id", F.struct(cover, -F.col("event_id"))).alias("event_id"))
    rows = starts.join(owner, ["series_id", "start"], "left")
    return rows.select("series_id", "start", F.col("event_id").isNotNull().cast("int").alias("label"), F.coalesce("event_id", F.lit(NORMAL_EVENT)).alias("event_id"))


def over_windows(points: DataFrame, g: Geometry, columns: dict, part: int = PART) -> DataFrame:
    """Frame expressions over every full window: (series_id, start, columns). ``columns``: name to f(frame).

    A frame function gets a maker of Window specs by bounds relative to the window's first step. Long
    series are cut into overlapping parts, so that one of them is spread over many tasks.
    """
    sizes = points.groupBy("series_id").agg((F.max("t") + 1).alias("__n"))
    here = F.floor(F.col("t") / part).cast("int")
    before = F.when((F.pmod("t", F.lit(part)) < g.window - 1) & (F.col("t") >= part), F.array(here, here - 1)).otherwise(F.array(here))
    rows = points.join(sizes, "series_id").withColumn("__part", F.explode(before))
    order = Window.partitionBy("series_id", "__part").orderBy("t")

    def frame(first: int, last: int):
        return order.rowsBetween(first, last)

    framed = rows.select("series_id", "t", "__n", "__part", *[f(frame).alias(name) for name, f in columns.items()])
    full = (F.pmod("t", F.lit(g.stride)) == 0) & (F.col("t") <= F.col("__n") - g.window) & (F.floor(F.col("t") / part) == F.col("__part"))
    return framed.where(full).select("series_id", F.col("t").alias("start"), *columns)


def summary_stats(points: DataFrame, g: Geometry = Geometry(), metrics=METRICS) -> DataFrame:
    """Mean, population deviation, least and greatest value of every metric in every window."""
    columns = {}
    for m in metrics:
        for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)):
            columns[f"{m}_{name}"] = lambda frame, m=m, f=f: f(m).over(frame(0, g.window - 1))
    return over_windows(points, g, columns)


def features(points: DataFrame, g: Geometry = Geometry(), metrics=METRICS) -> DataFrame:
    """Six features of every metric: mean, std, min, max, slope by least squares, and half difference."""
    half = g.window // 2
    columns = {}
    for m in metrics:
        for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)):
            columns[f"{m}_{name}"] = lambda frame, m=m, f=f: f(m).over(frame(0, g.window - 1))
        columns[f"{m}_slope"] = lambda frame, m=m: F.coalesce(F.regr_slope(F.col(m), F.col("t").cast("double")).over(frame(0, g.window - 1)), F.lit(0.0))
        columns[f"{m}_half_diff"] = lambda frame, m=m: F.avg(m).over(frame(half, g.window - 1)) - F.avg(m).over(frame(0, half - 1))
    return over_windows(points, g, columns)


def window_arrays(points: DataFrame, g: Geometry, metrics=METRICS) -> DataFrame:
    """Values of every window as one array per metric, in step order."""
    return over_windows(points, g, {m: (lambda frame, m=m: F.collect_list(m).over(frame(0, g.window - 1))) for m in metrics})


def centred(array: Column) -> Column:
    """An array less its mean."""
    mean = F.aggregate(array, F.lit(0.0), lambda a, x: a + x) / F.size(array)
    return F.transform(array, lambda x: x - mean)


def quarantine(rows: DataFrame, width: int, length: int, most_cells: int = 10_000) -> DataFrame:
    """Checks of submitted windows (window_id, values: array of rows): the first reason to refuse each, null if it passes."""
    n = F.size("values")
    widths = F.transform("values", lambda r: F.size(r))
    cells = F.aggregate(widths, F.lit(0), lambda a, x: a + x)
    finite = F.forall(F.flatten("values"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    reason = (
        F.when(F.col("values").isNull() | (n < 2), "too_few_rows")
        .when(F.size(F.array_distinct(widths)) != 1, "not_rectangular")
        .when(cells > most_cells, "too_many_cells")
        .when(F.element_at(widths, 1) != width, "wrong_width")
        .when(n != length, "wrong_length")
        .when(~finite, "not_finite")
    )
    return rows.select("window_id", reason.alias("reason"))
