"""Series operators: runs, tracks, overlap joins, scaling, splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantarow.operators.intervals import overlaps
from vantarow.sources.telemetry import METRICS, global_event_ids

NORMAL_EVENT = -1


@dataclass(frozen=True)
class Geometry:
    """Window length and stride in steps, steps of a day, and steps after which a standing alarm pages again."""

    window: int = 60
    stride: int = 10
    day: int = 1440
    repage: int = 60


def runs(flags: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open spans [start, end) of steps whose flag is 1, by keys; rows: keys, t, flag."""
    order = Window.partitionBy(*keys).orderBy("t")
    on = flags.where("flag = 1").withColumn("island", F.col("t") - F.row_number().over(order))
    return on.groupBy(*keys, "island").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end")).drop("island")


def label_runs(points: DataFrame) -> DataFrame:
    """Incidents: runs of labelled steps, with ids unique over all series."""
    found = runs(points.select("series_id", "t", F.col("point_label").alias("flag")), ["series_id"])
    return global_event_ids(found).select("event_id", "series_id", "start", "end")


def annotation_spans(points: DataFrame, stats: DataFrame, least: float = 3.0) -> DataFrame:
    """Spans of each metric (dimension, from 1) whose standard score exceeds ``least``."""
    scaled = transform(points, stats)
    long = scaled.select("series_id", "t", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("dim"), F.col(m).alias("z")) for i, m in enumerate(METRICS)])).alias("x"))
    flags = long.select("series_id", F.col("x.dim").alias("dim"), "t", (F.col("x.z") > least).cast("int").alias("flag"))
    return runs(flags, ["series_id", "dim"])


def attach_dims(incidents: DataFrame, spans: DataFrame, width: int = 256) -> DataFrame:
    """Union of the dimensions of all spans that overlap a run; see :func:`intervals.overlaps`."""
    s = spans.select("series_id", F.col("start").alias("o_start"), F.col("end").alias("o_end"), "dim")
    met = overlaps(incidents.select("event_id", "series_id", "start", "end"), s, "series_id", width).groupBy("event_id").agg(F.array_sort(F.collect_set("dim")).alias("dims"))
    return incidents.join(met, "event_id", "left").select("event_id", "series_id", "start", "end", F.coalesce("dims", F.array().cast("array<int>")).alias("dims"))


def event_track(points: DataFrame, incidents: DataFrame) -> DataFrame:
    """Event id of every step; where events overlap the later one stands."""
    inside = incidents.select("series_id", "event_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("t"))
    latest = inside.groupBy("series_id", "t").agg(F.max("event_id").alias("event_id"))
    return points.select("series_id", "t").join(latest, ["series_id", "t"], "left").select("series_id", "t", F.coalesce("event_id", F.lit(NORMAL_EVENT)).alias("event_id"))


def fit_scaler(points: DataFrame, metrics=METRICS) -> DataFrame:
    """Mean and population deviation of each metric; a deviation under 1e-8 counts as 1. One row per metric."""
    wide = points.agg(*[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"), F.col(f"mean_{m}").alias("mean"), F.when(F.col(f"std_{m}") < 1e-8, 1.0).otherwise(F.col(f"std_{m}")).alias("std")) for i, m in enumerate(metrics)])
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def _wide(stats: DataFrame, metrics) -> DataFrame:
    return stats.groupBy().agg(*[F.max(F.when(F.col("metric") == m, F.col(k))).alias(f"__{k}_{m}") for m in metrics for k in ("mean", "std")])


def transform(points: DataFrame, stats: DataFrame, metrics=METRICS) -> DataFrame:
    """Standard scores; the statistics are one row."""
    rest = [c for c in points.columns if c not in metrics]
    return points.crossJoin(F.broadcast(_wide(stats, metrics))).select(*rest, *[((F.col(m) - F.col(f"__mean_{m}")) / F.col(f"__std_{m}")).alias(m) for m in metrics])


def inverse_transform(points: DataFrame, stats: DataFrame, metrics=METRICS) -> DataFrame:
    rest = [c for c in points.columns if c not in metrics]
    return points.crossJoin(F.broadcast(_wide(stats, metrics))).select(*rest, *[(F.col(m) * F.col(f"__std_{m}") + F.col(f"__mean_{m}")).alias(m) for m in metrics])


def cut_points(points: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """For each series and named fraction, the normal step nearest to it; of two, the earlier."""
    sizes = points.groupBy("series_id").agg((F.max("t") + 1).alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("fraction")) for k, v in fractions.items()]))
    targets = sizes.select("series_id", "n", wanted.alias("w")).select("series_id", "n", "w.name", "w.fraction")
    targets = targets.withColumn("target", F.floor(F.col("n") * F.col("fraction")).cast("int"))
    normal = points.where("point_label = 0").select("series_id", "t")
    near = targets.join(normal, "series_id").groupBy("series_id", "name", "target").agg(F.min_by("t", F.struct(F.abs(F.col("t") - F.col("target")), F.col("t"))).alias("cut"))
    return near.select("series_id", "name", "target", "cut")


def checked_fractions(train: float, validation: float) -> None:
    if not (0 < train < 1 and 0 < validation < 1 and train + validation < 1):
        raise ValueError("train and validation are shares of the whole and leave some for the test")


def remaining(everything: DataFrame, *taken: DataFrame) -> DataFrame:
    """Distinct rows that no other table has: what is left to train on."""
    rows = everything.distinct()
    for part in taken:
        rows = rows.join(part, rows.columns, "left_anti")
    return rows


def split_time_based(points: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Chronological splits by series, cut at normal steps so that no incident is cut; t is rebased in each."""
    checked_fractions(train, validation)
    cuts = cut_points(points, {"a": train, "b": train + validation}).groupBy("series_id").agg(F.max(F.when(F.col("name") == "a", F.col("cut"))).alias("a"), F.max(F.when(F.col("name") == "b", F.col("cut"))).alias("b"))
    split = F.when(F.col("t") < F.col("a"), "train").when(F.col("t") < F.col("b"), "validation").otherwise("test")
    offset = F.when(F.col("t") < F.col("a"), 0).when(F.col("t") < F.col("b"), F.col("a")).otherwise(F.col("b"))
    rest = [c for c in points.columns if c not in ("series_id", "t")]
    return points.join(F.broadcast(cuts), "series_id").select("series_id", split.alias("split"), (F.col("t") - offset).cast("int").alias("t"), F.col("t").alias("original_t"), *rest)


def split_held_out(points: DataFrame, seed: int = 42, train: float = 0.55, validation: float = 0.15) -> DataFrame:
    """Whole series by split, in the order of a hash of (seed, series). One small row per series is ordered."""
    checked_fractions(train, validation)
    names = points.select("series_id").distinct().withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("series_id"))))
    order, total = F.row_number().over(Window.orderBy("h", "series_id")), F.count(F.lit(1)).over(Window.partitionBy())
    ranked = names.select("series_id", order.alias("k"), total.alias("n"))
    split = F.when(F.col("k") <= F.floor(F.col("n") * train), "train").when(F.col("k") <= F.floor(F.col("n") * (train + validation)), "validation").otherwise("test")
    return ranked.select("series_id", split.alias("split"))


def split_summary(split_points: DataFrame, incidents: DataFrame, windows: DataFrame) -> DataFrame:
    """Series, steps, events, upper median of event lengths, windows and anomalous rate of every split."""
    steps = split_points.groupBy("split").agg(F.countDistinct("series_id").alias("series"), F.count(F.lit(1)).alias("steps"))
    lengths = incidents.withColumn("length", F.col("end") - F.col("start")).groupBy("split").agg(
        F.count(F.lit(1)).alias("events"), F.element_at(F.sort_array(F.collect_list("length")), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("median_length")
    )
    rates = windows.groupBy("split").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg("label"), 6).alias("anomalous_rate"))
    return steps.join(lengths, "split", "left").join(rates, "split", "left").select("split", "series", "steps", F.coalesce("events", F.lit(0)).alias("events"), "median_length", F.coalesce("windows", F.lit(0)).alias("windows"), "anomalous_rate")


def split_incidents(split_points: DataFrame, incidents: DataFrame) -> DataFrame:
    """Incidents that lie wholly in one split, rebased; ids stay."""
    bounds = split_points.groupBy("series_id", "split").agg(F.min("original_t").alias("lo"), (F.max("original_t") + 1).alias("hi"))
    inside = incidents.join(F.broadcast(bounds), "series_id").where("start >= lo and end <= hi")
    return inside.select("event_id", "series_id", "split", (F.col("start") - F.col("lo")).alias("start"), (F.col("end") - F.col("lo")).alias("end"))


def orphans(windows: DataFrame, incidents: DataFrame) -> DataFrame:
    """Anomalous windows that name no known event, by series; there should be none."""
    return windows.where("label = 1").join(incidents.select("event_id"), "event_id", "left_anti").groupBy("series_id").agg(F.count(F.lit(1)).alias("orphans"))
