"""Detectors side by side on a split: scaled and fitted on train, thresholds from validation, figures from test."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantarow.operators import detectors, evaluate, networks, series, windows
from vantarow.operators.detectors import Detector
from vantarow.operators.series import Geometry
from vantarow.sinks.store import workspace
from vantarow.sources.telemetry import METRICS

INCUMBENT = "window_spread"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Pieces:
    """Every split's part of every series as a series of its own (series_id: split/series), all with column ``split``."""

    points: DataFrame
    scaled: DataFrame
    incidents: DataFrame
    index: DataFrame

    def of(self, split: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Points, incidents and window index of one split."""
        return tuple(t.where(F.col("split") == split) for t in (self.points, self.incidents, self.index))


def pieces(points: DataFrame, incidents: DataFrame, g: Geometry = Geometry(), train: float = 0.7, validation: float = 0.15) -> Pieces:
    """Cut by time at normal steps, scale by the train split's statistics, and label windows, none of which crosses a cut."""
    parts = series.split_time_based(points, train, validation)
    inside = series.split_incidents(parts, incidents)
    key = F.concat_ws("/", "split", "series_id")
    own, events = _written(parts.withColumn("series_id", key), "pieces"), _written(inside.withColumn("series_id", key), "events")
    scaled = _written(series.transform(own, series.fit_scaler(own.where("split = 'train'"))), "scaled")
    index = windows.window_index(own, events, g).withColumn("split", F.split_part("series_id", F.lit("/"), F.lit(1)))
    return Pieces(own, scaled, events, _written(index, "index"))


def fused(parts: Pieces, scores: DataFrame) -> DataFrame:
    """Max fusion of long scores (detector, series_id, start, score), scaled by the normal windows of train."""
    normal = parts.index.where("split = 'train' and label = 0").select("series_id", "start")
    return detectors.max_fusion(scores, detectors.fusion_scale(scores.join(normal, ["series_id", "start"], "left_semi")))


def run_split(parts: Pieces, members: dict[str, Detector], g: Geometry = Geometry(), budget: float = 1.0, fuse: tuple[str, ...] = (), more: dict[str, DataFrame] | None = None, incumbent: str = INCUMBENT, **settings) -> DataFrame:
    """One report row for each detector: threshold by ``budget`` on validation, everything else on test.

    ``members``: detectors that need no fit but the scaler's; ``more``: scores of fitted ones (series_id, start, score);
    ``fuse``: names whose max fusion joins in. Adds the area of the curve on validation, and of every other detector the
    difference in detection to the incumbent on the same incidents with its bootstrap interval (``settings``: of that).
    """
    scores = detectors.all_scores(parts.scaled, g, members)
    for name, own in (more or {}).items():
        scores = scores.unionByName(own.select(F.lit(name).alias("detector"), "series_id", "start", F.round("score", 9).alias("score")))
    scores = _written(scores, "scores")
    names = [*members, *(more or {})]
    if fuse:
        joint = fused(parts, scores.where(F.col("detector").isin(*fuse)))
        scores = _written(scores.unionByName(joint.select(F.lit("max_fusion").alias("detector"), "series_id", "start", F.round("score", 9).alias("score"))), "scores")
        names.append("max_fusion")
    reports, outcomes = None, {}
    check, _, _ = parts.of("validation")
    for name in names:
        own = scores.where(F.col("detector") == name).select("series_id", "start", "score")
        v, t = (_written(evaluate.scored_windows(parts.of(s)[2], own), "windows") for s in ("validation", "test"))
        threshold = evaluate.threshold_at_budget(v, check, budget, g).first()["threshold"]
        points, incidents, _ = parts.of("test")
        limit = points.sparkSession.createDataFrame([(float(threshold),)], "threshold double")
        curve = evaluate.curve_auc(evaluate.detection_curve(v, parts.of("validation")[1], check, g)).withColumnRenamed("curve_auc", "validation_curve_auc")
        row = evaluate.detection_report(t, incidents, points, limit, g).crossJoin(F.broadcast(curve)).select(F.lit(name).alias("detector"), "*")
        reports = row if reports is None else reports.unionByName(row)
        outcomes[name] = _written(evaluate.event_outcomes(t, incidents, float(threshold), g), "outcomes")
    deltas = None
    for name in names:
        if incumbent in outcomes and name != incumbent:
            d = evaluate.paired_delta(outcomes[name], outcomes[incumbent], **settings).select(F.lit(name).alias("detector"), F.col("estimate").alias("delta"), F.col("low").alias("delta_low"), F.col("high").alias("delta_high"))
            deltas = d if deltas is None else deltas.unionByName(d)
    if deltas is None:
        return reports.select("*", *[F.lit(None).cast("double").alias(c) for c in ("delta", "delta_low", "delta_high")])
    return reports.join(F.broadcast(deltas), "detector", "left")


@dataclass
class Built:
    """A detector that is ready: its name, its scores of all windows of all splits, its threshold, and what went wrong on the way."""

    name: str
    scores: DataFrame
    threshold: float
    notes: list[str]


def _fitted(kind: str, parts: Pieces, g: Geometry, how: networks.Descent) -> DataFrame:
    if kind in detectors.STATISTICS:
        return detectors.STATISTICS[kind](parts.scaled, g)
    if kind not in ("conv_autoencoder", "max_fusion"):
        raise ValueError(f"no detector {kind!r}")
    rows = networks.flat_windows(parts.scaled, g).join(parts.index.select("series_id", "start", "label", "split"), ["series_id", "start"])
    rows = _written(rows, "flat")
    normal = rows.where("split = 'train' and label = 0").select("series_id", "start", "v", "draw")
    fitted = networks.fit_conv(normal, len(METRICS), g.window, how)
    conv = networks.scores(fitted, rows.select("series_id", "start", "v", "draw"))
    if kind == "conv_autoencoder":
        return conv
    both = detectors.all_scores(parts.scaled, g, {"naive_residual": detectors.naive_residual})
    return fused(parts, _written(both.unionByName(conv.select(F.lit("conv_autoencoder").alias("detector"), "series_id", "start", F.round("score", 9).alias("score"))), "members"))


def build_detector(kind: str, parts: Pieces, g: Geometry = Geometry(), budget: float = 1.0, how: networks.Descent = networks.Descent()) -> Built:
    """The detector ``kind`` fitted on normal windows of train, its threshold from validation within ``budget``.

    Where a fit fails, whatever the reason, :data:`INCUMBENT` takes its place and the notes say why: a service starts anyway.
    """
    notes: list[str] = []
    try:
        name, scores = kind, _written(_fitted(kind, parts, g, how), "scores")
    except Exception as e:  # noqa: BLE001
        notes.append(f"could not fit {kind}, {INCUMBENT} takes its place: {type(e).__name__}: {e}".splitlines()[0])
        name, scores = INCUMBENT, _written(detectors.STATISTICS[INCUMBENT](parts.scaled, g), "scores")
    scores = scores.withColumn("score", F.round("score", 9))
    points, _, index = parts.of("validation")
    threshold = evaluate.threshold_at_budget(evaluate.scored_windows(index, scores), points, budget, g).first()["threshold"]
    return Built(name, scores, float(threshold), notes)
