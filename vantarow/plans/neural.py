"""Queries on reconstruction networks: scores beside the statistics, histories, epochs by criterion, saved weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantarow.operators import networks, series, windows
from vantarow.operators.networks import Descent, Fitted
from vantarow.plans.detection import G, incidents_of, points, rounded, scaled, settled, with_base
from vantarow.plans.registry import Registry
from vantarow.sinks import models, store
from vantarow.sources.telemetry import METRICS

REGISTRY = Registry()
query = REGISTRY.query
CONV = Descent(epochs=6, steps=3, rate=2e-2)
RECURRENT = Descent(epochs=5, steps=3, rate=2e-2, cosine=False, decay=0.0, largest=None, patience=2)


def labelled(p: DataFrame) -> DataFrame:
    """All windows of scaled points with their label and the split that their first step is in."""
    rows = networks.flat_windows(scaled(p), G)
    index = windows.window_index(p, incidents_of(p), G).select("series_id", "start", "label")
    split = series.split_time_based(p).select("series_id", F.col("original_t").alias("start"), "split")
    return settled(rows.join(index, ["series_id", "start"]).join(split, ["series_id", "start"]), "labelled")


def convolutional(rows: DataFrame) -> Fitted:
    normal = rows.where("split = 'train' and label = 0").select("series_id", "start", "v", "draw")
    return networks.fit_conv(normal, len(METRICS), G.window, CONV)


def recurrent(rows: DataFrame, criterion: str = "over_normal") -> Fitted:
    normal = rows.where("split = 'train' and label = 0").select("series_id", "start", "v", "draw")
    return networks.fit_recurrent(normal, rows.where("split = 'validation'").select("series_id", "start", "v", "draw", "label"), len(METRICS), G.window, criterion, RECURRENT)


def history(s: SparkSession, d: str) -> DataFrame:
    """Epoch by epoch: the rate, the training error, the figure that chooses, and whether the epoch was kept."""
    rows = labelled(points(s, d))
    out = []
    for fitted, chosen in ((convolutional(rows), "holdout"), (recurrent(rows), "over_normal")):
        out += [(fitted.net.name, h["epoch"], round(h["rate"], 9), round(h["train"], 6), round(h[chosen], 6), h["epoch"] == fitted.epoch) for h in fitted.history]
    return s.createDataFrame(out, "detector string, epoch int, rate double, train double, chosen_by double, kept boolean")


def network_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of both networks in long form, as :func:`detectors.all_scores` gives those of the statistics."""
    rows = labelled(points(s, d))
    out = None
    for fitted in (convolutional(rows), recurrent(rows)):
        part = networks.scores(fitted, rows.select("series_id", "start", "v", "draw")).withColumn("detector", F.lit(fitted.net.name))
        out = part if out is None else out.unionByName(part)
    return rounded(out.select("detector", "series_id", "start", "score"), 9)


def criteria(s: SparkSession, d: str) -> DataFrame:
    """The epoch that each criterion keeps, of one training without an early end."""
    rows = labelled(points(s, d))
    normal = rows.where("split = 'train' and label = 0").select("series_id", "start", "v", "draw")
    how = Descent(epochs=4, steps=3, rate=2e-2, cosine=False, decay=0.0, largest=None)
    fitted = networks.fit_recurrent(normal, rows.where("split = 'validation'").select("series_id", "start", "v", "draw", "label"), len(METRICS), G.window, "over_normal", how)
    return s.createDataFrame(sorted(networks.chosen_epochs(fitted.history).items()), "criterion string, epoch int")


def saved(s: SparkSession, d: str) -> DataFrame:
    """Per window: does the saved and loaded network score as the fitted one?"""
    rows = labelled(points(s, d))
    fitted, path = convolutional(rows), store.workspace(s, "network")
    models.save_arrays(s, path, fitted.net.name, list(METRICS), G, fitted.body(), s.createDataFrame(fitted.history))
    again = Fitted.from_body(models.load_arrays(s, path, fitted.net.name, list(METRICS), G))
    plain = rows.select("series_id", "start", "v", "draw")
    a, b = networks.scores(fitted, plain), networks.scores(again, plain).withColumnRenamed("score", "again")
    return a.join(b, ["series_id", "start"]).select("series_id", "start", (F.col("score") == F.col("again")).alias("same"))


query("network_history")(history)
query("network_scores")(network_scores)
query("criterion_epochs")(criteria)
query("network_round_trip", with_base("SELECT series_id, start, true AS same FROM starts"))(saved)
