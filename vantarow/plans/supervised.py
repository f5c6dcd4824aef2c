"""Queries on supervised cause classification: rows, folds, boosted trees, search, saved models. SQL beside what it can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantarow.operators import boosting, classify, search, windows
from vantarow.operators.boosting import Settings
from vantarow.plans.detection import _SPANS, G, incidents_of, points, settled, with_base, with_dims
from vantarow.plans.registry import Registry
from vantarow.sinks import models, store
from vantarow.sources.telemetry import METRICS

REGISTRY = Registry()
query = REGISTRY.query
FEATURES = [f"{m}_{k}" for m in METRICS for k in ("mean", "std", "min", "max", "slope", "half_diff")]
KEY = ["series_id", "start"]
#: Least number of events that make a signature a class.
SUPPORT = 2


def causes(p: DataFrame) -> DataFrame:
    """Class of each event: the metrics that its annotations name, where enough events share them; else other."""
    names = F.array(*[F.lit(m) for m in METRICS])
    rows = with_dims(p).select("event_id", F.array_join(F.transform("dims", lambda d: F.element_at(names, d)), "+").alias("label"))
    known = rows.where("label != ''").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    return rows.join(known.select("label"), "label", "left_semi")


def training_rows(p: DataFrame) -> DataFrame:
    """Features, class and event of every anomalous window; windows of no known class are left out."""
    index = windows.window_index(p, incidents_of(p), G).where("label = 1").select("series_id", "start", "event_id")
    return classify.with_class(index, causes(p)).where(F.col("cause") != classify.OTHER).join(windows.features(p, G), KEY)


def prepared(s: SparkSession, d: str) -> DataFrame:
    """Training rows with the fold of their event and balanced weights."""
    rows = settled(training_rows(points(s, d)), "training")
    folds = search.grouped_folds(rows, "event_id").select("event_id", "fold")
    weighed = rows.join(F.broadcast(classify.balanced_weights(rows)), "cause")
    return settled(weighed.join(folds, "event_id"), "prepared")


_CLASSES = f"""{_SPANS},
signed AS (SELECT event_id, array_to_string(list_transform(dims, lambda x: ['n_events', 'mean_value', 'max_value', 'error_rate'][x]), '+') AS label FROM dims),
known AS (SELECT label FROM signed WHERE label <> '' GROUP BY label HAVING count(*) >= {SUPPORT}),
trained AS (SELECT idx.series_id, idx.start, idx.event_id, signed.label AS cause FROM idx JOIN signed USING (event_id) WHERE idx.label = 1 AND signed.label IN (SELECT label FROM known)),
dealt AS (SELECT event_id, n, (row_number() OVER (ORDER BY n DESC, event_id) - 1) % 10 AS turn FROM (SELECT event_id, count(*) AS n FROM trained GROUP BY event_id)),
folds AS (SELECT event_id, n, CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS fold FROM dealt)"""
query("classification_rows", with_base("SELECT series_id, start, event_id, cause, round(avg(max_value), 6) AS max_value_mean, round(stddev_pop(mean_value), 6) AS mean_value_std FROM trained JOIN (SELECT series_id, t, max_value, mean_value FROM mp) p USING (series_id) WHERE p.t >= start AND p.t < start + 12 GROUP BY ALL", _CLASSES))(
    lambda s, d: training_rows(points(s, d)).select("series_id", "start", "event_id", "cause", F.round("max_value_mean", 6).alias("max_value_mean"), F.round("mean_value_std", 6).alias("mean_value_std"))
)
query("grouped_folds", with_base("SELECT event_id, n, fold::INT AS fold FROM folds", _CLASSES))(lambda s, d: search.grouped_folds(training_rows(points(s, d)), "event_id"))
query("class_weights", with_base("SELECT cause, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM trained GROUP BY cause", _CLASSES))(
    lambda s, d: classify.balanced_weights(training_rows(points(s, d))).select("cause", F.round("weight", 9).alias("weight"))
)
#: Of the queries that fit: rounds and depth that their passes over small tables pay for.
LIGHT = Settings(rounds=10, depth=2)


def out_of_fold(s: SparkSession, d: str) -> DataFrame:
    """Every training window with the verdict of a model that saw no window of its event."""
    rows = prepared(s, d)
    fitted = boosting.fit_many(rows, FEATURES, [(LIGHT, f) for f in range(5)], KEY, fold="fold")
    return boosting.out_of_fold([(0, f, m) for f, m in enumerate(fitted)], rows)


def beside_forest(s: SparkSession, d: str) -> DataFrame:
    """Macro F1 by event of boosted trees and of the forest, both out of fold 0."""
    rows = prepared(s, d)
    train, test = rows.where("fold != 0").drop("weight"), rows.where("fold = 0").drop("weight")
    weighed = train.join(F.broadcast(classify.balanced_weights(train)), "cause")
    boosted = boosting.predict(boosting.fit(weighed, FEATURES, KEY, LIGHT), test).select("event_id", "start", "predicted", F.lit("boosted_trees").alias("model"))
    forest = classify.predict(train, test, FEATURES).select("event_id", "start", "predicted", F.lit("forest").alias("model"))
    truth = test.select("event_id", F.col("cause").alias("truth")).distinct()
    out = None
    for found in (boosted, forest):
        held = settled(found, "verdicts")
        score = classify.macro_f1(classify.confusion_matrix(classify.majority_vote(held).join(truth, "event_id")))
        row = held.select("model").distinct().crossJoin(F.broadcast(score))
        out = row if out is None else out.unionByName(row)
    return out


def round_trip(s: SparkSession, d: str) -> DataFrame:
    """Per training window: does a model that was saved and loaded say the same as the fitted one?"""
    rows = prepared(s, d)
    model = boosting.fit(rows, FEATURES, KEY, LIGHT)
    path = store.workspace(s, "model")
    models.save_booster(s, model, path, G)
    again = models.load_booster(s, path, FEATURES, G)
    a = boosting.predict(model, rows).select(*KEY, F.col("predicted").alias("a"), F.col("confidence").alias("ca"))
    b = boosting.predict(again, rows).select(*KEY, F.col("predicted").alias("b"), F.col("confidence").alias("cb"))
    return a.join(b, KEY).select(*KEY, ((F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb"))).alias("same"))


def forest_predictions(s: SparkSession, d: str) -> DataFrame:
    """Causes of incident windows by a forest that was fitted on four folds of events and is held against the fifth."""
    rows = prepared(s, d).drop("weight")
    return classify.predict(rows.where("fold != 0"), rows.where("fold = 0"), FEATURES).select("series_id", "start", "cause", "predicted")


query("classifier_predictions")(forest_predictions)
query("boosted_out_of_fold")(lambda s, d: out_of_fold(s, d).select("series_id", "start", "event_id", "fold", "cause", "predicted"))
query("boosted_beside_forest")(beside_forest)
query("parameter_trials")(lambda s, d: search.search(prepared(s, d), FEATURES, KEY, trials=6, together=6))
query("model_round_trip", with_base("SELECT series_id, start, true AS same FROM trained", _CLASSES))(round_trip)
