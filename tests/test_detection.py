from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantarow.operators import classify, detectors, evaluate, series, windows
from vantarow.operators.series import Geometry

ONE = ("a",)


def points(spark, values, labels=None, name="s"):
    labels = labels or [0] * len(values)
    return spark.createDataFrame([(name, i, float(v), int(x)) for i, (v, x) in enumerate(zip(values, labels))], "series_id string, t int, a double, point_label int")


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id int, series_id string, start int, end int")


def scored(spark, rows):
    return spark.createDataFrame(rows, "series_id string, start int, label int, event_id int, score double")


def test_majority_owner_and_labels(spark):
    p = points(spark, [0] * 60)
    got = windows.window_index(p, events(spark, [(1, "s", 0, 10), (2, "s", 10, 60)]), Geometry(60, 10)).collect()
    assert [(r.label, r.event_id) for r in got] == [(1, 2)]
    p = points(spark, [0] * 180)
    got = windows.window_index(p, events(spark, [(1, "s", 0, 30)]), Geometry(60, 60)).orderBy("start").collect()
    assert [(r.label, r.event_id) for r in got] == [(1, 1), (0, -1), (0, -1)]
    assert windows.window_index(points(spark, [0] * 30), events(spark, []), Geometry(60, 10)).count() == 0


def test_parts_of_a_long_series_change_nothing(spark):
    values = np.random.default_rng(1).normal(size=400)
    p, g = points(spark, values), Geometry(24, 4)
    columns = {"m": lambda frame: F.avg("a").over(frame(0, g.window - 1)), "x": lambda frame: F.max("a").over(frame(0, g.window - 1))}
    whole = windows.over_windows(p, g, columns).orderBy("start").collect()
    parts = windows.over_windows(p, g, columns, part=40).orderBy("start").collect()
    assert [(r.start, round(r.m, 9), r.x) for r in whole] == [(r.start, round(r.m, 9), r.x) for r in parts]
    assert [r.start for r in whole] == list(range(0, 377, 4))


def test_ramp_features(spark):
    r = windows.features(points(spark, range(60)), Geometry(60, 60), ONE).first()
    assert (round(r.a_slope, 9), r.a_half_diff, r.a_mean) == (1.0, 30.0, 29.5)


def test_detectors_against_numpy(spark):
    values = np.random.default_rng(2).normal(size=90)
    p, g = points(spark, values), Geometry(12, 3)
    w = np.array([values[i : i + 12] for i in range(0, 79, 3)])
    s = w.copy()
    for i in range(1, 12):
        s[:, i] = 0.3 * w[:, i] + 0.7 * s[:, i - 1]
    want = {"max_deviation": np.abs(w).max(1), "window_spread": w.std(1), "naive_residual": np.abs(np.diff(w)).max(1), "ewma_residual": np.abs(w - s).max(1)}
    for name, expected in want.items():
        got = [r.score for r in detectors.STATISTICS[name](p, g, ONE).orderBy("start").collect()]
        assert np.allclose(got, expected), name


def test_models_rank_a_level_shift_high(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=600)
    values[300:330] += 8
    g = Geometry(20, 5)
    train, test = points(spark, rng.normal(size=600)), points(spark, values)
    for f in (detectors.isolation_forest, detectors.pca_residual):
        rows = f(train, test, g, ONE).collect()
        top = {r.start for r in sorted(rows, key=lambda r: -r.score)[:6]}
        assert top & set(range(281, 330)), f.__name__


def test_outcomes_delay_and_standing_alarm(spark):
    g = Geometry(60, 20)
    inc = events(spark, [(0, "s", 100, 200)])
    rows = [("s", t, int(t + 60 > 100 and t < 200), 0 if t + 60 > 100 and t < 200 else -1, 1.0 if t == 80 else 0.0) for t in range(0, 300, 20)]
    r = evaluate.event_outcomes(scored(spark, rows), inc, 0.5, g).first()
    assert (r.detected, r.minutes, r.pre_alarmed) == (True, 40, False)
    always = [(a, b, c, d, 1.0) for a, b, c, d, _ in rows]
    assert evaluate.event_outcomes(scored(spark, always), inc, 0.5, g).first().pre_alarmed
    none = evaluate.event_outcomes(scored(spark, [(*r[:4], 0.0) for r in rows]), inc, 0.5, g).first()
    assert (none.detected, none.minutes) == (False, None)


def test_episodes_and_pages(spark):
    g = Geometry(60, 20, 1440, 60)
    one = spark.createDataFrame([(0.5,)], "threshold double")
    fire = {1, 2, 10, 20}
    w = scored(spark, [("s", 20 * i, 0, -1, float(i in fire)) for i in range(30)])
    got = evaluate.alarm_episodes(w, one, g)
    assert got.count() == 3 and got.agg(F.sum("pages")).first()[0] == 3
    for minutes, pages in ((180, 3), (40, 1)):
        w = scored(spark, [("s", 20 * i, 0, -1, float(20 * i < minutes)) for i in range(30)])
        assert evaluate.alarm_episodes(w, one, g).agg(F.sum("pages")).first()[0] == pages
    two = scored(spark, [(s, 20 * i, 0, -1, 1.0) for s in "ab" for i in range(2)])
    assert evaluate.alarm_episodes(two, one, g).count() == 2


def test_areas_and_empty_classes(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "score double, label int")
    assert evaluate.roc_auc(rows).first()[0] == 0.75
    assert round(evaluate.average_precision(rows).first()[0], 6) == 0.833333
    assert evaluate.roc_auc(rows.where("label = 0")).first()[0] is None
    curve = spark.createDataFrame([(1.0, 0.2, 0.9), (0.8, 1.0, 0.95), (0.5, 5.0, 1.0)], "threshold double, pages_per_day double, detection_rate double")
    assert 0.93 < evaluate.curve_auc(curve).first()[0] < 0.96


def test_paired_delta_refuses_other_incidents(spark):
    a = spark.createDataFrame([(i, i < 8) for i in range(10)], "event_id int, detected boolean")
    b = spark.createDataFrame([(i, i < 5) for i in range(10)], "event_id int, detected boolean")
    r = evaluate.paired_delta(a, b, replicates=100).first()
    assert round(r.estimate, 6) == 0.3 and r.low <= 0.3 <= r.high
    with pytest.raises(Exception, match="differ"):
        evaluate.paired_delta(a, b.where("event_id > 0"), replicates=10).collect()


def test_scaler_round_trip_and_flat_metric(spark):
    p = points(spark, [5.0] * 10)
    stats = series.fit_scaler(p, ONE)
    assert stats.first().std == 1.0
    assert [r.a for r in series.inverse_transform(series.transform(p, stats, ONE), stats, ONE).collect()] == [5.0] * 10


def test_signatures_votes_and_names(spark):
    inc = spark.createDataFrame([(0, [1, 3]), (1, [0, 5, 99]), (2, [])], "event_id int, dims array<int>")
    assert {r.event_id: r.signature for r in classify.signature_matrix(inc, 4).collect()} == {0: [1, 0, 1, 0], 1: [0, 0, 0, 0]}
    votes = spark.createDataFrame([(0, 0, "0"), (0, 1, "0"), (0, 2, "1"), (1, 0, "1"), (1, 1, "1"), (1, 2, "0")], "event_id int, start int, predicted string")
    assert {r.event_id: r.verdict for r in classify.majority_vote(votes).collect()} == {0: "0", 1: "1"}
    many = spark.createDataFrame([(i, [1, 2]) for i in range(30)] + [(40 + i, [9]) for i in range(3)], "event_id int, dims array<int>")
    s = classify.signature_matrix(many, 12)
    got = classify.archetypes(s, classify.archetype_clusters(s, 2), 12, support=10).collect()
    assert [(r.name, r.support, r.profile) for r in got] == [("narrow_signature", 30, [1, 2])]


def test_infinite_threshold_for_empty_scores(spark):
    w, p = scored(spark, []), points(spark, [0.0])
    assert math.isinf(evaluate.threshold_at_budget(w, p).first()[0])
