"""Split runs and built detectors on small series."""

from __future__ import annotations

import math

import pytest

from vantarow.operators import compare, evaluate, series
from vantarow.operators.networks import Descent
from vantarow.operators.series import Geometry
from vantarow.sinks import store
from vantarow.sources.telemetry import METRICS

G = Geometry(window=12, stride=2, day=24, repage=6)


@pytest.fixture(scope="module")
def parts(spark):
    rows = []
    for s in ("a", "b"):
        for t in range(240):
            hot = t % 40 in (20, 21, 22)
            rows.append((s, t, *[math.sin(t / 3 + k) + (8.0 * (k + 1) if hot else 0.0) for k in range(len(METRICS))], int(hot)))
    points = spark.createDataFrame(rows, f"series_id string, t int, {', '.join(f'{m} double' for m in METRICS)}, point_label int")
    return compare.pieces(points, series.label_runs(points), G)


def test_no_window_crosses_a_cut(parts):
    sizes = {r.series_id: r.n for r in parts.points.groupBy("series_id").count().withColumnRenamed("count", "n").collect()}
    assert set(sizes) == {f"{p}/{s}" for p in ("train", "validation", "test") for s in "ab"} and sum(sizes.values()) == 480
    assert all(r.start + G.window <= sizes[r.series_id] for r in parts.index.collect())


@pytest.mark.parametrize("kind", ["naive_residual", "conv_autoencoder", "max_fusion"])
def test_built_detectors(parts, kind):
    found = compare.build_detector(kind, parts, G, 0.5, Descent(epochs=1, steps=1))
    assert found.name == kind and not found.notes and math.isfinite(found.threshold)
    assert found.scores.count() == parts.index.count()
    points, _, index = parts.of("validation")
    rate = evaluate.pages_per_threshold(evaluate.scored_windows(index, found.scores), points.sparkSession.createDataFrame([(found.threshold,)], "threshold double"), points, G).first()
    assert rate.pages_per_day <= 0.5


@pytest.mark.parametrize("kind", ["no_such", "conv_autoencoder"])
def test_a_failed_fit_falls_back(parts, kind):
    g = Geometry(window=10, stride=2, day=24, repage=6)  # no multiple of four
    found = compare.build_detector(kind, parts, g, 0.5, Descent(epochs=1, steps=1))
    assert found.name == compare.INCUMBENT and len(found.notes) == 1 and kind in found.notes[0]


def test_split_run_with_fusion(parts):
    from vantarow.operators import detectors

    members = {n: detectors.STATISTICS[n] for n in ("window_spread", "naive_residual")}
    rows = {r.detector: r for r in compare.run_split(parts, members, G, 0.5, fuse=("window_spread", "naive_residual"), replicates=50).collect()}
    assert set(rows) == {"window_spread", "naive_residual", "max_fusion"}
    assert rows["window_spread"].delta is None and all(rows[n].delta_low <= rows[n].delta <= rows[n].delta_high for n in ("naive_residual", "max_fusion"))
    assert all(r.events > 0 and 0 <= r.detection_rate <= 1 for r in rows.values())


def test_page_of_a_split_run(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5, 1.0, 0.5, 0.4, 0.1), ("b", 0.75, 2.0, 1.0, 2.5, None)], "detector string, curve_auc double, threshold double, detection_rate double, pages_per_day double, delta double")
    store.comparison_page(spark, rows, 1.0, str(tmp_path / "page"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "page")).collect() if r.value]
    assert lines[0] == "# Detectors on a split" and "Best area: b (0.750)." in lines and lines[-1].endswith("b page more often.")
    assert [x.split(" | ")[0] for x in lines if x.startswith("| ")] == ["| detector", "| b", "| a"] and "| b | 0.750 | 2.000 | 1.000 | 2.500 |  |" in lines
    store.comparison_page(spark, rows.where("false"), 1.0, str(tmp_path / "none"))
