"""Boosted trees against a plain booster, grouped folds, the search's log, saved models and their refusals, ranks."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantarow.operators import boosting, ranks, search
from vantarow.operators.boosting import UNIT, Settings
from vantarow.operators.series import Geometry
from vantarow.sinks import models

COLUMNS = ["a", "b", "c"]


def rows_of(n=200, seed=4):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 3)), 2)
    x[:: 17, 2] = np.nan
    label = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.5, "up", np.where(x[:, 1] > 0.4, "side", "down"))
    return [(int(i), int(i) // 7, *map(float, x[i]), str(label[i]), float(1 + i % 3)) for i in range(n)]


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id long, event long, a double, b double, c double, cause string, weight double").repartition(parts)


def plain_booster(rows, cuts, settings):
    """Rows and nodes by loops: class margins of every row after all rounds."""
    labels = sorted({r[5] for r in rows})
    bins = [[sum(v > c for c in cut) if v == v else 0 for v, cut in zip(r[2:5], cuts)] for r in rows]
    margins = [[0.0] * len(labels) for _ in rows]
    for _ in range(settings.rounds):
        steps = [[0.0] * len(labels) for _ in rows]
        for k, name in enumerate(labels):
            g, h = [], []
            for r, m in zip(rows, margins):
                p = np.exp(np.array(m) - max(m))
                p = p / p.sum()
                g.append(int(np.rint((p[k] - (r[5] == name)) * r[6] * UNIT)))
                h.append(int(np.rint(max(p[k] * (1 - p[k]), 1e-16) * r[6] * UNIT)))

            def grow(members, level):
                sg, sh = sum(g[i] for i in members) / UNIT, sum(h[i] for i in members) / UNIT
                best = None
                if level < settings.depth:
                    for f in range(3):
                        for b in range(31):
                            left = [i for i in members if bins[i][f] <= b]
                            lg, lh = sum(g[i] for i in left) / UNIT, sum(h[i] for i in left) / UNIT
                            if lh < settings.least or sh - lh < settings.least:
                                continue
                            gain = lg**2 / (lh + settings.penalty) + (sg - lg) ** 2 / (sh - lh + settings.penalty) - sg**2 / (sh + settings.penalty)
                            if best is None or gain > best[0]:
                                best = (gain, f, b)
                if best is None or best[0] <= 1e-9:
                    for i in members:
                        steps[i][k] = -settings.rate * sg / (sh + settings.penalty)
                    return
                _, f, b = best
                grow([i for i in members if bins[i][f] <= b], level + 1)
                grow([i for i in members if bins[i][f] > b], level + 1)

            grow(list(range(len(rows))), 0)
        margins = [[a + b for a, b in zip(m, s)] for m, s in zip(margins, steps)]
    return labels, np.array(margins)


def test_boosted_trees_equal_a_plain_booster(spark):
    rows, settings = rows_of(), Settings(rounds=4, depth=2)
    df = table(spark, rows)
    model = boosting.fit(df, COLUMNS, ["id"], settings)
    labels, margins = plain_booster(rows, boosting.bin_cuts(df, COLUMNS), settings)
    x = np.nan_to_num(np.array([r[2:5] for r in rows]), nan=-np.inf)
    assert list(model.labels) == labels == ["down", "side", "up"]
    np.testing.assert_allclose(sum(t.margins(x) for t in model.rounds), margins, atol=1e-9)
    told = {r.id: (r.predicted, r.confidence) for r in boosting.predict(model, df).collect()}
    p = boosting.softmax(margins)
    assert all(told[i] == (labels[p[i].argmax()], pytest.approx(p[i].max())) for i in range(len(rows)))
    assert np.mean([told[r[0]][0] == r[5] for r in rows]) > 0.9


def test_a_fit_does_not_depend_on_partitions(spark):
    settings = Settings(rounds=3, depth=3, rows=0.7, columns=0.7)
    one, seven = (boosting.fit(table(spark, rows_of(), n), COLUMNS, ["id"], settings).to_dict() for n in (1, 7))
    assert one == seven


def test_two_classes_and_models_of_one_pass(spark):
    rows = [(*r[:5], "x" if r[2] > 0 else "y", r[6]) for r in rows_of()]
    df = table(spark, rows).withColumn("fold", (F.col("event") % 3).cast("int"))
    plans = [(Settings(rounds=3, depth=2), 0), (Settings(rounds=5, depth=1), 2), (Settings(rounds=2, depth=3), -1)]
    together = boosting.fit_many(df, COLUMNS, plans, ["id"], fold="fold")
    for (settings, out), model in zip(plans, together):
        # cuts come from all rows in both calls: the left-out rows weigh nothing
        alone = boosting.fit_many(df, COLUMNS, [(settings, out)], ["id"], fold="fold")[0]
        assert model.to_dict() == alone.to_dict() and len(model.rounds) == settings.rounds


def test_left_out_rows_have_no_say(spark):
    rows = rows_of()
    df = table(spark, rows).withColumn("fold", (F.col("event") % 2).cast("int"))
    turned = df.withColumn("cause", F.when(F.col("fold") == 1, F.lit("up")).otherwise(F.col("cause")))
    a, b = (boosting.fit_many(x, COLUMNS, [(Settings(rounds=2, depth=2), 1)], ["id"], fold="fold")[0].to_dict() for x in (df, turned))
    assert a == b


def test_folds_keep_events_whole_and_even(spark):
    rows = [(e, w) for e in range(37) for w in range(1 + e % 9)]
    found = search.grouped_folds(spark.createDataFrame(rows, "event long, w int"), "event").collect()
    assert sorted(r.event for r in found) == list(range(37)) and all(r.n == 1 + r.event % 9 for r in found)
    weight = [sum(r.n for r in found if r.fold == f) for f in range(5)]
    assert max(weight) - min(weight) <= 9


def test_search_writes_the_same_log(spark):
    df = table(spark, rows_of(90)).join(search.grouped_folds(table(spark, rows_of(90)), "event", 3).select("event", "fold"), "event")
    whole = search.search(df, COLUMNS, ["id"], trials=6, together=2, folds=3)
    first = search.search(df, COLUMNS, ["id"], trials=4, together=2, folds=3)
    again = search.search(df, COLUMNS, ["id"], trials=6, together=2, folds=3, log=first)
    got = sorted(map(tuple, whole.collect()))
    assert got == sorted(map(tuple, again.collect())) and [r[0] for r in got] == list(range(6))
    best = max(got, key=lambda r: (r[3], -r[0]))
    assert [r[0] for r in got if r[4]] == [best[0]]
    assert search.best_settings(whole).depth == int(json.loads(best[1])["depth"])
    for r in got:
        for name, value in json.loads(r[1]).items():
            low, high, kind = search.SPACE[name]
            assert low <= value <= high and (kind != "whole" or value == int(value))


def test_the_search_learns():
    """On a known surface, later trials are better than the random ones that start."""
    log = []
    for n in range(40):
        params = search.propose(log, n)
        log.append((n, params, -abs(np.log(params["rate"] / 0.1)) - abs(params["rows"] - 0.9)))
    assert np.mean([s for _, _, s in log[20:]]) > np.mean([s for _, _, s in log[:4]])


def test_macro_f1_by_group(spark):
    rows = [(0, "a", "a"), (0, "b", "a"), (0, "b", "b"), (1, "a", "c")]
    got = {r.trial: r.macro_f1 for r in search.macro_f1_by(spark.createDataFrame(rows, "trial int, cause string, predicted string"), ["trial"]).collect()}
    assert got[0] == pytest.approx(2 / 3) and got[1] == 0


def test_saved_models_are_checked(spark, tmp_path):
    g = Geometry(window=12, stride=2)
    df = table(spark, rows_of())
    model = boosting.fit(df, COLUMNS, ["id"], Settings(rounds=2, depth=2))
    path = str(tmp_path / "model")
    models.save_booster(spark, model, path, g)
    again = models.load_booster(spark, path, COLUMNS, g, ["up", "down", "side"])
    assert again.to_dict() == model.to_dict()
    assert boosting.predict(again, df).exceptAll(boosting.predict(model, df)).isEmpty()
    for wrong, said in (
        ({"features": ["a", "z", "c"]}, "place 1"), ({"features": ["b", "a", "c"]}, "place 0"), ({"features": ["a", "b"]}, "place 2"),
        ({"geometry": Geometry(window=60, stride=10)}, "windows of"), ({"labels": ["up"]}, "classes"),
    ):
        with pytest.raises(models.Mismatch, match=said):
            models.load_booster(spark, path, **wrong)
    with pytest.raises(models.Mismatch, match="not pipeline"):
        models.check(models.read_spec(spark, path)[0], "pipeline", None, None, None)


def test_saved_pipeline(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    df = table(spark, rows_of()).fillna(0.0)
    model = Pipeline(stages=[StringIndexer(inputCol="cause", outputCol="label"), VectorAssembler(inputCols=COLUMNS, outputCol="features"), RandomForestClassifier(numTrees=3, seed=1)]).fit(df)
    path = str(tmp_path / "forest")
    models.save_pipeline(model, path, COLUMNS, ["up", "down", "side"], Geometry())
    again = models.load_pipeline(spark, path, COLUMNS, Geometry())
    assert {(r.id, r.prediction) for r in again.transform(df).collect()} == {(r.id, r.prediction) for r in model.transform(df).collect()}
    with pytest.raises(models.Mismatch, match="place 2"):
        models.load_pipeline(spark, path, ["a", "b", "x"])


def test_order_statistics(spark):
    r = random.Random(2)
    values = [r.choice([1.5, 2.0, r.random()]) for _ in range(501)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "score double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.777, 0.999, 1.0]
    got = {x.share: x.value for x in ranks.order_statistics(df, "score", shares).collect()}
    want = np.percentile([v for v in values if v is not None], [100 * s for s in shares])
    assert [got[s] for s in shares] == pytest.approx(list(want))
    assert ranks.order_statistics(df.where("score is null"), "score", shares).count() == 0
    two = df.select("score", F.lit("a").alias("kind")).unionByName(df.select((F.col("score") * -1).alias("score"), F.lit("b").alias("kind")))
    both = {(x.kind, x.share): x.value for x in ranks.order_statistics(two, "score", [0.25, 1.0], by="kind").collect()}
    low = np.percentile([-v for v in values if v is not None], 25)
    assert both == {("a", 0.25): pytest.approx(got[0.25]), ("a", 1.0): got[1.0], ("b", 0.25): pytest.approx(low), ("b", 1.0): -got[0.0]}
    one = ranks.order_statistics(spark.createDataFrame([(3.0,)], "score double"), "score", [0.0, 0.5, 1.0]).collect()
    assert [x.value for x in one] == [3.0] * 3


def test_numbers_are_gapless_over_runs(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("run"))
    got = ranks.numbered(df.withColumnRenamed("run", "kind"), ["k"], "place").collect()
    assert all(r.place == r.k for r in got) and len(got) == 1000
