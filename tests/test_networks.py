"""Networks: gradients by finite differences, training that falls, epochs chosen by each criterion, saved weights."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantarow.operators import networks
from vantarow.operators.networks import ConvNetwork, Descent, RecurrentNetwork
from vantarow.operators.series import Geometry
from vantarow.sinks import models

METRICS, LENGTH = 2, 8


@pytest.mark.parametrize("net", [ConvNetwork(2, 8, width=3, latent=2), RecurrentNetwork(2, 6, hidden=3)], ids=["conv", "recurrent"])
def test_gradients(net):
    rng = np.random.default_rng(1)
    flat, x = net.start(3) + rng.normal(scale=0.05, size=net.size), rng.normal(size=(5, net.length, 2))
    _, grad = net.loss(flat, x)
    for i in rng.choice(net.size, 40, replace=False):
        step = np.zeros(net.size)
        step[i] = 1e-5
        slope = (net.loss(flat + step, x)[0] - net.loss(flat - step, x)[0]) / 2e-5
        assert grad[i] == pytest.approx(slope, rel=1e-4, abs=1e-7)


def windows(spark, n=240, seed=2):
    """Waves of one shape; every eighth window is a broken one with label 1."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t = np.arange(LENGTH) + rng.uniform(0, 6)
        v = np.stack([np.sin(t), np.cos(t)]) + rng.normal(scale=0.05, size=(2, LENGTH))
        if i % 8 == 7:
            v = rng.normal(size=(2, LENGTH))
        rows.append(("s", i, v.ravel().tolist(), int(i % 8 == 7)))
    return spark.createDataFrame(rows, "series_id string, start int, v array<double>, label int").withColumn("draw", F.xxhash64("series_id", "start")).repartition(3).cache()


def test_conv_training_falls_and_keeps_its_best_epoch(spark, tmp_path):
    df = windows(spark)
    normal = df.where("label = 0").drop("label")
    fitted = networks.fit_conv(normal, METRICS, LENGTH, Descent(epochs=8, steps=3, rate=2e-2), width=8, latent=4)
    held = [h["holdout"] for h in fitted.history]
    assert len(held) == 8 and min(held) < 0.6 * held[0] and fitted.epoch == 1 + int(np.argmin(held))
    rates = [h["rate"] for h in fitted.history]
    assert rates[0] == 2e-2 and rates == sorted(rates, reverse=True)
    means = {r.label: r.m for r in networks.scores(fitted, df).groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > 1.5 * means[0]
    g, path = Geometry(window=LENGTH, stride=2), str(tmp_path / "net")
    models.save_arrays(spark, path, fitted.net.name, ["a", "b"], g, fitted.body(), spark.createDataFrame(fitted.history))
    again = networks.Fitted.from_body(models.load_arrays(spark, path, "conv_autoencoder", ["a", "b"], g))
    assert networks.scores(again, df).exceptAll(networks.scores(fitted, df)).isEmpty()
    with pytest.raises(models.Mismatch, match="windows of"):
        models.load_arrays(spark, path, "conv_autoencoder", ["a", "b"], Geometry(window=60, stride=2))
    with pytest.raises(ValueError, match="multiple of four"):
        ConvNetwork(2, 10)


def test_a_step_does_not_depend_on_partitions(spark):
    df = windows(spark, 60)
    net = RecurrentNetwork(METRICS, LENGTH, hidden=4)
    flat = net.start(1)
    (a, ea, na), (b, eb, nb) = (networks._step(df.repartition(k), net, flat, 1, 0, 2) for k in (1, 5))
    np.testing.assert_allclose(a, b, atol=1e-12)
    assert na == nb and 0 < na < 60 and ea == pytest.approx(eb)
    halves = sum(networks._step(df, net, flat, 1, s, 2)[2] for s in (0, 1))
    assert halves == 60  # every window is in one step of an epoch


@pytest.mark.parametrize("criterion", networks.CRITERIA)
def test_recurrent_training_by_each_criterion(spark, criterion):
    df = windows(spark, 160)
    how = Descent(epochs=6, steps=2, rate=3e-2, cosine=False, decay=0.0, largest=None, patience=2)
    fitted = networks.fit_recurrent(df.where("label = 0").drop("label"), df, METRICS, LENGTH, criterion, how, hidden=6)
    figures = [h[criterion] for h in fitted.history]
    assert fitted.epoch == 1 + int(np.argmin(figures)) == networks.chosen_epochs(fitted.history)[criterion]
    assert len(figures) == 6 or len(figures) - fitted.epoch == 2  # patience ends it
    assert fitted.history[-1]["train"] < fitted.history[0]["train"]


def test_too_few_windows(spark):
    df = windows(spark, 8).where("false").drop("label")
    with pytest.raises(ValueError, match="too few"):
        networks.fit_conv(df, METRICS, LENGTH, Descent(epochs=1, steps=1))
