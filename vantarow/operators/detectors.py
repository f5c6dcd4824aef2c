"""Detectors: one score per window, larger is more anomalous; thresholds are chosen elsewhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantarow.operators.ranks import order_statistics
from vantarow.operators.series import Geometry
from vantarow.operators.windows import over_windows, summary_stats, window_arrays
from vantarow.sources.telemetry import METRICS

#: A detector takes scaled points and a geometry and returns (series_id, start, score).
Detector = Callable[[DataFrame, Geometry], DataFrame]


def _largest(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def max_deviation(points: DataFrame, g: Geometry, metrics=METRICS) -> DataFrame:
    """Largest absolute standard score."""
    top = _largest([F.abs(F.col(m)) for m in metrics])
    return over_windows(points, g, {"score": lambda frame: F.max(top).over(frame(0, g.window - 1))})


def window_spread(points: DataFrame, g: Geometry, metrics=METRICS) -> DataFrame:
    """Largest population deviation of a metric inside the window."""
    return over_windows(points, g, {"score": lambda frame: _largest([F.stddev_pop(m).over(frame(0, g.window - 1)) for m in metrics])})


def naive_residual(points: DataFrame, g: Geometry, metrics=METRICS) -> DataFrame:
    """Largest step between neighbours; 0 for windows of one step."""
    if g.window < 2:
        return over_windows(points, g, {"score": lambda frame: F.lit(0.0)})
    arrays = window_arrays(points, g, metrics)

    def step(m: str) -> Column:
        return F.array_max(F.zip_with(F.slice(m, 2, g.window - 1), F.slice(m, 1, g.window - 1), lambda b, a: F.abs(b - a)))

    return arrays.select("series_id", "start", _largest([step(m) for m in metrics]).alias("score"))


def ewma_residual(points: DataFrame, g: Geometry, metrics=METRICS, alpha: float = 0.3) -> DataFrame:
    """Largest departure from a moving average that starts anew with the first value of each window."""

    def departure(m: str) -> Column:
        first = F.struct(F.element_at(m, 1).alias("s"), F.lit(0.0).alias("worst"))

        def fold(a: Column, x: Column) -> Column:
            s = alpha * x + (1 - alpha) * a["s"]
            return F.struct(s.alias("s"), F.greatest(a["worst"], F.abs(x - s)).alias("worst"))

        return F.aggregate(F.slice(m, 2, max(0, g.window - 1)), first, fold, lambda a: a["worst"])

    return window_arrays(points, g, metrics).select("series_id", "start", _largest([departure(m) for m in metrics]).alias("score"))


STATISTICS: dict[str, Detector] = {"max_deviation": max_deviation, "window_spread": window_spread, "ewma_residual": ewma_residual, "naive_residual": naive_residual}


def all_scores(points: DataFrame, g: Geometry, detectors: dict[str, Detector] | None = None) -> DataFrame:
    """Scores of all detectors in long form, rounded to 9 decimals so that sweeps meet no last-bit ties."""
    parts = [f(points, g).select(F.lit(name).alias("detector"), "series_id", "start", F.round("score", 9).alias("score")) for name, f in (detectors or STATISTICS).items()]
    return reduce(DataFrame.unionByName, parts)


def fusion_scale(scores: DataFrame) -> DataFrame:
    """Median and interquartile range of each detector over the scores that it is given (normal training windows)."""
    q = order_statistics(scores, "score", [0.25, 0.5, 0.75], by="detector").groupBy("detector").pivot("share", [0.25, 0.5, 0.75]).agg(F.first("value"))
    low, middle, high = q.columns[1:]
    return q.select("detector", F.col(f"`{middle}`").alias("median"), (F.col(f"`{high}`") - F.col(f"`{low}`")).alias("iqr"))


def max_fusion(scores: DataFrame, scale: DataFrame) -> DataFrame:
    """Largest robust score of two members or more; a range under 1e-9 counts as that."""
    robust = scores.join(F.broadcast(scale), "detector").withColumn("z", (F.col("score") - F.col("median")) / F.greatest(F.col("iqr"), F.lit(1e-9)))
    fused = robust.groupBy("series_id", "start").agg(F.max("z").alias("score"), F.countDistinct("detector").alias("members")).where("members >= 2")
    return fused.select("series_id", "start", "score")


def _path_length(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_forest(sample: np.ndarray, trees: int = 200, size: int = 256, seed: int = 42) -> list[list[tuple]]:
    """Isolation trees as rows (feature, threshold, left, right, size of leaf) on random subsamples."""
    rng = np.random.default_rng(seed)
    size = min(size, len(sample))
    limit = int(np.ceil(np.log2(max(2, size))))
    forest = []
    for _ in range(trees):
        nodes: list = []

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append(None)
            low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (0, 0)
            able = np.flatnonzero(high > low) if len(rows) > 1 else []
            if depth >= limit or not len(able):
                nodes[at] = (-1, 0.0, -1, -1, len(rows))
                return at
            f = int(rng.choice(able))
            cut = float(rng.uniform(low[f], high[f]))
            side = rows[:, f] < cut
            left, right = grow(rows[side], depth + 1), grow(rows[~side], depth + 1)
            nodes[at] = (f, cut, left, right, len(rows))
            return at

        grow(sample[rng.choice(len(sample), size, replace=False)], 0)
        forest.append(nodes)
    return forest


def isolation_forest(train: DataFrame, test: DataFrame, g: Geometry, metrics=METRICS, limit: int = 20_000, trees: int = 200, size: int = 256, seed: int = 42) -> DataFrame:
    """Isolation forest on window statistics. Fitted on at most ``limit`` normal windows chosen by hash; scores all.

    Score: 2**(-mean depth / c(size)) - 0.5, as in the published algorithm; every tree sees ``size`` windows.
    """
    names = [f"{m}_{k}" for m in metrics for k in ("mean", "std", "min", "max")]
    sample = np.array(summary_stats(train, g, metrics).orderBy(F.xxhash64("series_id", "start"), "series_id", "start").limit(limit).select(*names).toArrow().to_pandas(), float)
    if not len(sample):
        return summary_stats(test, g, metrics).select("series_id", "start", F.lit(0.0).alias("score"))
    forest = test.sparkSession.sparkContext.broadcast(grow_forest(sample, trees, size, seed))
    norm = float(_path_length(np.array([min(size, len(sample))]))[0]) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(float)
            depth = np.zeros(len(x))
            for nodes in forest.value:
                table = np.array(nodes, float)
                at, level = np.zeros(len(x), int), np.zeros(len(x))
                while True:
                    f = table[at, 0].astype(int)
                    inner = f >= 0
                    if not inner.any():
                        break
                    left = x[np.arange(len(x)), np.maximum(f, 0)] < table[at, 1]
                    at = np.where(inner, np.where(left, table[at, 2], table[at, 3]).astype(int), at)
                    level += inner
                depth += level + _path_length(table[at, 4])
            yield pd.DataFrame({"series_id": batch["series_id"], "start": batch["start"], "score": 2.0 ** (-(depth / len(forest.value)) / norm) - 0.5})

    return summary_stats(test, g, metrics).mapInPandas(score, "series_id string, start int, score double")


def centred_windows(points: DataFrame, g: Geometry, metrics=METRICS) -> DataFrame:
    """Windows as one vector each (values, features), every metric less its mean in the window."""
    from pyspark.ml.functions import array_to_vector

    def centre(m: str) -> Column:
        mean = F.aggregate(F.col(m), F.lit(0.0), lambda a, x: a + x) / F.size(m)
        return F.transform(m, lambda x: x - mean)

    arrays = window_arrays(points, g, metrics)
    return arrays.select("series_id", "start", F.flatten(F.array(*[centre(m) for m in metrics])).alias("values")).withColumn("features", array_to_vector("values"))


def _residuals(fit: DataFrame, scored: DataFrame, components: int, width: int) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    model = PCA(k=min(components, width), inputCol="features", outputCol="projected").fit(fit)
    rows = model.transform(scored).withColumn("projected", vector_to_array("projected"))
    # for orthonormal components the residual's energy is the window's less the projection's
    energy = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x) - F.aggregate("projected", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("series_id", "start", F.sqrt(F.greatest(energy, F.lit(0.0)) / F.lit(float(width))).alias("score"))


def pca_residual(train: DataFrame, test: DataFrame, g: Geometry, metrics=METRICS, components: int = 4) -> DataFrame:
    """Root mean square of what the leading principal components of centred normal windows leave.

    A linear stand-in for a reconstruction network; Spark's own PCA and projections, no Python rows.
    """
    return _residuals(centred_windows(train, g, metrics), centred_windows(test, g, metrics), components, g.window * len(metrics))


def pca_holdout(train: DataFrame, g: Geometry, metrics=METRICS, components: int = 4, every: int = 10) -> DataFrame:
    """How well components of nine tenths of the normal windows reconstruct the tenth that a hash holds out: windows and mean error of both."""
    held = F.pmod(F.xxhash64("series_id", "start"), F.lit(every)) == 0
    rows = centred_windows(train, g, metrics)
    errors = _residuals(rows.where(~held), rows, components, g.window * len(metrics)).withColumn("held", held)
    return errors.groupBy("held").agg(F.count(F.lit(1)).alias("windows"), F.avg("score").alias("error"))
