"""Cause classification: signatures, archetypes, features, models, votes and metrics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "other"


def signature_matrix(incidents: DataFrame, n: int) -> DataFrame:
    """Multi-hot array of 1-based dims; those out of range are ignored. Events without dims are left out."""
    hot = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda d: F.array_contains("dims", d).cast("int"))
    return incidents.where(F.size("dims") > 0).select("event_id", hot.alias("signature"))


def archetype_clusters(signatures: DataFrame, k: int = 6, limit: int = 5000) -> DataFrame:
    """Average-linkage clusters of signatures by cosine distance: (event_id, cluster).

    Equal signatures are one weighted point. The ``limit`` most frequent ones are linked, in one task (the bound of
    the fit); every other signature joins the cluster that it is nearest to on average. No event is left out.
    """
    kinds = signatures.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    linked = kinds.orderBy(F.desc("n"), "signature").limit(limit)

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.assign(__s=rows["signature"].map(lambda s: "".join(map(str, s)))).sort_values("__s")
        x = np.array(rows["signature"].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        size = rows["n"].to_numpy(float)
        d = 1 - x @ x.T
        np.fill_diagonal(d, np.inf)
        groups: dict[int, list[int]] = {i: [i] for i in range(len(x))}
        weight = size.copy()
        while len(groups) > k:
            i, j = np.unravel_index(np.argmin(d), d.shape)
            i, j = min(i, j), max(i, j)
            d[i] = d[:, i] = (d[i] * weight[i] + d[j] * weight[j]) / (weight[i] + weight[j])
            d[i, i] = np.inf
            d[j] = d[:, j] = np.inf
            weight[i] += weight[j]
            groups[i] += groups.pop(j)
        out = np.zeros(len(x), int)
        for c, members in enumerate(sorted(groups.values(), key=lambda m: (-size[m].sum(), min(m)))):
            out[members] = c
        return pd.DataFrame({"signature": rows["signature"], "cluster": out})

    fitted = linked.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(lambda rows: link(rows[["signature", "n"]]), "signature array<int>, cluster int")

    def unit(signature):
        norm = F.sqrt(F.aggregate(signature, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(signature, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))

    # the mean cosine to the members of a cluster is the product with the mean of their unit vectors: k rows
    each = fitted.join(linked, "signature").select("cluster", "n", F.posexplode(unit(F.col("signature"))).alias("d", "x"))
    means = each.groupBy("cluster", "d").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("m")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda v: v["m"]).alias("mean"))
    rest = kinds.join(fitted.select("signature"), "signature", "left_anti").crossJoin(F.broadcast(means))
    near = rest.withColumn("cosine", F.aggregate(F.zip_with(unit(F.col("signature")), "mean", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))
    nearest = near.groupBy("signature").agg(F.max_by("cluster", F.struct(F.round("cosine", 9), -F.col("cluster"))).alias("cluster"))
    return signatures.join(fitted.unionByName(nearest), "signature").select("event_id", "cluster")


def archetypes(signatures: DataFrame, clusters: DataFrame, n: int, support: int = 20) -> DataFrame:
    """Name, support and profile of every cluster with enough events: narrow or broad, numbered on repeats by size."""
    rows = signatures.join(clusters, "event_id").withColumn("dims", F.aggregate("signature", F.lit(0), lambda a, x: a + x))
    size = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("support"), F.median("dims").alias("median_dims")).where(F.col("support") >= support)
    size = size.withColumn("kind", F.when(F.col("median_dims") <= max(3, n // 8), "narrow_signature").otherwise("broad_signature"))
    order = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("support"), "cluster"))
    size = size.withColumn("name", F.when(order == 1, F.col("kind")).otherwise(F.concat_ws("_", "kind", order.cast("string"))))
    share = rows.select("cluster", F.posexplode("signature").alias("d", "on")).groupBy("cluster", "d").agg(F.avg("on").alias("share")).where("share > 0.25")
    top = share.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("share"), "d"))).where("k <= 8")
    profile = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("d") + 1).alias("dim")))), lambda x: x["dim"]).alias("profile"))
    return size.join(profile, "cluster", "left").select("cluster", "name", "support", F.coalesce("profile", F.array().cast("array<int>")).alias("profile"))


def dim_shares(signatures: DataFrame) -> DataFrame:
    """Share of events that each dimension is part of."""
    return signatures.select(F.posexplode("signature").alias("d", "on")).groupBy((F.col("d") + 1).alias("dim")).agg(F.round(F.avg("on"), 6).alias("share"))


def with_class(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Class of each row's event (event_id, label); other where it has none."""
    return rows.join(labels.select("event_id", F.col("label").alias("cause")), "event_id", "left").withColumn("cause", F.coalesce("cause", F.lit(OTHER)))


def majority_vote(predictions: DataFrame) -> DataFrame:
    """One verdict per event from its windows (event_id, start, predicted); of equals, the class seen first."""
    votes = predictions.groupBy("event_id", "predicted").agg(F.count(F.lit(1)).alias("votes"), F.min("start").alias("first"))
    return votes.groupBy("event_id").agg(F.min_by("predicted", F.struct((-F.col("votes")).alias("v"), "first", "predicted")).alias("verdict"))


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """Counts by truth and verdict."""
    return rows.groupBy("truth", "verdict").agg(F.count(F.lit(1)).alias("n"))


def class_scores(confusion: DataFrame) -> DataFrame:
    """Precision, recall and F1 by class; 0 where undefined."""
    t = confusion.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("truth") == F.col("verdict"), F.col("n")).otherwise(0)).alias("tp"))
    v = confusion.groupBy(F.col("verdict").alias("label")).agg(F.sum("n").alias("claimed"))
    both = t.join(v, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("actual", "tp", "claimed")])
    p, r = F.coalesce(F.try_divide("tp", "claimed"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "actual"), F.lit(0.0))
    return both.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "actual", "tp")


def macro_f1(confusion: DataFrame) -> DataFrame:
    return class_scores(confusion).agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum("tp") / F.sum("actual"), 6).alias("accuracy"))


def class_coverage(rows: DataFrame) -> DataFrame:
    """Least number of distinct events over every split and class; a missing pair counts 0. Rows: split, cause, event_id."""
    grid = rows.select("split").distinct().crossJoin(F.broadcast(rows.select("cause").distinct()))
    counts = rows.groupBy("split", "cause").agg(F.countDistinct("event_id").alias("n"))
    return grid.join(counts, ["split", "cause"], "left").agg(F.min(F.coalesce("n", F.lit(0))).alias("coverage"))


def balanced_weights(rows: DataFrame) -> DataFrame:
    """Weight of every class: n / (k * n of the class)."""
    counts = rows.groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).select("cause", (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))


def predict(train: DataFrame, test: DataFrame, columns: list[str], trees: int = 30, depth: int = 6, seed: int = 42) -> DataFrame:
    """Forest on window features with balanced class weights; test rows with predicted and its probability.

    A substitute for gradient boosting on several classes, which Spark's library has for two only.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    weighed = train.join(F.broadcast(balanced_weights(train)), "cause")
    index = StringIndexer(inputCol="cause", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(weighed)
    stages = [VectorAssembler(inputCols=columns, outputCol="features"), RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight")]
    model = Pipeline(stages=stages).fit(index.transform(weighed))
    out = model.transform(test)
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels).transform(out)
    return named.withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("features", "rawPrediction", "probability", "prediction")


def fold(event_id, folds: int = 5):
    """Fold of an event, so that its windows stay together."""
    return F.pmod(F.hash(event_id), F.lit(folds))


#: Means from which a Poisson number is taken as a rounded normal one, and terms of its series below.
POISSON_NORMAL, POISSON_TERMS = 30, 90


def poisson(mean: Column, first: Column, second: Column) -> Column:
    """A Poisson number of ``mean`` from two uniform ones in (0, 1): by its series, or for large means by a normal one."""
    logs, total = [], 0.0
    for k in range(POISSON_TERMS):
        total += math.log(k) if k > 1 else 0.0
        logs.append(F.lit(total))
    chances = F.transform(F.array(*logs), lambda f, k: F.exp(k * F.log(mean) - mean - f))
    below = F.aggregate(chances, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + (a["sum"] + x < first).cast("int")).alias("n")), lambda a: a["n"])
    normal = F.sqrt(-2.0 * F.log(first)) * F.cos(2.0 * math.pi * second)
    return F.when(mean < POISSON_NORMAL, below.cast("long")).otherwise(F.greatest(F.lit(0), F.floor(mean + F.sqrt(mean) * normal + 0.5)).cast("long"))


def macro_f1_interval(votes: DataFrame, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Bootstrap percentile interval (2.5 and 97.5) of macro F1 over events (truth, predicted).

    A resampled event counts a Poisson number of times, so a cell of the confusion matrix counts a Poisson number of its size:
    a replicate is a few numbers, however many events there are. Draws are md5 of (seed, replicate, truth, predicted, 1 or 2).
    """
    cells = votes.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    rows = votes.sparkSession.range(replicates).select(F.col("id").alias("b")).crossJoin(F.broadcast(cells))

    def uniform(which: int) -> Column:
        key = F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), "truth", "predicted", F.lit(str(which)))
        return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0

    drawn = rows.select("b", "truth", "predicted", poisson(F.col("n").cast("double"), uniform(1), uniform(2)).alias("n")).where("n > 0")
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = drawn.select("b", F.explode(F.array(F.struct(F.col("truth").alias("c"), F.col("n").alias("t"), hit.alias("tp")), F.struct(F.col("predicted").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("b", "x.*")
    f1 = sides.groupBy("b", "c").agg((2.0 * F.sum("tp") / F.sum("t")).alias("f1")).groupBy("b").agg(F.avg("f1").alias("f1"))
    return f1.agg(F.round(F.percentile("f1", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("f1", F.lit(0.975)), 6).alias("high"))


def most_important(importances: DataFrame, most: int = 12) -> DataFrame:
    """The largest importances (name, importance); ties by name."""
    return importances.orderBy(F.desc("importance"), "name").limit(most)


def split_search(events: DataFrame, seeds: int = 40, train: float = 0.6, validation: float = 0.15, enough: int = 5) -> DataFrame:
    """Class coverage of held-out splits by seed, all seeds in one plan; rows: series_id, event_id, cause.

    Series go to splits in the order of md5(seed:series). The chosen seed is the first that covers ``enough`` events of
    every class in every split, else the first of those that cover the most. Returns seed, coverage, chosen.
    """
    names = events.select("series_id").distinct().crossJoin(F.broadcast(events.sparkSession.range(seeds).select(F.col("id").cast("int").alias("seed"))))
    order = Window.partitionBy("seed").orderBy(F.md5(F.concat_ws(":", F.col("seed").cast("string"), "series_id")), "series_id")
    ranked = names.select("seed", "series_id", F.row_number().over(order).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("seed")).alias("n"))
    part = F.when(F.col("k") <= F.floor(F.col("n") * train), "train").when(F.col("k") <= F.floor(F.col("n") * (train + validation)), "validation").otherwise("test")
    counts = ranked.withColumn("split", part).join(events, "series_id").groupBy("seed", "split", "cause").agg(F.countDistinct("event_id").alias("n"))
    # a pair that is missing covers nothing: fewer pairs than splits times classes mean 0
    pairs = events.agg((F.countDistinct("cause") * 3).alias("pairs"))
    covered = counts.groupBy("seed").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("have")).crossJoin(F.broadcast(pairs))
    rows = covered.select("seed", F.when(F.col("have") == F.col("pairs"), F.col("least")).otherwise(0).cast("long").alias("coverage"))
    best = rows.agg(F.max_by("seed", F.struct(F.least("coverage", F.lit(enough)), -F.col("seed"))).alias("__best"))
    return rows.crossJoin(F.broadcast(best)).select("seed", "coverage", (F.col("seed") == F.col("__best")).alias("chosen"))
