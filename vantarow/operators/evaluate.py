"""Evaluation at incident level: outcomes, pages, thresholds, curves, areas and intervals.

Scores are (series_id, start, score) joined with the window index; nothing depends on row position but the
order (series_id, start), which is explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantarow.operators.intervals import last_before, overlaps
from vantarow.operators.ranks import order_statistics, sums_before
from vantarow.operators.series import Geometry


def scored_windows(index: DataFrame, scores: DataFrame) -> DataFrame:
    return index.join(scores, ["series_id", "start"])


def _met(windows: DataFrame, incidents: DataFrame, g: Geometry) -> DataFrame:
    """Incidents (event_id, e_start) with every window that overlaps them (start, score)."""
    events = incidents.select("series_id", "event_id", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    spans = windows.select("series_id", "start", (F.col("start") + g.window).alias("end"), "score")
    return overlaps(spans, events, "series_id", 4 * g.window)


def event_outcomes(windows: DataFrame, incidents: DataFrame, threshold: float | Column, g: Geometry = Geometry()) -> DataFrame:
    """Per incident: detected, minutes to the end of the first firing window, and whether an alarm stood before it."""
    first = _met(windows, incidents, g).where(F.col("score") >= threshold).groupBy("event_id").agg(F.min(F.col("start") + g.window).alias("first_end"))
    events = incidents.select(F.col("event_id").alias("__id"), "series_id", F.col("start").alias("e_start"), (F.col("start") - g.window).alias("limit"))
    normal = windows.where("label = 0").select("series_id", "start", (F.col("score") >= threshold).alias("fires"))
    stood = last_before(events, normal, "series_id", 4 * g.window, "start", "fires", "limit", "pre")
    rows = stood.withColumnRenamed("__id", "event_id").join(first, "event_id", "left")
    found = F.col("first_end").isNotNull()
    return rows.select("event_id", "series_id", found.alias("detected"), F.when(found, F.greatest(F.lit(0), F.col("first_end") - F.col("e_start"))).cast("int").alias("minutes"), F.coalesce("pre", F.lit(False)).alias("pre_alarmed"))


def event_peaks(windows: DataFrame, incidents: DataFrame, g: Geometry = Geometry()) -> DataFrame:
    """Largest score of the windows that overlap an incident; -inf where none does."""
    peaks = _met(windows, incidents, g).groupBy("event_id").agg(F.max("score").alias("peak"))
    return incidents.select("event_id").join(peaks, "event_id", "left").select("event_id", F.coalesce("peak", F.lit(float("-inf"))).alias("peak"))


def _ordered(windows: DataFrame) -> DataFrame:
    """Windows with their number inside the series. Series breaks end runs anyway, so no global order is needed."""
    return windows.withColumn("row", F.row_number().over(Window.partitionBy("series_id").orderBy("start")))


def alarm_episodes(windows: DataFrame, thresholds: DataFrame, g: Geometry = Geometry()) -> DataFrame:
    """Runs of firing normal windows per threshold: one row per run with its pages (a standing alarm pages again)."""
    firing = _ordered(windows).where("label = 0").join(F.broadcast(thresholds), F.col("score") >= F.col("threshold"))
    island = F.col("row") - F.row_number().over(Window.partitionBy("threshold", "series_id").orderBy("start"))
    found = firing.withColumn("island", island).groupBy("threshold", "series_id", "island").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    pages = F.greatest(F.lit(1), F.ceil((F.col("last") - F.col("first") + g.stride) / F.lit(float(g.repage)))).cast("long")
    return found.select("threshold", "series_id", "first", "last", pages.alias("pages"))


def normal_days(points: DataFrame, g: Geometry = Geometry()) -> Column | DataFrame:
    """One row: days of normal steps over all series, at least 1e-9."""
    return points.agg(F.greatest(F.sum((F.col("point_label") == 0).cast("long")) / F.lit(float(g.day)), F.lit(1e-9)).alias("days"))


def threshold_candidates(scores: DataFrame, n: int = 200, top: float = 100.0) -> DataFrame:
    """Distinct percentiles of the scores, evenly from 50 to ``top``."""
    shares = [(50.0 + (top - 50.0) * i / (n - 1)) / 100.0 for i in range(n)]
    return order_statistics(scores, "score", shares).select(F.round("value", 9).alias("threshold")).distinct()


def pages_per_threshold(windows: DataFrame, thresholds: DataFrame, points: DataFrame, g: Geometry = Geometry()) -> DataFrame:
    """Pages and episodes a day of every threshold, those with none too."""
    counted = alarm_episodes(windows, thresholds, g).groupBy("threshold").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("episodes"))
    rows = thresholds.join(counted, "threshold", "left").crossJoin(F.broadcast(normal_days(points, g)))
    return rows.select("threshold", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("episodes", F.lit(0)).alias("episodes"), (F.coalesce("pages", F.lit(0)) / F.col("days")).alias("pages_per_day"))


def threshold_at_budget(windows: DataFrame, points: DataFrame, budget: float = 1.0, g: Geometry = Geometry(), n: int = 200) -> DataFrame:
    """The lowest threshold that the budget affords; if none, the highest candidate. One row."""
    rates = pages_per_threshold(windows, threshold_candidates(windows, n), points, g)
    return rates.agg(F.coalesce(F.min(F.when(F.col("pages_per_day") <= budget, F.col("threshold"))), F.max("threshold"), F.lit(float("inf"))).alias("threshold"))


def detection_curve(windows: DataFrame, incidents: DataFrame, points: DataFrame, g: Geometry = Geometry(), n: int = 100) -> DataFrame:
    """Pages a day and share of incidents detected, for each candidate threshold (an incident is, if its peak fires)."""
    candidates = threshold_candidates(windows, n)
    peaks = event_peaks(windows, incidents, g)
    hits = candidates.crossJoin(F.broadcast(peaks)).groupBy("threshold").agg(F.avg((F.col("peak") >= F.col("threshold")).cast("double")).alias("detection_rate"))
    return pages_per_threshold(windows, candidates, points, g).join(hits, "threshold", "left").select("threshold", "pages_per_day", F.coalesce("detection_rate", F.lit(0.0)).alias("detection_rate"))


def curve_auc(curve: DataFrame, low: float = 0.5, high: float = 4.0, n: int = 36) -> DataFrame:
    """Mean over budgets of the best detection that each affords; 0 where none does."""
    budgets = F.array(*[F.lit(round(low + (high - low) * i / (n - 1), 9)) for i in range(n)])
    best = curve.sparkSession.range(1).select(F.explode(budgets).alias("budget")).join(F.broadcast(curve), F.col("pages_per_day") <= F.col("budget"), "left")
    return best.groupBy("budget").agg(F.coalesce(F.max("detection_rate"), F.lit(0.0)).alias("best")).agg(F.avg("best").alias("curve_auc"))


def alarm_duty(windows: DataFrame, threshold: float | Column) -> DataFrame:
    """Share of normal windows that fire, overall and of the worst series."""
    by_series = windows.where("label = 0").groupBy("series_id").agg(F.sum((F.col("score") >= threshold).cast("long")).alias("firing"), F.count(F.lit(1)).alias("n"))
    return by_series.agg(F.try_divide(F.sum("firing").cast("double"), F.sum("n")).alias("duty"), F.max(F.col("firing") / F.col("n")).alias("worst_duty"))


def window_prf(windows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Precision, recall and F1 of windows at every threshold; 0 where undefined.

    A window counts once, at the highest threshold that it reaches; sums from above make the rest. Thresholds are few: they
    go to the tasks as one sorted array.
    """
    marks = F.broadcast(thresholds.agg(F.array_sort(F.collect_set("threshold")).alias("marks")))
    reached = F.aggregate("marks", F.lit(0), lambda n, x: n + (F.col("score") >= x).cast("int"))
    counts = windows.crossJoin(marks).groupBy(reached.alias("k")).agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    places = thresholds.agg(F.array_sort(F.collect_set("threshold")).alias("marks")).select(F.posexplode("marks").alias("i", "threshold"))
    above = places.join(F.broadcast(counts), F.col("k") > F.col("i"), "left").groupBy("threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("fired"))
    rows = above.crossJoin(F.broadcast(windows.agg(F.sum("label").alias("positives"), F.count(F.lit(1)).alias("__n")))).where("__n > 0")
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("fired")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("positives")), F.lit(0.0))
    return rows.select("threshold", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def best_f1_threshold(windows: DataFrame, n: int = 200) -> DataFrame:
    """The candidate, up to the 99.9th percentile, of the largest F1; of equals the lowest."""
    prf = window_prf(windows, threshold_candidates(windows, n, 99.9)).withColumn("f1", F.round("f1", 9))
    return prf.agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def _by_score(rows: DataFrame) -> DataFrame:
    """Counts by distinct score, so that ties are one step and later frames hold scores, not rows."""
    return rows.groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum((1 - F.col("label")).cast("long")).alias("neg"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Area under ROC with ties counted half (Mann-Whitney); null without both classes. Rows: score, label."""
    steps = sums_before(_by_score(rows), ["score"], ("neg",), "roc").select("pos", "neg", (F.col("pos") * F.col("neg_before") + F.col("pos") * F.col("neg") / 2).alias("u"))
    return steps.agg(F.try_divide(F.sum("u"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Step-wise average precision; null without positives or negatives."""
    placed = sums_before(_by_score(rows), [F.col("score").desc()], ("pos", "neg"), "precision")
    tp, seen = F.col("pos_before") + F.col("pos"), F.col("pos_before") + F.col("pos") + F.col("neg_before") + F.col("neg")
    total = placed.agg(F.sum(F.col("pos") * tp / seen).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select(F.when(F.col("n") > 0, F.try_divide("area", F.col("p").cast("double"))).alias("average_precision"))


def draw(seed: Column, n: Column) -> Column:
    """A number in [0, n) from the md5 of a key: the same on every engine."""
    return F.pmod(F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("long"), n)


def bootstrap(values: DataFrame, replicates: int = 2000, seed: int = 42, statistic=F.avg) -> DataFrame:
    """95 % percentile interval of a statistic. ``values``: key (orderable), value: a few hundred incidents.

    Every draw is the md5 of seed, replicate and place; draws are joined to ranked values, nothing is collected.
    """
    ranked = values.select((F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("i"), "value")
    size = ranked.agg(F.count(F.lit(1)).alias("n"))
    draws = values.sparkSession.range(replicates).withColumnRenamed("id", "b").crossJoin(F.broadcast(size)).where("n > 0")
    draws = draws.select("b", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    picked = draws.select("b", draw(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("k").cast("string")), F.col("n")).alias("i"))
    stats = picked.join(F.broadcast(ranked), "i").groupBy("b").agg(statistic("value").alias("s"))
    q = stats.agg(F.percentile("s", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return values.agg(statistic("value").alias("estimate")).crossJoin(q).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def paired_delta(candidate: DataFrame, incumbent: DataFrame, **settings) -> DataFrame:
    """Interval of the difference in detection over the same incidents; other ids on either side are an error."""
    a = candidate.select(F.col("event_id").alias("key"), F.col("detected").cast("double").alias("a"))
    b = incumbent.select(F.col("event_id").alias("key"), F.col("detected").cast("double").alias("b"))
    both = a.join(b, "key", "full")
    checked = both.select("key", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("the incidents differ"))).otherwise(F.col("a") - F.col("b")).cast("double").alias("value"))
    return bootstrap(checked, **settings)


def detection_report(windows: DataFrame, incidents: DataFrame, points: DataFrame, threshold: DataFrame, g: Geometry = Geometry()) -> DataFrame:
    """One row of figures at one threshold (a one-row frame)."""
    held = windows.crossJoin(F.broadcast(threshold))
    outcomes = event_outcomes(held.withColumn("score", (F.col("score") >= F.col("threshold")).cast("double")), incidents, 1.0, g)
    events = outcomes.agg(
        F.count(F.lit(1)).alias("events"), F.avg(F.col("detected").cast("double")).alias("detection_rate"), F.percentile(F.when(F.col("detected"), F.col("minutes")), F.lit(0.5)).alias("median_minutes"),
        F.avg((F.col("detected") & ~F.col("pre_alarmed")).cast("double")).alias("fresh_rate"), F.avg(F.when(F.col("detected"), F.col("pre_alarmed").cast("double"))).alias("pre_alarmed_share"),
    )
    pages = pages_per_threshold(windows, threshold, points, g).select("threshold", "episodes", "pages", "pages_per_day")
    duty = alarm_duty(held, F.col("threshold"))
    prf = window_prf(windows, threshold).select("precision", "recall", "f1")
    rows = events
    for part in (pages, duty, prf, roc_auc(windows), average_precision(windows), curve_auc(detection_curve(windows, incidents, points, g))):
        rows = rows.crossJoin(F.broadcast(part))
    return rows


def standing_alarms(reports: DataFrame) -> DataFrame:
    """Detectors whose detections owe much to alarms that were up before."""
    return reports.where("detection_rate > 0 and (coalesce(pre_alarmed_share, 0) >= 0.2 or worst_duty >= 0.5)")


def chosen_detector(reports: DataFrame) -> DataFrame:
    """The detector of the largest curve area, then the smallest median delay; a null delay last."""
    return reports.agg(F.max_by("detector", F.struct(F.round("curve_auc", 9), -F.coalesce("median_minutes", F.lit(1e9)), F.col("detector"))).alias("detector"))


def seed_spread(reports: DataFrame) -> DataFrame:
    """Mean and sample deviation of the curve area by family (a name without its [s<n>]), for two runs or more."""
    family = reports.withColumn("family", F.regexp_replace("detector", r"\[s\d+\]", ""))
    return family.groupBy("family").agg(F.count(F.lit(1)).alias("runs"), F.avg("curve_auc").alias("mean_auc"), F.stddev_samp("curve_auc").alias("std_auc"), (F.max("curve_auc") - F.min("curve_auc")).alias("spread")).where("runs > 1")


def patience(errors: DataFrame) -> DataFrame:
    """Of every epoch of a run (run, epoch, error): the best error so far, and how many epochs ago it was reached first."""
    order = Window.partitionBy("run").orderBy("epoch")
    before = F.min("error").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = errors.withColumn("__better", F.when(before.isNull() | (F.col("error") < before), F.col("epoch")))
    return rows.select("run", "epoch", F.min("error").over(order).alias("best"), (F.col("epoch") - F.max("__better").over(order)).alias("waited"))


def selection_criterion(windows: DataFrame) -> DataFrame:
    """What a model can be chosen by: mean score over all windows, over normal ones, and average precision."""
    means = windows.agg(F.avg("score").alias("over_all"), F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("over_normal"))
    return means.crossJoin(average_precision(windows))


def against(report: DataFrame, incumbent: str) -> DataFrame:
    """Every detector's area beside the incumbent's, best first."""
    one = F.broadcast(report.where(F.col("detector") == incumbent).select(F.col("curve_auc").alias("__theirs")))
    return report.crossJoin(one).select("detector", "curve_auc", F.round(F.col("curve_auc") - F.col("__theirs"), 6).alias("delta")).orderBy(F.desc("curve_auc"), "detector")
