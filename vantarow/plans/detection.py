"""Queries on telemetry: series, windows, detectors, evaluation. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantarow.operators import classify, compare, detectors, evaluate, series, windows
from vantarow.operators.series import Geometry
from vantarow.plans.registry import Registry
from vantarow.sinks import store
from vantarow.sources.telemetry import METRICS, metric_points, synthetic_metrics, table

REGISTRY = Registry()
query = REGISTRY.query
#: Geometry of the hourly grid that the events give.
G = Geometry(window=12, stride=2, day=24, repage=6)


def settled(df: DataFrame, name: str) -> DataFrame:
    """A table that several branches of a plan read is written once, not computed in each."""
    path = store.workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def points(spark: SparkSession, d: str) -> DataFrame:
    return settled(metric_points(table(spark, d, "events")), "points")


def incidents_of(p: DataFrame) -> DataFrame:
    return series.label_runs(p)


def train_stats(p: DataFrame) -> DataFrame:
    """The scaler sees every step of the train split, incidents too."""
    return series.fit_scaler(series.split_time_based(p).where("split = 'train'"))


def scaled(p: DataFrame) -> DataFrame:
    return series.transform(p, train_stats(p))


def spread_windows(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incidents, and windows with labels and rounded window_spread scores."""
    found = settled(incidents_of(p), "incidents")
    scores = detectors.window_spread(scaled(p), G).withColumn("score", F.round("score", 9))
    return found, settled(evaluate.scored_windows(windows.window_index(p, found, G), scores), "windows")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_METRIC_SQL = "n_events, mean_value, max_value, error_rate"
BASE = """
timed AS (SELECT 'svc-' || lpad(CAST(user_id % 8 AS VARCHAR), 2, '0') AS series_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000) AS INT) AS h, value, event_type FROM events),
hz AS (SELECT min(h) AS lo, max(h) - min(h) + 1 AS hours FROM timed),
raw AS (SELECT series_id, h - lo AS t, value, event_type FROM timed, hz),
by_hour AS (SELECT series_id, t, count(*) AS n_events, avg(value) AS mean_value, max(value) AS max_value, avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS error_rate FROM raw GROUP BY ALL),
grid AS (SELECT 'svc-' || lpad(CAST(s AS VARCHAR), 2, '0') AS series_id, CAST(h AS INT) AS t FROM (SELECT s, unnest(range(hours)) AS h FROM range(8) a(s), hz)),
dense AS (SELECT g.series_id, g.t, coalesce(n_events, 0)::DOUBLE AS n_events, coalesce(mean_value, 0) AS mean_value, coalesce(max_value, 0) AS max_value, coalesce(error_rate, 0) AS error_rate FROM grid g LEFT JOIN by_hour USING (series_id, t)),
mp AS (SELECT *, CASE WHEN max_value >= (SELECT quantile_cont(max_value, 0.99) FROM dense) THEN 1 ELSE 0 END AS point_label FROM dense),
islands AS (SELECT series_id, t, t - row_number() OVER (PARTITION BY series_id ORDER BY t) AS island FROM mp WHERE point_label = 1),
spans AS (SELECT series_id, min(t) AS start, max(t) + 1 AS "end" FROM islands GROUP BY series_id, island),
inc AS (SELECT CAST(row_number() OVER (ORDER BY series_id, start) - 1 AS INT) AS event_id, series_id, start, "end" FROM spans),
targets AS (SELECT s.series_id, n.name, CAST(floor(hours * n.fraction) AS INT) AS target FROM hz, (SELECT DISTINCT series_id FROM mp) s, (VALUES ('a', 0.7::DOUBLE), ('b', (0.7::DOUBLE + 0.15::DOUBLE))) n(name, fraction)),
cut_rows AS (SELECT series_id, name, target, t, row_number() OVER (PARTITION BY series_id, name ORDER BY abs(t - target), t) AS k FROM targets JOIN mp USING (series_id) WHERE point_label = 0),
cuts AS (SELECT series_id, max(CASE WHEN name = 'a' THEN t END) AS a, max(CASE WHEN name = 'b' THEN t END) AS b FROM cut_rows WHERE k = 1 GROUP BY series_id),
sp AS (SELECT mp.series_id, CASE WHEN t < a THEN 'train' WHEN t < b THEN 'validation' ELSE 'test' END AS split, CASE WHEN t < a THEN t WHEN t < b THEN t - a ELSE t - b END AS t, t AS original_t, n_events, mean_value, max_value, error_rate, point_label FROM mp JOIN cuts USING (series_id)),
long_sp AS (SELECT split, u.i AS position, u.metric, u.v FROM sp, LATERAL (SELECT unnest([0, 1, 2, 3]) AS i, unnest(['n_events', 'mean_value', 'max_value', 'error_rate']) AS metric, unnest([n_events, mean_value, max_value, error_rate]) AS v) u),
st AS (SELECT position, metric, avg(v) AS mean, CASE WHEN stddev_pop(v) < 1e-8 THEN 1.0 ELSE stddev_pop(v) END AS std FROM long_sp WHERE split = 'train' GROUP BY position, metric),
wide AS (SELECT max(CASE WHEN position = 0 THEN mean END) AS m0, max(CASE WHEN position = 0 THEN std END) AS s0, max(CASE WHEN position = 1 THEN mean END) AS m1, max(CASE WHEN position = 1 THEN std END) AS s1,
  max(CASE WHEN position = 2 THEN mean END) AS m2, max(CASE WHEN position = 2 THEN std END) AS s2, max(CASE WHEN position = 3 THEN mean END) AS m3, max(CASE WHEN position = 3 THEN std END) AS s3 FROM st),
z AS (SELECT series_id, t, point_label, (n_events - m0) / s0 AS z0, (mean_value - m1) / s1 AS z1, (max_value - m2) / s2 AS z2, (error_rate - m3) / s3 AS z3 FROM mp, wide),
starts AS (SELECT series_id, CAST(unnest(range(0, hours - 11, 2)) AS INT) AS start FROM (SELECT DISTINCT series_id FROM mp), hz),
owners AS (SELECT s.series_id, s.start, i.event_id, row_number() OVER (PARTITION BY s.series_id, s.start ORDER BY least(i."end", s.start + 12) - greatest(i.start, s.start) DESC, i.event_id) AS k FROM starts s LEFT JOIN inc i ON i.series_id = s.series_id AND s.start < i."end" AND s.start + 12 > i.start),
idx AS (SELECT series_id, start, CASE WHEN event_id IS NULL THEN 0 ELSE 1 END AS label, coalesce(event_id, -1) AS event_id FROM owners WHERE k = 1),
wz AS (SELECT s.series_id, s.start, z.t, z.z0, z.z1, z.z2, z.z3 FROM starts s JOIN z ON z.series_id = s.series_id AND z.t >= s.start AND z.t < s.start + 12),
spread AS (SELECT series_id, start, round(greatest(stddev_pop(z0), stddev_pop(z1), stddev_pop(z2), stddev_pop(z3)), 9) AS score FROM wz GROUP BY series_id, start),
sw AS (SELECT * FROM idx JOIN spread USING (series_id, start)),
days AS (SELECT greatest(sum(CASE WHEN point_label = 0 THEN 1 ELSE 0 END) / 24.0, 1e-9) AS days FROM mp)
"""


def with_base(body: str, more: str = "") -> str:
    return f"WITH {BASE.strip()}{', ' + more if more else ''} {body}"


query("metric_points_dense_grid", with_base(f"SELECT series_id, t, n_events, round(mean_value, 6) AS mean_value, max_value, round(error_rate, 6) AS error_rate, point_label FROM mp"))(lambda s, d: points(s, d).withColumns({"mean_value": F.round("mean_value", 6), "error_rate": F.round("error_rate", 6)}))
query("label_runs", with_base('SELECT event_id, series_id, start, "end" FROM inc'))(lambda s, d: incidents_of(points(s, d)))
query("event_track", with_base('SELECT mp.series_id, mp.t, coalesce(max(i.event_id), -1) AS event_id FROM mp LEFT JOIN inc i ON i.series_id = mp.series_id AND mp.t >= i.start AND mp.t < i."end" GROUP BY mp.series_id, mp.t'))(
    lambda s, d: (lambda p: series.event_track(p, incidents_of(p)))(points(s, d))
)
_SPANS = """zl AS (SELECT series_id, t, unnest([1, 2, 3, 4]) AS dim, unnest([z0, z1, z2, z3]) AS z FROM z),
zi AS (SELECT series_id, dim, t, t - row_number() OVER (PARTITION BY series_id, dim ORDER BY t) AS island FROM zl WHERE z > 3),
an AS (SELECT series_id, dim, min(t) AS start, max(t) + 1 AS "end" FROM zi GROUP BY series_id, dim, island),
dims AS (SELECT i.event_id, i.series_id, i.start, i."end", list_sort(list(DISTINCT an.dim) FILTER (an.dim IS NOT NULL)) AS dims FROM inc i LEFT JOIN an ON an.series_id = i.series_id AND i.start < an."end" AND an.start < i."end" GROUP BY ALL)"""


def with_dims(p: DataFrame) -> DataFrame:
    return series.attach_dims(incidents_of(p), series.annotation_spans(p, train_stats(p)))


query("annotation_spans", with_base('SELECT series_id, dim, start, "end" FROM an', _SPANS))(lambda s, d: (lambda p: series.annotation_spans(p, train_stats(p)))(points(s, d)))
query("attach_dims_overlap", with_base("""SELECT event_id, series_id, start, "end", array_to_string(dims, ',') AS dims FROM (SELECT * REPLACE (coalesce(dims, []) AS dims) FROM dims)""", _SPANS))(
    lambda s, d: with_dims(points(s, d)).withColumn("dims", F.array_join(F.transform("dims", lambda x: x.cast("string")), ","))
)
query("scaler_fit", with_base("SELECT position, metric, round(mean, 6) AS mean, round(std, 6) AS std FROM st"))(lambda s, d: rounded(train_stats(points(s, d))))
query("scaler_transform", with_base("SELECT series_id, t, point_label, round(z0, 6) AS n_events, round(z1, 6) AS mean_value, round(z2, 6) AS max_value, round(z3, 6) AS error_rate FROM z"))(lambda s, d: rounded(scaled(points(s, d))))
query("scaler_inverse", with_base("SELECT series_id, t, round(n_events, 6) + 0.0 AS n_events, round(max_value, 6) + 0.0 AS max_value FROM mp"))(
    lambda s, d: (lambda p: series.inverse_transform(scaled(p), train_stats(p)).select("series_id", "t", (F.round("n_events", 6) + 0.0).alias("n_events"), (F.round("max_value", 6) + 0.0).alias("max_value")))(points(s, d))
)
query("window_index", with_base("SELECT series_id, count(*) AS windows, min(start) AS first, max(start) AS last, sum(label) AS anomalous FROM idx GROUP BY series_id"))(
    lambda s, d: (lambda p: windows.window_index(p, incidents_of(p), G))(points(s, d)).groupBy("series_id").agg(F.count(F.lit(1)).alias("windows"), F.min("start").alias("first"), F.max("start").alias("last"), F.sum("label").alias("anomalous"))
)
query("window_label_majority", with_base("SELECT * FROM idx"))(lambda s, d: (lambda p: windows.window_index(p, incidents_of(p), G))(points(s, d)))
_WP = "wp AS (SELECT s.series_id, s.start, p.t, p.n_events, p.mean_value, p.max_value, p.error_rate FROM starts s JOIN mp p ON p.series_id = s.series_id AND p.t >= s.start AND p.t < s.start + 12)"
query(
    "window_summary_stats",
    with_base("SELECT series_id, start, " + ", ".join(f"round({f}({m}), 6) AS {m}_{k}" for m in METRICS for k, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM wp GROUP BY series_id, start", _WP),
)(lambda s, d: rounded(windows.summary_stats(points(s, d), G)))
_FEATURES = ", ".join(
    f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std, round(min({m}), 6) AS {m}_min, round(max({m}), 6) AS {m}_max, round(regr_slope({m}, t::DOUBLE), 6) AS {m}_slope, round(avg({m}) FILTER (t >= start + 6) - avg({m}) FILTER (t < start + 6), 6) AS {m}_half_diff"
    for m in METRICS
)
query("window_features", with_base(f"SELECT series_id, start, {_FEATURES} FROM wp GROUP BY series_id, start", _WP))(lambda s, d: rounded(windows.features(points(s, d), G)))

_DETECT = {
    "max_deviation": "SELECT series_id, start, round(max(greatest(abs(z0), abs(z1), abs(z2), abs(z3))), 9) AS score FROM wz GROUP BY series_id, start",
    "window_spread": "SELECT series_id, start, score FROM spread",
    "naive_residual": "SELECT series_id, start, round(max(greatest(abs(z0 - p0), abs(z1 - p1), abs(z2 - p2), abs(z3 - p3))), 9) AS score FROM (SELECT *, lag(z0) OVER w AS p0, lag(z1) OVER w AS p1, lag(z2) OVER w AS p2, lag(z3) OVER w AS p3 FROM wz WINDOW w AS (PARTITION BY series_id, start ORDER BY t)) GROUP BY series_id, start",
    "ewma_residual": "SELECT series_id, start, round(max(greatest("
    + ", ".join(f"abs(z{i} - s{i})" for i in range(4))
    + ")), 9) AS score FROM (SELECT a.series_id, a.start, a.t, "
    + ", ".join(f"any_value(a.z{i}) AS z{i}, sum(b.z{i} * (CASE WHEN b.t = b.start THEN pow(0.7, a.t - b.t) ELSE 0.3 * pow(0.7, a.t - b.t) END)) AS s{i}" for i in range(4))
    + " FROM wz a JOIN wz b ON a.series_id = b.series_id AND a.start = b.start AND b.t <= a.t GROUP BY a.series_id, a.start, a.t) GROUP BY series_id, start",
}
for _name, _sql in _DETECT.items():
    query(f"detect_{_name}", with_base(f"SELECT series_id, start, round(score, 6) AS score FROM ({_sql})"))(lambda s, d, f=detectors.STATISTICS[_name]: rounded(f(scaled(points(s, d)), G).withColumn("score", F.round("score", 9))))
_TWO = ", ".join(f"d_{k} AS ({_DETECT[k]})" for k in ("max_deviation", "naive_residual")) + (
    ", sc AS (SELECT 'max_deviation' AS detector, * FROM d_max_deviation UNION ALL SELECT 'naive_residual', * FROM d_naive_residual UNION ALL SELECT 'window_spread', * FROM spread)"
    ", scale AS (SELECT detector, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM sc JOIN idx USING (series_id, start) JOIN cuts USING (series_id) WHERE label = 0 AND start + 12 <= a GROUP BY detector)"
)


def three_scores(p: DataFrame) -> DataFrame:
    return detectors.all_scores(scaled(p), G, {k: detectors.STATISTICS[k] for k in ("max_deviation", "naive_residual", "window_spread")})


def normal_training_scores(p: DataFrame, scores: DataFrame) -> DataFrame:
    cut = series.cut_points(p, {"a": 0.7}).select("series_id", "cut")
    normal = windows.window_index(p, incidents_of(p), G).where("label = 0").join(F.broadcast(cut), "series_id").where(F.col("start") + G.window <= F.col("cut")).select("series_id", "start")
    return scores.join(normal, ["series_id", "start"], "left_semi")


query("fusion_scale", with_base("SELECT detector, round(median, 6) AS median, round(iqr, 6) AS iqr FROM scale", _TWO))(lambda s, d: (lambda p: rounded(detectors.fusion_scale(normal_training_scores(p, three_scores(p)))))(points(s, d)))
query("fusion_score", with_base("SELECT series_id, start, round(max((score - median) / greatest(iqr, 1e-9)), 6) AS score FROM sc JOIN scale USING (detector) GROUP BY series_id, start", _TWO))(
    lambda s, d: (lambda p: (lambda sc: rounded(detectors.max_fusion(sc, detectors.fusion_scale(normal_training_scores(p, sc)))))(three_scores(p)))(points(s, d))
)


def normal_points(p: DataFrame) -> DataFrame:
    """What the train split holds: steps before each series' first cut."""
    cut = series.cut_points(p, {"a": 0.7}).select("series_id", "cut")
    return scaled(p).join(F.broadcast(cut), "series_id").where("t < cut").drop("cut")


query("detect_isolation_forest")(lambda s, d: (lambda p: rounded(detectors.isolation_forest(normal_points(p), scaled(p), G)))(points(s, d)))
query("pca_holdout")(lambda s, d: (lambda p: rounded(detectors.pca_holdout(normal_points(p), G)))(points(s, d)))
query("detect_pca_residual")(lambda s, d: (lambda p: rounded(detectors.pca_residual(normal_points(p), scaled(p), G)))(points(s, d)))

_THR = "thr AS (SELECT round(quantile_cont(score, 0.9), 9) AS threshold FROM sw)"


def fixed_threshold(sw: DataFrame) -> DataFrame:
    """The 90th percentile of all scores: a threshold for queries that need one."""
    return sw.agg(F.round(F.percentile("score", F.lit(0.9)), 9).alias("threshold"))


def outcomes_of(p: DataFrame) -> DataFrame:
    inc, sw = spread_windows(p)
    held = sw.crossJoin(F.broadcast(fixed_threshold(sw))).withColumn("score", (F.col("score") >= F.col("threshold")).cast("double")).drop("threshold")
    return evaluate.event_outcomes(held, inc, 1.0, G)


_OUT = (
    _THR
    + """, over_w AS (SELECT i.event_id, max(CASE WHEN score >= threshold THEN 1 ELSE 0 END) AS hit, min(CASE WHEN score >= threshold THEN w.start + 12 END) - any_value(i.start) AS minutes FROM inc i JOIN sw w ON w.series_id = i.series_id AND w.start < i."end" AND w.start + 12 > i.start, thr GROUP BY i.event_id),
pre_w AS (SELECT i.event_id, arg_max(score >= threshold, w.start) AS pre FROM inc i JOIN sw w ON w.series_id = i.series_id AND w.start + 12 <= i.start AND w.label = 0, thr GROUP BY i.event_id),
outc AS (SELECT i.event_id, i.series_id, coalesce(hit, 0) = 1 AS detected, CASE WHEN hit = 1 THEN greatest(0, minutes) END AS minutes, coalesce(pre, false) AS pre_alarmed FROM inc i LEFT JOIN over_w USING (event_id) LEFT JOIN pre_w USING (event_id))"""
)
query("event_outcomes", with_base("SELECT * FROM outc", _OUT))(lambda s, d: outcomes_of(points(s, d)))
_PEAKS = """peaks AS (SELECT i.event_id, coalesce(max(score), '-infinity'::DOUBLE) AS peak FROM inc i LEFT JOIN sw w ON w.series_id = i.series_id AND w.start < i."end" AND w.start + 12 > i.start GROUP BY i.event_id)"""
query("event_peaks", with_base("SELECT event_id, round(peak, 6) AS peak FROM peaks", _PEAKS))(lambda s, d: (lambda p: (lambda x: rounded(evaluate.event_peaks(x[1], x[0], G)))(spread_windows(p)))(points(s, d)))
_EPISODES = """numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start) AS rn FROM sw),
firing AS (SELECT n.*, c.threshold, rn - row_number() OVER (PARTITION BY c.threshold, series_id ORDER BY start) AS island FROM numbered n JOIN cand c ON n.score >= c.threshold WHERE label = 0),
ep AS (SELECT threshold, series_id, min(start) AS first, max(start) AS last, greatest(1, CAST(ceil((max(start) - min(start) + 2) / 6.0) AS BIGINT)) AS pages FROM firing GROUP BY threshold, series_id, island)"""


def _candidates(n: int, top: float = 100.0, name: str = "cand") -> str:
    marks = ", ".join(repr((50.0 + (top - 50.0) * i / (n - 1)) / 100.0) for i in range(n))
    return f"{name} AS (SELECT DISTINCT round(unnest(quantile_cont(score, [{marks}])), 9) AS threshold FROM sw)"


_ONE = f"{_THR}, cand AS (SELECT threshold FROM thr), {_EPISODES}"
query("false_alarm_episodes", with_base("SELECT series_id, first, last FROM ep", _ONE))(lambda s, d: (lambda p: (lambda x: evaluate.alarm_episodes(x[1], fixed_threshold(x[1]), G).select("series_id", "first", "last"))(spread_windows(p)))(points(s, d)))
query("paged_alarms", with_base("SELECT series_id, sum(pages)::BIGINT AS pages, count(*) AS episodes FROM ep GROUP BY series_id", _ONE))(
    lambda s, d: (lambda p: (lambda x: evaluate.alarm_episodes(x[1], fixed_threshold(x[1]), G).groupBy("series_id").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("episodes")))(spread_windows(p)))(points(s, d))
)
_DUTY = "duty AS (SELECT sum(f) / sum(n) AS duty, max(f / n) AS worst_duty FROM (SELECT series_id, sum(CASE WHEN score >= threshold THEN 1.0 ELSE 0 END)::DOUBLE AS f, count(*)::DOUBLE AS n FROM sw, thr WHERE label = 0 GROUP BY series_id))"
query("alarm_duty", with_base("SELECT round(duty, 6) AS duty, round(worst_duty, 6) AS worst_duty FROM duty", f"{_THR}, {_DUTY}"))(
    lambda s, d: (lambda p: (lambda x: rounded(evaluate.alarm_duty(x[1].crossJoin(F.broadcast(fixed_threshold(x[1]))), F.col("threshold"))))(spread_windows(p)))(points(s, d))
)
query("threshold_candidates", with_base("SELECT round(threshold, 6) AS threshold FROM cand", _candidates(200)))(lambda s, d: (lambda p: rounded(evaluate.threshold_candidates(spread_windows(p)[1])))(points(s, d)))
_RATES = f"{_EPISODES}, counted AS (SELECT threshold, sum(pages) AS pages, count(*) AS episodes FROM ep GROUP BY threshold), rates AS (SELECT c.threshold, coalesce(pages, 0) AS pages, coalesce(episodes, 0) AS episodes, coalesce(pages, 0) / days AS pages_per_day FROM cand c LEFT JOIN counted USING (threshold), days)"
_PICK = "pick AS (SELECT coalesce(min(CASE WHEN pages_per_day <= 0.05 THEN threshold END), max(threshold)) AS threshold FROM rates)"
query("threshold_at_budget", with_base("SELECT round(threshold, 6) AS threshold FROM pick", f"{_candidates(200)}, {_RATES}, {_PICK}"))(lambda s, d: (lambda p: rounded(evaluate.threshold_at_budget(spread_windows(p)[1], p, 0.05, G)))(points(s, d)))
_CURVE = f"{_candidates(100)}, {_RATES}, {_PEAKS}, curve AS (SELECT r.threshold, r.pages_per_day, avg(CASE WHEN peak >= r.threshold THEN 1.0::DOUBLE ELSE 0 END) AS detection_rate FROM rates r, peaks GROUP BY r.threshold, r.pages_per_day)"
query("detection_curve", with_base("SELECT round(threshold, 6) AS threshold, round(pages_per_day, 6) AS pages_per_day, round(detection_rate, 6) AS detection_rate FROM curve", _CURVE))(
    lambda s, d: (lambda p: (lambda x: rounded(evaluate.detection_curve(x[1], x[0], p, G)))(spread_windows(p)))(points(s, d))
)
_AUC = "auc AS (SELECT avg(best) AS curve_auc FROM (SELECT b.budget, coalesce(max(detection_rate), 0) AS best FROM (SELECT round(0.5 + 3.5 * i / 35, 9) AS budget FROM range(36) r(i)) b LEFT JOIN curve c ON c.pages_per_day <= b.budget GROUP BY b.budget))"
query("curve_auc", with_base("SELECT round(curve_auc, 6) AS curve_auc FROM auc", f"{_CURVE}, {_AUC}"))(lambda s, d: (lambda p: (lambda x: rounded(evaluate.curve_auc(evaluate.detection_curve(x[1], x[0], p, G))))(spread_windows(p)))(points(s, d)))
_PRF = "prf AS (SELECT threshold, tp, fired, positives, coalesce(tp / nullif(fired, 0), 0) AS precision, coalesce(tp / nullif(positives, 0), 0) AS recall FROM (SELECT c.threshold, sum(CASE WHEN score >= c.threshold AND label = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN score >= c.threshold THEN 1.0 ELSE 0 END)::DOUBLE AS fired, sum(label)::DOUBLE AS positives FROM sw, cand c GROUP BY c.threshold)), f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM prf)"
query("window_prf", with_base("SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f", f"{_candidates(50)}, {_PRF}"))(
    lambda s, d: (lambda p: (lambda x: rounded(evaluate.window_prf(x[1], evaluate.threshold_candidates(x[1], 50))))(spread_windows(p)))(points(s, d))
)
query("best_f1_threshold", with_base("SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM (SELECT threshold, round(f1, 9) AS f1 FROM f) ORDER BY f1 DESC, threshold LIMIT 1", f"{_candidates(200, 99.9)}, {_PRF}"))(lambda s, d: (lambda p: rounded(evaluate.best_f1_threshold(spread_windows(p)[1])))(points(s, d)))
_ROC = "ranked AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM sw GROUP BY score), roc AS (SELECT sum(pos * below + pos * neg / 2.0) / (sum(pos) * sum(neg)) AS roc_auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ranked))"
_AP = "ap AS (SELECT sum(pos * tp / seen) / sum(pos) AS average_precision FROM (SELECT pos, sum(pos) OVER o AS tp, sum(pos + neg) OVER o AS seen FROM (SELECT score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM sw GROUP BY score) WINDOW o AS (ORDER BY score DESC)))"
query("roc_auc", with_base("SELECT round(roc_auc, 6) AS roc_auc FROM roc", _ROC))(lambda s, d: (lambda p: rounded(evaluate.roc_auc(spread_windows(p)[1])))(points(s, d)))
query("average_precision", with_base("SELECT round(average_precision, 6) AS average_precision FROM ap", _AP))(lambda s, d: (lambda p: rounded(evaluate.average_precision(spread_windows(p)[1])))(points(s, d)))
query(
    "detection_report",
    with_base(
        "SELECT e.*, round(r.threshold, 6) AS threshold, r.episodes, r.pages::BIGINT AS pages, round(r.pages_per_day, 6) AS pages_per_day, round(duty, 6) AS duty, round(worst_duty, 6) AS worst_duty, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(curve_auc, 6) AS curve_auc FROM "
        "(SELECT count(*) AS events, round(avg(detected::INT), 6) AS detection_rate, round(quantile_cont(minutes, 0.5) FILTER (detected), 6) AS median_minutes, round(avg((detected AND NOT pre_alarmed)::INT), 6) AS fresh_rate, round(avg(pre_alarmed::INT) FILTER (detected), 6) AS pre_alarmed_share FROM outc) e, "
        "(SELECT t.threshold, (SELECT count(*) FROM ep1) AS episodes, (SELECT coalesce(sum(pages), 0) FROM ep1) AS pages, (SELECT coalesce(sum(pages), 0) FROM ep1) / days AS pages_per_day FROM thr t, days) r, duty, (SELECT precision, recall, f1 FROM f1r), roc, ap, auc",
        f"{_OUT}, {_CURVE}, {_AUC}, {_DUTY}, {_ROC}, {_AP}, "
        + _EPISODES.replace("numbered AS", "numbered1 AS").replace("FROM numbered n JOIN cand c", "FROM numbered1 n JOIN thr c").replace("firing AS", "firing1 AS").replace("ep AS", "ep1 AS").replace("FROM firing GROUP", "FROM firing1 GROUP")
        + ", "
        + _PRF.replace("prf AS", "prf1 AS").replace("FROM prf)", "FROM prf1)").replace("sw, cand c", "sw, thr c").replace(", f AS", ", f1r AS"),
    ),
)(lambda s, d: (lambda p: (lambda x: rounded(evaluate.detection_report(x[1], x[0], p, fixed_threshold(x[1]), G)))(spread_windows(p)))(points(s, d)))


def compared(p: DataFrame) -> DataFrame:
    """One report row for each statistic detector: area, duty and page rate at its own budget threshold."""
    inc = settled(incidents_of(p), "incidents")
    index, z = settled(windows.window_index(p, inc, G), "index"), settled(scaled(p), "scaled")
    rows = None
    for name in ("max_deviation", "window_spread", "naive_residual"):
        sw = settled(evaluate.scored_windows(index, detectors.STATISTICS[name](z, G).withColumn("score", F.round("score", 9))), "windows")
        row = evaluate.roc_auc(sw).crossJoin(evaluate.average_precision(sw)).crossJoin(evaluate.curve_auc(evaluate.detection_curve(sw, inc, p, G))).select(F.lit(name).alias("detector"), "*")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def _compared_sql() -> str:
    parts = []
    for name, sql in (("max_deviation", _DETECT["max_deviation"]), ("window_spread", _DETECT["window_spread"]), ("naive_residual", _DETECT["naive_residual"])):
        inner = with_base(f"SELECT '{name}' AS detector, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(curve_auc, 6) AS curve_auc FROM roc, ap, auc", f"{_CURVE}, {_AUC}, {_ROC}, {_AP}")
        parts.append("(" + inner.replace("sw AS (SELECT * FROM idx JOIN spread USING (series_id, start))", f"own AS ({sql}), sw AS (SELECT * FROM idx JOIN own USING (series_id, start))") + ")")
    return " UNION ALL ".join(parts)


query("detector_comparison", _compared_sql())(lambda s, d: rounded(compared(points(s, d))))
query("chosen_detector", f"WITH c AS ({_compared_sql()}) SELECT arg_max(detector, (curve_auc, detector)) AS detector FROM c")(lambda s, d: (lambda p: evaluate.chosen_detector(compared(p).withColumn("median_minutes", F.lit(None).cast("double"))))(points(s, d)))
_BOOT = """ranked_v AS (SELECT row_number() OVER (ORDER BY key) - 1 AS i, value FROM vals), n AS (SELECT count(*) AS n FROM vals),
draws AS (SELECT b, CAST(('0x' || substr(md5('42:' || b || ':' || k), 1, 8)) AS BIGINT) % n AS i FROM range(2000) x(b), range(200) y(k), n WHERE k < n),
stat AS (SELECT b, avg(value) AS s FROM draws JOIN ranked_v USING (i) GROUP BY b)"""
_BOOT_OUT = "SELECT round((SELECT avg(value) FROM vals), 6) AS estimate, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM stat"
query("bootstrap_detection_ci", with_base(_BOOT_OUT, f"{_OUT}, vals AS (SELECT event_id AS key, detected::INT::DOUBLE AS value FROM outc), {_BOOT}"))(
    lambda s, d: rounded(evaluate.bootstrap(outcomes_of(points(s, d)).select(F.col("event_id").alias("key"), F.col("detected").cast("double").alias("value")), replicates=2000))
)
_DELTA = "vals AS (SELECT o.event_id AS key, o.detected::INT::DOUBLE - (CASE WHEN p.peak >= 3 THEN 1.0 ELSE 0 END) AS value FROM outc o JOIN peaks p USING (event_id))"
query("paired_delta_ci", with_base(_BOOT_OUT, f"{_OUT}, {_PEAKS}, {_DELTA}, {_BOOT}"))(
    lambda s, d: (lambda p: (lambda x: rounded(evaluate.paired_delta(outcomes_of(p), evaluate.event_peaks(x[1], x[0], G).select("event_id", (F.col("peak") >= 3).alias("detected")), replicates=2000)))(spread_windows(p)))(points(s, d))
)


query("split_time_based", with_base("SELECT series_id, split, count(*) AS steps, min(original_t) AS first, max(original_t) AS last, max(t) AS last_rebased FROM sp GROUP BY series_id, split"))(
    lambda s, d: series.split_time_based(points(s, d)).groupBy("series_id", "split").agg(F.count(F.lit(1)).alias("steps"), F.min("original_t").alias("first"), F.max("original_t").alias("last"), F.max("t").alias("last_rebased"))
)
query("split_held_out", with_base("SELECT series_id, CASE WHEN k <= floor(n * 0.55) THEN 'train' WHEN k <= floor(n * 0.7) THEN 'validation' ELSE 'test' END AS split FROM (SELECT series_id, row_number() OVER (ORDER BY md5('42:' || series_id), series_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT series_id FROM mp))"))(
    lambda s, d: series.split_held_out(points(s, d))
)
_SI = 'bounds AS (SELECT series_id, split, min(original_t) AS lo, max(original_t) + 1 AS hi FROM sp GROUP BY series_id, split), si AS (SELECT i.event_id, i.series_id, b.split, i.start - lo AS start, i."end" - lo AS "end" FROM inc i JOIN bounds b ON b.series_id = i.series_id AND i.start >= lo AND i."end" <= hi)'


def split_windows(split_points: DataFrame, split_inc: DataFrame) -> DataFrame:
    """Window index of every split's own pieces; a piece is a series of its own."""
    key = F.concat_ws("/", "split", "series_id")
    index = windows.window_index(split_points.withColumn("series_id", key), split_inc.withColumn("series_id", key), G)
    return index.withColumn("split", F.split_part("series_id", F.lit("/"), F.lit(1)))


def summary_of(p: DataFrame) -> DataFrame:
    sp = series.split_time_based(p)
    si = series.split_incidents(sp, incidents_of(p))
    return series.split_summary(sp, si, split_windows(sp, si))


_SW = 'pieces AS (SELECT series_id, split, max(t) + 1 AS n FROM sp GROUP BY series_id, split), sws AS (SELECT series_id, split, CAST(unnest(range(0, n - 11, 2)) AS INT) AS start FROM pieces), swl AS (SELECT w.split, w.series_id, w.start, max(CASE WHEN i.event_id IS NULL THEN 0 ELSE 1 END) AS label FROM sws w LEFT JOIN si i ON i.series_id = w.series_id AND i.split = w.split AND w.start < i."end" AND w.start + 12 > i.start GROUP BY ALL)'
query(
    "split_summary",
    with_base(
        'SELECT a.split, series, steps, coalesce(events, 0) AS events, median_length, windows, anomalous_rate FROM (SELECT split, count(DISTINCT series_id) AS series, count(*) AS steps FROM sp GROUP BY split) a LEFT JOIN (SELECT split, count(*) AS events, list_sort(list("end" - start))[count(*) // 2 + 1] AS median_length FROM si GROUP BY split) b USING (split) LEFT JOIN (SELECT split, count(*) AS windows, round(avg(label), 6) AS anomalous_rate FROM swl GROUP BY split) c USING (split)',
        f"{_SI}, {_SW}",
    ),
)(lambda s, d: summary_of(points(s, d)))
query("orphan_check", with_base("SELECT series_id, count(*) AS orphans FROM idx WHERE label = 1 AND event_id NOT IN (SELECT event_id FROM inc WHERE event_id % 5 != 0) GROUP BY series_id"))(
    lambda s, d: (lambda p: (lambda inc: series.orphans(windows.window_index(p, inc, G), inc.where("event_id % 5 != 0")))(incidents_of(p)))(points(s, d))
)


def generated(s: SparkSession, d: str) -> DataFrame:
    """Generated traffic of as many series and steps as the events give."""
    size = points(s, d).agg(F.countDistinct("series_id").alias("n"), (F.max("t") + 1).alias("steps")).first()
    return synthetic_metrics(s, scenarios=size["n"], steps=max(32, (size["steps"] or 0) // 16 * 16))


query("synthetic_metrics")(lambda s, d: rounded(generated(s, d)))
query("signature_matrix", with_base("SELECT event_id, array_to_string(list_transform([1, 2, 3, 4], lambda x: CASE WHEN list_contains(dims, x) THEN 1 ELSE 0 END), '') AS signature FROM dims WHERE len(dims) > 0", _SPANS))(
    lambda s, d: classify.signature_matrix(with_dims(points(s, d)), 4).withColumn("signature", F.array_join(F.transform("signature", lambda x: x.cast("string")), ""))
)
query("archetype_profiles", with_base("SELECT dim, round(avg(CASE WHEN list_contains(dims, dim) THEN 1.0 ELSE 0 END), 6) AS share FROM dims, (VALUES (1), (2), (3), (4)) v(dim) WHERE len(dims) > 0 GROUP BY dim", _SPANS))(
    lambda s, d: classify.dim_shares(classify.signature_matrix(with_dims(points(s, d)), 4))
)


def clusters_of(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    signatures = classify.signature_matrix(with_dims(p), 4)
    return signatures, classify.archetype_clusters(signatures, 3)


query("archetype_clusters")(lambda s, d: (lambda x: classify.archetypes(x[0], x[1], 4, support=3).withColumn("profile", F.array_join(F.transform("profile", lambda v: v.cast("string")), ",")))(clusters_of(points(s, d))))
#: Pretended verdict of a window: from its start and event, the same in both engines.
_PREDICTED = "predicted AS (SELECT event_id, start, 'c' || ((start // 2 + event_id) % 3) AS predicted, 'c' || (event_id % 3) AS truth FROM idx WHERE label = 1), vote AS (SELECT event_id, predicted AS verdict FROM (SELECT event_id, predicted, row_number() OVER (PARTITION BY event_id ORDER BY count(*) DESC, min(start), predicted) AS k FROM predicted GROUP BY event_id, predicted) WHERE k = 1), conf AS (SELECT truth, verdict, count(*) AS n FROM vote JOIN (SELECT DISTINCT event_id, truth FROM predicted) USING (event_id) GROUP BY truth, verdict)"


def pretended(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    index = windows.window_index(p, incidents_of(p), G).where("label = 1")
    c = F.lit("c")
    rows = index.select("event_id", "start", F.concat(c, ((F.floor(F.col("start") / 2) + F.col("event_id")) % 3).cast("string")).alias("predicted"), F.concat(c, (F.col("event_id") % 3).cast("string")).alias("truth"))
    voted = classify.majority_vote(rows).join(rows.select("event_id", "truth").distinct(), "event_id")
    return rows, classify.confusion_matrix(voted)


query("majority_vote", with_base("SELECT event_id, verdict FROM vote", _PREDICTED))(lambda s, d: classify.majority_vote(pretended(points(s, d))[0]))
query("confusion_matrix", with_base("SELECT truth, verdict, n FROM conf", _PREDICTED))(lambda s, d: pretended(points(s, d))[1])
query(
    "macro_f1",
    with_base(
        "SELECT round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) AS macro_f1, round(sum(tp) / sum(actual), 6) AS accuracy FROM (SELECT label, coalesce(tp, 0)::DOUBLE AS tp, coalesce(actual, 0)::DOUBLE AS actual, coalesce(tp / nullif(claimed, 0), 0) AS p, coalesce(tp / nullif(actual, 0), 0) AS r FROM (SELECT truth AS label, sum(n)::DOUBLE AS actual, sum(CASE WHEN truth = verdict THEN n ELSE 0 END)::DOUBLE AS tp FROM conf GROUP BY truth) FULL JOIN (SELECT verdict AS label, sum(n)::DOUBLE AS claimed FROM conf GROUP BY verdict) USING (label))",
        _PREDICTED,
    ),
)(lambda s, d: classify.macro_f1(pretended(points(s, d))[1]))
query("class_coverage", with_base("SELECT min(coalesce(n, 0)) AS coverage FROM (SELECT * FROM (SELECT DISTINCT split FROM si), (SELECT DISTINCT event_id % 3 AS cause FROM si)) b LEFT JOIN (SELECT split, event_id % 3 AS cause, count(DISTINCT event_id) AS n FROM si GROUP BY ALL) c USING (split, cause)", _SI))(
    lambda s, d: (lambda p: classify.class_coverage(series.split_incidents(series.split_time_based(p), incidents_of(p)).withColumn("cause", F.col("event_id") % 3)))(points(s, d))
)


query(
    "report_rollup",
    "SELECT n_name AS source, o_orderpriority AS strategy, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, grouping(n_name) * 2 + grouping(o_orderpriority) AS level FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderpriority)",
)(
    lambda s, d: table(s, d, "orders").join(table(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(s, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    .rollup(F.col("n_name").alias("source"), F.col("o_orderpriority").alias("strategy")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.grouping_id().alias("level"))
)
query("sliding_window_ts", "SELECT event_type, w AS window_start, count(*) AS n FROM (SELECT event_type, unnest(range(time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 50 MINUTE, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE, INTERVAL 10 MINUTE)) AS w FROM events) GROUP BY ALL")(
    lambda s, d: table(s, d, "events").groupBy("event_type", F.window("ts", "60 minutes", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("window_start"), "n")
)
query("tumbling_window_ts", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")(
    lambda s, d: table(s, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select("event_type", F.col("w.start").alias("window_start"), "n", "mean_value")
)
query(
    "session_islands",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS session_start, max(ts) AS session_last, count(*) AS n FROM k GROUP BY user_id, s",
)(
    lambda s, d: table(s, d, "events").withColumn("last", F.col("ts")).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("session_start"), F.max("ts").alias("session_last")).select("user_id", "session_start", "session_last", "n")
)


def split_report(s: SparkSession, d: str) -> DataFrame:
    """Three statistics on a split by time: thresholds from validation, figures from test, beside window_spread."""
    p = points(s, d)
    parts = compare.pieces(p, incidents_of(p), G)
    found = compare.run_split(parts, {n: detectors.STATISTICS[n] for n in ("max_deviation", "window_spread", "naive_residual")}, G, 0.05)
    return rounded(found.select("detector", "threshold", "events", "detection_rate", "pages", "pages_per_day", "roc_auc", "curve_auc", "validation_curve_auc", "delta"))


def _split_sql() -> str:
    """The same in SQL: every detector's tables shadow those of the whole series."""
    base = f"""{_SI}, pz AS (SELECT sp.split || '/' || sp.series_id AS series_id, sp.split, sp.t, sp.point_label, z0, z1, z2, z3 FROM sp JOIN z ON z.series_id = sp.series_id AND z.t = sp.original_t),
pst AS (SELECT series_id, split, CAST(unnest(range(0, n - 11, 2)) AS INT) AS start FROM (SELECT series_id, split, max(t) + 1 AS n FROM pz GROUP BY ALL)),
pin AS (SELECT event_id, split || '/' || series_id AS series_id, split, start, "end" FROM si),
pidx AS (SELECT s.series_id, s.split, s.start, max(CASE WHEN i.event_id IS NULL THEN 0 ELSE 1 END) AS label FROM pst s LEFT JOIN pin i ON i.series_id = s.series_id AND s.start < i."end" AND s.start + 12 > i.start GROUP BY ALL),
pwz AS (SELECT s.series_id, s.start, pz.t, z0, z1, z2, z3 FROM pst s JOIN pz ON pz.series_id = s.series_id AND pz.t >= s.start AND pz.t < s.start + 12)"""
    out = _OUT.replace(f"{_THR}, ", "")
    rows = []
    for name in ("max_deviation", "window_spread", "naive_residual"):
        sql = _DETECT[name] if name != "window_spread" else "SELECT series_id, start, round(greatest(stddev_pop(z0), stddev_pop(z1), stddev_pop(z2), stddev_pop(z3)), 9) AS score FROM wz GROUP BY series_id, start"
        base += f", sc_{name} AS (WITH wz AS (SELECT * FROM pwz) {sql})"

        def of(split: str, name=name) -> str:
            return (
                f"sw AS (SELECT pidx.series_id, pidx.start, label, score FROM pidx JOIN sc_{name} USING (series_id, start) WHERE split = '{split}'), inc AS (SELECT event_id, series_id, start, \"end\" FROM pin WHERE split = '{split}'), "
                f"days AS (SELECT greatest(sum(CASE WHEN point_label = 0 THEN 1 ELSE 0 END) / 24.0, 1e-9) AS days FROM pz WHERE split = '{split}')"
            )

        base += f", pick_{name} AS (WITH {of('validation')}, {_candidates(200)}, {_RATES}, {_PICK} SELECT threshold FROM pick), vauc_{name} AS (WITH {of('validation')}, {_CURVE}, {_AUC} SELECT curve_auc FROM auc)"
        base += f", tauc_{name} AS (WITH {of('test')}, {_CURVE}, {_AUC} SELECT curve_auc FROM auc), troc_{name} AS (WITH {of('test')}, {_ROC} SELECT roc_auc FROM roc)"
        base += f", out_{name} AS (WITH {of('test')}, thr AS (SELECT threshold FROM pick_{name}), {out} SELECT * FROM outc)"
        base += f", rate_{name} AS (WITH {of('test')}, cand AS (SELECT threshold FROM pick_{name}), {_RATES} SELECT * FROM rates)"
        delta = "NULL::DOUBLE" if name == "window_spread" else f"round((SELECT avg(a.detected::INT - b.detected::INT) FROM out_{name} a JOIN out_window_spread b USING (event_id)), 6)"
        rows.append(
            f"SELECT '{name}' AS detector, round(threshold, 6) AS threshold, (SELECT count(*) FROM out_{name}) AS events, round((SELECT avg(detected::INT) FROM out_{name}), 6) AS detection_rate, pages::BIGINT AS pages, round(pages_per_day, 6) AS pages_per_day, "
            f"round((SELECT roc_auc FROM troc_{name}), 6) AS roc_auc, round((SELECT curve_auc FROM tauc_{name}), 6) AS curve_auc, round((SELECT curve_auc FROM vauc_{name}), 6) AS validation_curve_auc, {delta} AS delta FROM rate_{name}"
        )
    return with_base(" UNION ALL ".join(rows), base)


query("split_report", _split_sql())(split_report)


def built(s: SparkSession, d: str) -> DataFrame:
    """Detectors as a service builds them: one that can be fitted and one that can't, which falls back."""
    p = points(s, d)
    parts = compare.pieces(p, incidents_of(p), G)
    found = [(kind, compare.build_detector(kind, parts, G, 0.05)) for kind in ("naive_residual", "no_such_detector")]
    return s.createDataFrame([(kind, b.name, round(b.threshold, 6), len(b.notes)) for kind, b in found], "asked string, detector string, threshold double, notes long")


query("built_detectors", f"WITH r AS ({_split_sql()}) SELECT 'naive_residual' AS asked, detector, threshold, 0 AS notes FROM r WHERE detector = 'naive_residual' UNION ALL SELECT 'no_such_detector', detector, threshold, 1 FROM r WHERE detector = 'window_spread'")(built)
