from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from vantarow.operators import detectors, response
from vantarow.operators.series import Geometry
from vantarow.streaming import live, stateful


def test_live_scores_equal_batch_scores(spark, tmp_path):
    values, g = np.random.default_rng(4).normal(size=60), Geometry(12, 4)
    rows = spark.createDataFrame([(s, i, float(v)) for s in ("a", "b") for i, v in enumerate(values)], "series_id string, t int, m double")
    for k in range(3):
        rows.where(f"t % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.window_spread_stream(stream, ("m",), g).writeStream.format("memory").queryName("live_scores").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.series_id, r.start): round(r.score, 9) for r in spark.table("live_scores").collect()}
    want = {(r.series_id, r.start): round(r.score, 9) for r in detectors.window_spread(rows, g, ("m",)).collect()}
    assert got == want and len(got) == 26


def test_windows_and_repeats_on_a_stream(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, int(id) * 10) as ts, 'x' as event_type, id % 2 as user_id from range(30)")
    rows.unionByName(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.counts_by_window(live.without_repeats(stream), late=None).writeStream.format("memory").queryName("live_counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.n for r in spark.table("live_counts").collect()} <= {6}


def _replay(spark, tmp_path, rows, make, name, restart=True):
    """Write ``rows`` (frames, in order) as files, run the stream over the first half, stop, and go on from the checkpoint."""
    out, schema = str(tmp_path / f"{name}-out"), rows[0].schema
    done = 0
    for upto in ((len(rows) + 1) // 2, len(rows)) if restart else (len(rows),):
        for k in range(done, upto):
            rows[k].coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        done = upto
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    return spark.read.parquet(out)


def test_streamed_admissions_equal_the_batch_fold(spark, tmp_path):
    r = np.random.default_rng(6)
    at = np.sort(r.uniform(0, 400, 240)).round(3)
    data = [(int(r.integers(0, 4)), float(t), i) for i, t in enumerate(at)]
    df = spark.createDataFrame(data, "caller long, at double, request_id long")
    want = {x.request_id: x.admitted for x in response.rate_limit(df, 3, 30.0).collect()}
    timed = df.withColumn("at", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    parts = [timed.where(f"request_id >= {k * 48} and request_id < {(k + 1) * 48}") for k in range(5)]
    got = {x.request_id: (x.admitted, x.retry_after) for x in _replay(spark, tmp_path, parts, lambda s: stateful.rate_limit_stream(s, 3, 30.0), "requests").collect()}
    assert {k: v[0] for k, v in got.items()} == want and 0 < sum(want.values()) < len(want)
    assert all((w is None) == ok and (ok or 0 < w <= 30) for ok, w in got.values())


def test_gates_are_resumed_or_expire(spark, tmp_path):
    def frame(rows):
        df = spark.createDataFrame(rows, "thread_id string, minute int, kind string, principal string")
        return df.withColumn("at", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, minute)")).drop("minute")

    rows = [
        frame([("a", 0, "opened", None), ("b", 1, "opened", None), ("c", 2, "opened", None), ("d", 2, "approve", "x")]),
        frame([("a", 5, "approve", "ann"), ("a", 5, "reject", "bob"), ("b", 6, "reject", "bob")]),
        frame([("a", 9, "reject", "bob"), ("e", 10, "opened", None)]),
        frame([("z", 60, "opened", None)]),  # the watermark moves past the limit of c and e
        frame([("c", 61, "approve", "late"), ("e", 61, "approve", "late")]),
        frame([("z", 62, "approve", "ann")]),
    ]
    got = sorted((x.thread_id, x.version, x.status, x.principal) for x in _replay(spark, tmp_path, rows, lambda s: stateful.approval_gates(s, 30.0), "gates").collect())
    assert got == [
        ("a", 1, "awaiting_approval", None), ("a", 2, "complete", "ann"), ("b", 1, "awaiting_approval", None), ("b", 2, "rejected", "bob"),
        ("c", 1, "awaiting_approval", None), ("c", 2, "expired", None), ("e", 1, "awaiting_approval", None), ("e", 2, "expired", None), ("z", 1, "awaiting_approval", None), ("z", 2, "complete", "ann"),
    ]
