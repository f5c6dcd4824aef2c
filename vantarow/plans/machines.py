"""Queries on machines: the grid that the events give is laid out as files of rows and read back in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantarow.operators import series
from vantarow.plans.detection import _SPANS, points, rounded, train_stats, with_base
from vantarow.plans.registry import Registry
from vantarow.sinks import store
from vantarow.sources.machines import Machines, read_machines
from vantarow.sources.telemetry import METRICS

REGISTRY = Registry()
query = REGISTRY.query


def laid_out(s: SparkSession, d: str) -> Machines:
    """Rows, labels and annotations of every series as text files by machine, and what the reader makes of them."""
    p, root = points(s, d), store.workspace(s, "layout")
    ordered = p.repartitionByRange("series_id", "t").sortWithinPartitions("series_id", "t").withColumnRenamed("series_id", "machine")
    rows = ordered.select("machine", F.concat_ws(",", *[F.col(m).cast("string") for m in METRICS]).alias("value"))
    for part in ("train", "test"):
        rows.write.partitionBy("machine").text(f"{root}/{part}")
    ordered.select("machine", F.col("point_label").cast("string").alias("value")).write.partitionBy("machine").text(f"{root}/test_label")
    spans = series.annotation_spans(p, train_stats(p))
    notes = spans.select(F.col("series_id").alias("machine"), F.format_string("%d-%d:%d", "start", "end", "dim").alias("value"))
    notes.write.partitionBy("machine").text(f"{root}/interpretation_label")
    return read_machines(s, root, list(METRICS))


query("machine_points", with_base("SELECT series_id || '/test' AS series_id, t, round(n_events, 6) AS n_events, round(mean_value, 6) AS mean_value, round(max_value, 6) AS max_value, round(error_rate, 6) AS error_rate, point_label FROM mp"))(
    lambda s, d: rounded(laid_out(s, d).points.where("split = 'test'").drop("split"))
)
query("machine_events", with_base("""SELECT event_id, series_id || '/test' AS series_id, start, "end", array_to_string(coalesce(dims, []), ',') AS dims FROM dims""", _SPANS))(
    lambda s, d: laid_out(s, d).incidents.withColumn("dims", F.array_join(F.transform("dims", lambda x: x.cast("string")), ","))
)
