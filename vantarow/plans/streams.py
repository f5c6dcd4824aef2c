"""Queries that run as streams over the given tables, to their end; the SQL states what the stream has to give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantarow.plans import knowledge
from vantarow.plans.registry import Registry
from vantarow.sinks import store
from vantarow.sources.telemetry import table
from vantarow.streaming import stateful

REGISTRY = Registry()
query = REGISTRY.query


def run_to_end(s: SparkSession, rows: DataFrame, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``rows`` as a stream of files through ``make``, until all of it is through; its sink is read back."""
    where = store.workspace(s, name)
    rows.write.parquet(f"{where}/in")
    stream = s.readStream.schema(rows.schema).parquet(f"{where}/in")
    made = make(stream)
    made.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/at").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(made.schema).parquet(f"{where}/out")


def admissions(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select(F.col("user_id").alias("caller"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("request_id"))
    found = run_to_end(s, rows, lambda x: stateful.rate_limit_stream(x, 2, 3600.0), "admissions")
    return found.select("caller", (F.unix_micros("at") / 1e6).alias("at"), "request_id", "admitted")


def gates(s: SparkSession, d: str) -> DataFrame:
    """Each user is a thread: opened by the first event, decided by the first click (approve) or error (reject) after it within a day."""
    kind = F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "error", "reject").otherwise("opened")
    rows = table(s, d, "events").select(F.col("user_id").cast("string").alias("thread_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), F.col("event_id").cast("string").alias("principal"))
    found = run_to_end(s, rows, lambda x: stateful.approval_gates(x, 24 * 60.0), "gates")
    return found.where("status in ('complete', 'rejected')").select("thread_id", "version", "status", "principal")


query("streamed_admissions", knowledge.REGISTRY.sql["rate_limit_admissions"])(admissions)
query(
    "streamed_gates",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS thread_id, ts, event_id, CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'opened' END AS kind FROM events),
o AS (SELECT thread_id, min(ts) AS opened FROM e WHERE kind = 'opened' GROUP BY thread_id),
f AS (SELECT e.thread_id, arg_min(e.kind, (e.ts, e.kind, CAST(e.event_id AS VARCHAR))) AS kind, arg_min(e.event_id, (e.ts, e.kind, CAST(e.event_id AS VARCHAR))) AS event_id, min(e.ts) AS decided, any_value(opened) AS opened FROM e JOIN o USING (thread_id) WHERE e.kind <> 'opened' AND e.ts >= o.opened GROUP BY e.thread_id)
SELECT thread_id, 2 AS version, CASE kind WHEN 'approve' THEN 'complete' ELSE 'rejected' END AS status, CAST(event_id AS VARCHAR) AS principal FROM f WHERE epoch_ms(decided) - epoch_ms(opened) < 86400000""",
)(gates)


def updates(s: SparkSession, d: str) -> DataFrame:
    """Events as a stream of updates, written batch by batch as JSON lines and read back."""
    where = store.workspace(s, "updates")
    rows = table(s, d, "events").select("event_id", "event_type", "user_id")
    rows.write.parquet(f"{where}/in")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    store.stream_updates(stream, f"{where}/out", f"{where}/at").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(rows.schema).json(f"{where}/out").select("event_id", "event_type", "user_id")


query("streamed_updates", "SELECT event_id, event_type, user_id FROM events")(updates)


def page(s: SparkSession, d: str) -> DataFrame:
    """A report page of events by type, written and read back line by line."""
    rows = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).orderBy("event_type")
    where = store.workspace(s, "page")
    store.write_page(s, "Events", store.markdown_table(rows, ["event_type", "n", "mean_value"]), where)
    return s.read.text(where).where("value != ''")


query(
    "report_page",
    "SELECT '# Events' AS value UNION ALL SELECT '| event_type | n | mean_value |' UNION ALL SELECT '|---|---|---|' UNION ALL SELECT '| ' || event_type || ' | ' || count(*) || ' | ' || printf('%.3f', round(avg(value), 6)) || ' |' FROM events GROUP BY event_type",
)(page)
