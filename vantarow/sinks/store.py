"""Tables and files that runs leave behind. Spark's commit protocol stands in for lock and rename."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantarow.operators import response


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or the temporary folder of a local session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints/vantarow"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_series(points: DataFrame, incidents: DataFrame, path: str) -> None:
    """Points by split and series, and incidents as a second table: a reader of one split opens only its files."""
    points.write.partitionBy("split", "series_id").parquet(f"{path}/points")
    incidents.write.partitionBy("split").parquet(f"{path}/incidents")


def read_series(spark: SparkSession, path: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    points, incidents = spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/incidents")
    return (points, incidents) if split is None else (points.where(F.col("split") == split), incidents.where(F.col("split") == split))


def write_index(index: DataFrame, path: str) -> None:
    index.write.parquet(path)


def save_scaler(stats: DataFrame, path: str) -> None:
    """Position, metric, mean and std of a fitted scaler, with the version of the layout."""
    stats.withColumn("version", F.lit(2)).write.parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    """A saved scaler; one of the first version, which had no positions, gets them in the order of metrics."""
    stats = spark.read.parquet(path)
    if "position" not in stats.columns:
        stats = stats.withColumn("position", (F.row_number().over(Window.orderBy("metric")) - 1).cast("int"))
    return stats.select("position", "metric", "mean", "std")


def write_manifest(fields: DataFrame, path: str) -> None:
    """One JSON object a row, in one file."""
    fields.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(path)


def read_manifests(spark: SparkSession, path: str, order: tuple[tuple[str, str], ...]) -> DataFrame:
    """Manifests in the fixed order of their (source, strategy); those of no known pair come last, by name."""
    place = F.create_map(*[x for i, (source, strategy) in enumerate(order) for x in (F.lit(f"{source}/{strategy}"), F.lit(i))])
    rows = spark.read.json(path).withColumn("place", F.coalesce(place[F.concat_ws("/", "source", "strategy")], F.lit(len(order))))
    return rows.orderBy("place", "source", "strategy")


def fingerprint(texts: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """Adds the fingerprint of what an embedding was made from: the model and the text."""
    return texts.withColumn("fingerprint", F.sha2(F.concat_ws("\u0000", F.lit(model), F.col(key).cast("string"), text), 256))


def cached_embeddings(texts: DataFrame, key: str, text: str, model: str, embed, path: str) -> DataFrame:
    """Embeddings of texts by fingerprint: only what the cache at ``path`` lacks is encoded, and then appended to it."""
    spark = texts.sparkSession
    wanted = fingerprint(texts, key, text, model)
    try:
        known = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        known = None
    missing = wanted if known is None else wanted.join(known.select("fingerprint"), "fingerprint", "left_anti")
    missing.dropDuplicates(["fingerprint"]).select("fingerprint", embed(text).alias("embedding")).write.mode("append").parquet(path)
    return wanted.join(spark.read.parquet(path), "fingerprint").select(key, "embedding", "fingerprint")


def markdown_table(rows: DataFrame, columns: list[str]) -> str:
    """A small report as a Markdown table; rows are collected, reports have a row for each configuration."""
    lines = [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"]
    for row in rows.select(*columns).collect():
        lines.append(f"| {' | '.join('' if x is None else f'{x:.3f}' if isinstance(x, float) else str(x) for x in row)} |")
    return "\n".join(lines)


def write_page(spark: SparkSession, title: str, body: str, path: str) -> None:
    spark.createDataFrame([(f"# {title}\n\n{body}\n",)], "value string").coalesce(1).write.text(path)


def comparison_page(spark: SparkSession, rows: DataFrame, budget: float, path: str) -> None:
    """Page of a split run's report rows (detector, curve_auc, threshold, detection_rate, pages_per_day, delta): best area first.

    Says which detector is best, what each detects and pages at its threshold, and which differ from the incumbent.
    """
    ordered = rows.orderBy(F.desc("curve_auc"), "detector")
    table_ = markdown_table(ordered, ["detector", "curve_auc", "threshold", "detection_rate", "pages_per_day", "delta"])
    over = [r["detector"] for r in ordered.where(F.col("pages_per_day") > budget).collect()]
    best = ordered.first()
    lines = [f"Best area: {best['detector']} ({best['curve_auc']:.3f})." if best else "No detector was run.", "", table_, ""]
    lines.append(f"Thresholds were chosen for {budget:g} pages a day; on the test split " + (f"{', '.join(over)} page more often." if over else "none pages more often."))
    write_page(spark, "Detectors on a split", "\n".join(lines), path)


def append_audit(log: DataFrame, entries: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """New entries (log_id, names, and at for their order) behind what a log holds, chained to its last hash.

    Entries of one time go by their fields. One writer appends at a time (see :mod:`vantarow.sinks.audit_log` for many); a
    log without entries starts at the genesis hash.
    """
    heads = log.groupBy("log_id").agg(F.max("seq").alias("last"), F.max_by("entry_hash", "seq").alias("head"))
    numbered = entries.withColumn("__n", F.row_number().over(Window.partitionBy("log_id").orderBy("at", *names)) - 1).join(heads, "log_id", "left")
    rows = numbered.withColumn("seq", (F.coalesce("last", F.lit(-1)) + 1 + F.col("__n")).cast("long"))
    return response.build_chain(rows, names, head="head")


def write_checkpoints(states: DataFrame, path: str) -> None:
    """Append versions of thread states (thread_id, version, and anything else)."""
    states.write.mode("append").parquet(path)


def latest_states(checkpoints: DataFrame) -> DataFrame:
    """The newest version of every thread."""
    order = Window.partitionBy("thread_id").orderBy(F.desc("version"))
    return checkpoints.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def write_snapshots(answers: DataFrame, path: str) -> DataFrame:
    """Recorded answers (request_key, text) as JSON, one a key, and their manifest: how many and a digest over all keys."""
    answers.dropDuplicates(["request_key"]).write.json(f"{path}/answers")
    kept = answers.sparkSession.read.schema("request_key string, text string").json(f"{path}/answers")
    # a digest that needs no order of rows: counts and a sum of hashes
    return kept.agg(F.count(F.lit(1)).alias("answers"), F.sum(F.pmod(F.xxhash64("request_key"), F.lit(1 << 40))).alias("digest"))


def log_lines(events: DataFrame, *fields: str) -> DataFrame:
    """JSON log lines: level, message, incident id and other fields; null fields are left out."""
    return events.select(F.to_json(F.struct(*fields)).alias("value"))


def stream_updates(updates: DataFrame, path: str, checkpoint: str):
    """Writes every micro-batch of node updates as JSON lines, each batch under its own number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").json(f"{path}/batch={number}")

    return updates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def iso_seconds(at: Column) -> Column:
    """UTC time to the second, as ISO text."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
