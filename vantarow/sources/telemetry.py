"""Readers and adapters that give metric points, annotation spans and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ordered contract of metric columns; every wide operator takes the names from here or from its caller.
METRICS = ("n_events", "mean_value", "max_value", "error_rate")
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def metric_points(events: DataFrame, n_series: int = 8, quantile: float = 0.99) -> DataFrame:
    """Dense hourly grid of metrics by series, with a point label: max_value in its upper tail.

    ``n_series``: how many series the users are dealt to. Steps count from the first hour that has an event to the
    last. One shuffle on (series, hour) with partial aggregation; the grid joins in with its own small side.
    """
    spark = events.sparkSession
    hour = _hour(F.col("ts"))
    # the range is one row, of the table's statistics where the file has them
    ends = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(*[hour_of.alias(n) for n, hour_of in (("lo", _hour(F.col("lo"))), ("hi", _hour(F.col("hi"))))])
    by_hour = (
        events.select(series_name(F.pmod("user_id", F.lit(n_series))).alias("series_id"), hour.alias("h"), "value", "event_type").groupBy("series_id", "h")
        .agg(F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"))
    )
    names = spark.range(n_series).select(series_name(F.col("id")).alias("series_id"))
    grid = names.crossJoin(F.broadcast(ends.where("lo is not null"))).select("series_id", "lo", F.explode(F.sequence("lo", "hi")).alias("h"))
    dense = grid.join(by_hour, ["series_id", "h"], "left").select("series_id", (F.col("h") - F.col("lo")).alias("t"), *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in METRICS])
    cut = dense.agg(F.percentile("max_value", F.lit(quantile)).alias("cut"))
    return dense.crossJoin(F.broadcast(cut)).select("series_id", "t", *METRICS, (F.col("max_value") >= F.col("cut")).cast("int").alias("point_label"))


def _hour(ts: Column) -> Column:
    return F.floor((F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))) / F.lit(3_600_000_000)).cast("int")


def series_name(number: Column) -> Column:
    return F.concat(F.lit("svc-"), F.lpad(number.cast("string"), 2, "0"))


def read_matrix(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Header-less CSV of numbers; rows keep the order of the file as column t."""
    lines = spark.read.schema(", ".join(f"`{n}` double" for n in names)).option("header", "false").csv(path)
    numbered = lines.withColumn("__i", F.monotonically_increasing_id())
    return numbered.withColumn("t", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__i")) - 1).cast("int")).drop("__i")


def read_point_labels(spark: SparkSession, path: str) -> DataFrame:
    """Header-less CSV of one label per step."""
    return read_matrix(spark, path, ["point_label"]).select("t", F.col("point_label").cast("int").alias("point_label"))


def parse_annotations(lines: DataFrame, *more: str) -> DataFrame:
    """``start-end:dim,dim`` lines (column value) to spans, with columns ``more``; lines without a colon are skipped, dims sorted."""
    text = F.trim("value")
    span, dims = F.split_part(text, F.lit(":"), F.lit(1)), F.split_part(text, F.lit(":"), F.lit(2))
    return lines.where(text.contains(":")).select(
        F.split_part(span, F.lit("-"), F.lit(1)).cast("int").alias("start"), F.split_part(span, F.lit("-"), F.lit(2)).cast("int").alias("end"),
        F.array_sort(F.transform(F.filter(F.split(dims, ","), lambda d: F.trim(d) != ""), lambda d: F.trim(d).cast("int"))).alias("dims"), *more,
    )


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation spans of one file; a missing file has none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "start int, end int, dims array<int>")
    return parse_annotations(spark.read.text(path))


def global_event_ids(incidents: DataFrame) -> DataFrame:
    """Unique ids in the order of series, then start. Counted per series first, so no task numbers all rows."""
    counts = incidents.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("series_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("series_id", "offset")
    local = F.row_number().over(Window.partitionBy("series_id").orderBy("start")) - 1
    return incidents.withColumn("__n", local).join(F.broadcast(offsets), "series_id").withColumn("event_id", (F.col("offset") + F.col("__n")).cast("int")).drop("offset", "__n")


def content_digest(files: DataFrame) -> DataFrame:
    """One digest over files (path, content): sha256 of path, a zero byte and the content's sha256, in path order."""
    each = files.select("path", F.sha2("content", 256).alias("digest"))
    ordered = F.array_sort(F.collect_list(F.struct("path", "digest")))
    return each.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x["path"], F.lit("\u0000"), x["digest"])), ""), 256).alias("digest"))


CAUSES = ("cpu_saturation", "memory_leak", "network_loss", "disk_pressure")


def synthetic_metrics(spark: SparkSession, scenarios: int = 4, steps: int = 2880, events: int = 4, seed: int = 42) -> DataFrame:
    """Daily sine with hash noise, and one root-cause signature per equal slot: ramp, step or bump.

    Noise is md5 of (seed, scenario, step, metric), so the table is the same on every engine and cluster.
    """

    def draw(*parts: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

    slot = steps // events
    duration = slot // 4
    rows = spark.range(scenarios).select(F.col("id").cast("int").alias("scenario"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t"))
    number = F.floor(F.col("t") / slot).cast("int")
    rows = rows.withColumn("slot", F.least(number, F.lit(events - 1)))
    rows = rows.withColumn("start", (F.col("slot") * slot + F.floor(draw(F.lit("start"), F.col("scenario"), F.col("slot")) * (slot - duration))).cast("int"))
    rows = rows.withColumn("cause", F.element_at(F.array(*[F.lit(c) for c in CAUSES]), (F.pmod(F.col("slot") + F.col("scenario"), F.lit(len(CAUSES))) + 1).cast("int")))
    inside = (F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + duration)
    i = F.col("t") - F.col("start")
    shape = (
        F.when(F.col("cause") == "memory_leak", i / F.lit(float(duration)))
        .when(F.col("cause") == "network_loss", 0.5 - 0.5 * F.cos(2 * 3.141592653589793 * i / F.lit(float(max(1, duration - 1)))))
        .otherwise(F.lit(1.0))
    )
    push = F.when(inside, shape * (20.0 + 10.0 * draw(F.lit("severity"), F.col("scenario"), F.col("slot")))).otherwise(F.lit(0.0))
    day = F.sin(2 * 3.141592653589793 * F.pmod("t", F.lit(1440)) / F.lit(1440.0))
    values = []
    for k, (name, base, cause) in enumerate((("cpu", 50.0, CAUSES[0]), ("memory", 40.0, CAUSES[1]), ("latency", 20.0, CAUSES[2]), ("disk", 30.0, CAUSES[3]))):
        noise = (draw(F.lit(f"noise{k}"), F.col("scenario"), F.col("t")) - 0.5) * 4.0
        values.append((base + 10.0 * day + noise + F.when(F.col("cause") == cause, push).otherwise(0.25 * push)).alias(name))
    return rows.select(F.concat(F.lit("syn-"), F.lpad(F.col("scenario").cast("string"), 2, "0")).alias("series_id"), "t", *values, inside.cast("int").alias("point_label"), F.when(inside, F.col("cause")).otherwise("normal").alias("cause"))
