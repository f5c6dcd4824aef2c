"""Readers of files: machines, corpora, cases, requests, logs and settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantarow.sources.machines import read_machines

WINDOW = "window_id string, series_id string, columns array<string>, values array<array<double>>"


def load_machine(spark: SparkSession, root: str, machine: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points and annotation spans of one machine; see :func:`vantarow.sources.machines.read_machines`."""
    return load_machines(spark, root, [machine], names)


def load_machines(spark: SparkSession, root: str, machines: list[str], names: list[str]) -> tuple[DataFrame, DataFrame]:
    found = read_machines(spark, root, names, machines)
    return found.points, found.spans


def wanted_paths(files: DataFrame, prefixes: tuple[str, ...], suffix: str = ".md", index: str = "_index.md") -> DataFrame:
    """Files (path) below one of the prefixes, of the suffix, not an index page, and with no step up."""
    under = reduce(lambda a, b: a | b, [F.col("path").startswith(p) for p in prefixes], F.lit(False))
    return files.where(under & F.col("path").endswith(suffix) & ~F.col("path").endswith(f"/{index}") & ~F.array_contains(F.split("path", "/"), "..") & ~F.col("path").startswith("/"))


def usable_documents(documents: DataFrame, least: int = 400) -> DataFrame:
    """Documents of at least so many characters that have a title."""
    return documents.where((F.length("text") >= least) & (F.coalesce(F.trim("title"), F.lit("")) != ""))


def read_corpus(spark: SparkSession, path: str, schema: str = "doc_id string, source string, title string, text string, url string, licence string") -> DataFrame:
    """A corpus file: a JSON array of documents."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_cases(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """Labelled cases of a JSON file: the array under ``field``, one row for each item, numbered in their order."""
    rows = spark.read.schema(f"`{field}` array<struct<{item}>>").option("multiLine", True).json(path)
    return rows.select(F.posexplode(field).alias("case_id", "case")).select("case_id", "case.*")


def parse_requests(bodies: DataFrame, column: str = "body", schema: str = WINDOW) -> DataFrame:
    """Request bodies (JSON text) as windows; a body that isn't one has ``malformed`` set and nulls."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    rows = bodies.withColumn("__w", parsed)
    return rows.select(*bodies.columns, "__w.*", (F.col("__w").isNull() | F.col("__w.values").isNull()).alias("malformed"))


def demo_window(points: DataFrame, names: list[str], length: int, label: int) -> DataFrame:
    """A window of a series as a request would send it: the first that begins at a step with the label, else at the first step."""
    at = points.groupBy("series_id").agg(F.coalesce(F.min(F.when(F.col("point_label") == label, F.col("t"))), F.min("t")).alias("t0"))
    inside = points.join(F.broadcast(at), "series_id").where((F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t0") + length))
    return inside.groupBy("series_id", "t0").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", F.array(*[F.col(n).cast("double") for n in names]).alias("v")))), lambda x: x["v"]).alias("values"))


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An audit log of JSON lines."""
    return spark.read.schema(schema).json(path)


def key_ring(entries: DataFrame, today: Column) -> DataFrame:
    """Access keys from entries ``name:key[:date]`` (column entry): name, digest of the key, expiry, and whether it is usable.

    A date must be a full ISO date; an entry with a bad one, without a name or key, or of the wrong form is malformed
    and unusable. A key is refused from its expiry day on.
    """
    parts = F.split("entry", ":")
    text = F.get(parts, F.lit(2))
    expiry = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    bad = (F.size(parts) < 2) | (F.size(parts) > 3) | (F.trim(F.get(parts, F.lit(0))) == "") | (F.trim(F.get(parts, F.lit(1))) == "") | (text.isNotNull() & expiry.isNull())
    rows = entries.select("*", F.trim(F.get(parts, F.lit(0))).alias("name"), F.sha2(F.trim(F.get(parts, F.lit(1))), 256).alias("key_sha256"), expiry.alias("expiry"), F.coalesce(bad, F.lit(True)).alias("malformed"))
    return rows.withColumn("usable", ~F.col("malformed") & (F.col("expiry").isNull() | (F.col("expiry") > today)))


def settings(spark: SparkSession, defaults: dict[str, str], prefix: str = "vantarow.") -> dict[str, str]:
    """Settings by name: a session's ``prefix`` + name comes before the default."""
    return {k: spark.conf.get(f"spark.{prefix}{k}", v) for k, v in defaults.items()}
