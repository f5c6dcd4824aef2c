"""The Spark session every entry point of the library uses when none is given."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "vantarow", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or fetch) a session: UTC, ANSI mode, adaptive execution with skew handling."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
