"""Interval joins by buckets: spans meet in the buckets of time that they share, not in all of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(start: Column, end: Column, width: int) -> Column:
    first, last = F.floor(start / width), F.floor((end - 1) / width)
    return F.sequence(first.cast("long"), last.cast("long"))


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int, spans: tuple[str, str] = ("start", "end"), others: tuple[str, str] = ("o_start", "o_end")) -> DataFrame:
    """Pairs of rows of one ``key`` whose half-open spans overlap, each once; columns of both (but for ``key``, of other names).

    A span stands in every bucket of ``width`` that it touches; two that share several meet in the first. An equi join on
    key and bucket, so that a long series is spread over as many tasks as it has buckets. Empty spans meet nothing.
    """
    (a, b), (c, d) = spans, others
    mine = left.where(F.col(a) < F.col(b)).withColumn("__bucket", F.explode(_buckets(F.col(a), F.col(b), width)))
    theirs = right.where(F.col(c) < F.col(d)).withColumn("__bucket", F.explode(_buckets(F.col(c), F.col(d), width)))
    met = mine.join(theirs, [key, "__bucket"]).where((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)))
    return met.where(F.col("__bucket") == F.floor(F.greatest(a, c) / width)).drop("__bucket")


def last_before(points: DataFrame, rows: DataFrame, key: str, width: int, at: str, value: str, limit: str, to: str) -> DataFrame:
    """``points`` with ``to``: the ``value`` of the row of the same ``key`` with the largest ``at`` not beyond ``limit``; null if none.

    Rows of the bucket of ``limit`` are looked at one by one, earlier ones as the last of their bucket, carried forward over
    buckets. ``points`` need a column __id that names a row.
    """
    held = rows.select(key, F.floor(F.col(at) / width).alias("__bucket"), F.col(at).alias("__at"), F.col(value).alias("__value"))
    asked = points.withColumn("__bucket", F.floor(F.col(limit) / width))
    lasts = held.groupBy(key, "__bucket").agg(F.max(F.struct("__at", "__value")).alias("__last"))
    marks = asked.select(key, "__bucket", F.lit(None).cast(lasts.schema["__last"].dataType).alias("__last"))
    order = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.unionByName(marks).groupBy(key, "__bucket").agg(F.max("__last").alias("__last")).select(key, "__bucket", F.last("__last", ignorenulls=True).over(order).alias("__before"))
    near = asked.select("__id", key, "__bucket", limit).join(held, [key, "__bucket"]).where(F.col("__at") <= F.col(limit)).groupBy("__id").agg(F.max(F.struct("__at", "__value")).alias("__own"))
    found = asked.join(carried, [key, "__bucket"], "left").join(near, "__id", "left")
    return found.withColumn(to, F.coalesce("__own", "__before")["__value"]).drop("__bucket", "__before", "__own")
