"""Places in a sorted order and order statistics, without a window or a sort in one task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from vantarow.sinks.store import workspace


def _run(batches: Iterator[pa.RecordBatch], weights: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Running sums inside one sorted run."""
    run = TaskContext.get().partitionId()
    carry = dict.fromkeys(weights, 0)
    for batch in batches:
        columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for w in weights:
            values = columns[w].to_numpy(zero_copy_only=False).astype(np.int64)
            after = np.cumsum(values) + carry[w]
            columns[f"{w}_before"] = pa.array(after - values)
            carry[w] = int(after[-1]) if len(after) else carry[w]
        columns["run"] = pa.array(np.full(batch.num_rows, run, np.int32))
        yield pa.RecordBatch.from_pydict(columns)


def sums_before(df: DataFrame, order: list[str | Column], weights: tuple[str, ...], name: str = "runs") -> DataFrame:
    """``df`` and for each column w of ``weights`` (long, not null) a column w_before: its sum over all earlier rows.

    Rows are dealt by range and sorted (``order`` should be a total order; rows that tie in all of it come in any one
    order), each sorted run is summed as it streams by and written; only the totals of runs reach the driver.
    """
    spark = df.sparkSession
    schema = StructType(list(df.schema.fields))
    for w in weights:
        schema = schema.add(f"{w}_before", LongType())
    schema = schema.add("run", IntegerType())
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = workspace(spark, name)
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(partial(_run, weights=weights), schema).write.parquet(path)
    runs = spark.read.schema(schema).parquet(path)
    totals = sorted(runs.groupBy("run").agg(*[F.sum(w).alias(w) for w in weights]).collect(), key=lambda r: r["run"])
    offsets, at = [], dict.fromkeys(weights, 0)
    for row in totals:
        offsets.append((row["run"], *[at[w] for w in weights]))
        for w in weights:
            at[w] += int(row[w])
    earlier = spark.createDataFrame(offsets, "run int, " + ", ".join(f"{w}_offset long" for w in weights))
    joined = runs.join(F.broadcast(earlier), "run")
    return joined.select(*df.columns, *[(F.col(f"{w}_before") + F.col(f"{w}_offset")).alias(f"{w}_before") for w in weights])


def numbered(df: DataFrame, order: list[str | Column], to: str) -> DataFrame:
    """``df`` with the number (from 0) of each row in ``order``."""
    ranked = sums_before(df.withColumn("__one", F.lit(1).cast("long")), order, ("__one",), "numbered")
    return ranked.withColumnRenamed("__one_before", to).drop("__one")


def order_statistics(values: DataFrame, column: str, shares: list[float], by: str | None = None) -> DataFrame:
    """Exact percentiles (share, value; with ``by``, of each of its few values), interpolated between neighbours.

    An empty column has none; nulls don't count. Equal values are one row with a count before anything is sorted; each run
    looks up the ranks that fall into it, and only those rows reach the driver.
    """
    spark = values.sparkSession
    group = F.col(by) if by else F.lit(0)
    kind = values.schema[by].dataType.simpleString() if by else "int"
    counts = values.where(F.col(column).isNotNull()).groupBy(group.alias("of"), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = sums_before(counts, ["of", "value"], ("n",), "ranks")
    groups = placed.groupBy("of").agg(F.min("n_before").alias("first"), F.sum("n").alias("total")).collect()
    places = []
    for g in groups:
        last = g["total"] - 1
        for s in shares:
            low = min(int(s * last), last)
            places.append((g["of"], float(s), g["first"] + low, g["first"] + min(low + 1, last), s * last - low))
    ranks = sorted({r for p in places for r in p[2:4]})
    inside = F.filter(F.array(*[F.lit(r).cast("long") for r in ranks]), lambda r: (r >= F.col("n_before")) & (r < F.col("n_before") + F.col("n")))
    held = {row["rank"]: float(row["value"]) for row in placed.select(F.explode(inside).alias("rank"), "value").collect()} if ranks else {}
    rows = [(of, s, held[low] + (held[high] - held[low]) * part) for of, s, low, high, part in places]
    found = spark.createDataFrame(rows, f"of {kind}, share double, value double")
    return found.withColumnRenamed("of", by) if by else found.drop("of")
