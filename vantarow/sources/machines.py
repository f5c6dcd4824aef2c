"""Machines as files of rows: all of them in one scan, whatever the number of files, blocks of files and machines.

A file's rows are numbered by the blocks they come from: each block counts its rows, blocks of a file are added up in their
order, and no task needs a whole file. Files may be folders of part files, and may lie in any store that Spark reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantarow.operators.ranks import numbered
from vantarow.sinks.store import workspace
from vantarow.sources.telemetry import parse_annotations

PARTS = ("train", "test", "test_label", "interpretation_label")
#: The part and the machine of a path: <part>/<machine>.txt, or below <part>/machine=<machine>/.
_PLACE = r"/(train|test|test_label|interpretation_label)/(?:machine=)?([^/]+?)(?:\.txt)?(?:/[^/]+)?$"
#: Counted blocks up to so many are broadcast to the rows.
MAX_BLOCKS = 100_000


@dataclass
class Machines:
    """``points``: series_id, split, t, metrics, point_label; ``spans``: series_id, start, end, dims; ``incidents``: event_id
    (unique over all machines, in their order), series_id, start, end, dims."""

    points: DataFrame
    spans: DataFrame
    incidents: DataFrame


def _paths(spark: SparkSession, root: str, machines: list[str] | None) -> dict[str, list[str]]:
    """What of each part is there: the whole folder, or the wanted machines' files."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path

    def there(path: str) -> bool:
        where = hadoop(path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    if machines is None:
        return {p: [f"{root}/{p}"] for p in PARTS if there(f"{root}/{p}")}
    found = {p: [x for m in machines for x in (f"{root}/{p}/{m}.txt", f"{root}/{p}/machine={m}") if there(x)] for p in PARTS}
    lacking = sorted(m for m in machines if not all(any(f"/{m}.txt" in x or f"machine={m}" in x for x in found[p]) for p in PARTS[:3]))
    if lacking:
        raise FileNotFoundError(f"no train, test or label rows of {lacking}")
    return found


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines (value) with their part, machine and block; empty ones are left out. ``at`` ascends inside a block."""
    text = spark.read.option("recursiveFileLookup", "true").text(paths).where(F.trim("value") != "")
    path = F.col("_metadata.file_path")
    return text.select("value", F.regexp_extract(path, _PLACE, 1).alias("part"), F.regexp_extract(path, _PLACE, 2).alias("machine"), path.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with t, their number inside (part, machine): blocks by file name and place."""
    blocks = rows.groupBy("part", "machine", "file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("part", "machine").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("part", "machine", "file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    few = F.broadcast(offsets) if blocks.limit(MAX_BLOCKS + 1).count() <= MAX_BLOCKS else offsets
    return rows.join(few, ["part", "machine", "file", "block"]).withColumn("t", (F.col("offset") + F.col("at") - F.col("first")).cast("int"))


def read_machines(spark: SparkSession, root: str, names: list[str], machines: list[str] | None = None, metrics: list[str] | None = None) -> Machines:
    """All machines under ``root``, or the named ones: only their files are opened, and only ``metrics`` of ``names`` are kept.

    Train rows have no labels and count as normal; a machine with another number of labels than test rows is a ValueError, a
    row of another width than ``names`` an error of the job. Machines are ordered as named, else by name.
    """
    wanted = list(metrics or names)
    paths = _paths(spark, root, machines)
    lines = _lines(spark, [x for p in PARTS[:3] for x in paths.get(p, [])])
    cells = F.split("value", ",")
    checked = F.when((F.col("part") == "test_label") | (F.size(cells) == len(names)), cells).otherwise(F.raise_error(F.concat(F.lit("a row of another width in "), F.col("file"))).cast("array<string>"))
    values = [F.when(F.col("part") != "test_label", F.trim(F.col("cells")[names.index(m)]).cast("double")).alias(m) for m in wanted]
    label = F.when(F.col("part") == "test_label", F.trim(F.col("cells")[0]).cast("double").cast("int")).alias("label")
    rows = lines.withColumn("cells", checked).select("part", "machine", "file", "block", "at", *values, label)
    # parsed once, in columns: numbers, labels and points all read this
    path = workspace(spark, "machines")
    rows.write.partitionBy("part").parquet(path)
    kept = _numbered(spark.read.schema(rows.schema).parquet(path))
    train = kept.where("part = 'train'").select("machine", F.lit("train").alias("split"), "t", *wanted, F.lit(0).alias("point_label"))
    tests, marks = kept.where("part = 'test'").select("machine", "t", *wanted), kept.where("part = 'test_label'").select("machine", "t", "label")
    a, b = tests.groupBy("machine").agg(F.count(F.lit(1)).alias("rows")), marks.groupBy("machine").agg(F.count(F.lit(1)).alias("labels"))
    wrong = a.join(b, "machine", "full").where("rows is null or labels is null or rows != labels").orderBy("machine").first()
    if wrong:
        raise ValueError(f"{wrong['machine']}: {wrong['rows'] or 0} rows and {wrong['labels'] or 0} labels")
    test = tests.join(marks, ["machine", "t"]).select("machine", F.lit("test").alias("split"), "t", *wanted, F.col("label").alias("point_label"))
    points = train.unionByName(test).select(F.concat_ws("/", "machine", "split").alias("series_id"), "split", "t", *wanted, "point_label")
    notes = spark.createDataFrame([], "start int, end int, dims array<int>, machine string")
    if paths.get("interpretation_label"):
        notes = parse_annotations(_lines(spark, paths["interpretation_label"]), "machine")
    spans = notes.select(F.concat(F.col("machine"), F.lit("/test")).alias("series_id"), "start", "end", "dims")
    return Machines(points, spans, _incidents(test, notes, machines))


def _incidents(test: DataFrame, notes: DataFrame, machines: list[str] | None) -> DataFrame:
    """Runs of labelled steps with the dimensions of the spans that they meet, numbered over all machines in order."""
    on = test.where("point_label = 1").select("machine", "t")
    island = F.col("t") - F.row_number().over(Window.partitionBy("machine").orderBy("t"))
    found = on.withColumn("island", island).groupBy("machine", "island").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end")).drop("island")
    s = notes.select(F.col("machine").alias("of"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), "dims")
    meets = (F.col("machine") == F.col("of")) & (F.col("start") < F.col("s_end")) & (F.col("s_start") < F.col("end"))
    joined = found.join(s, meets, "left").groupBy("machine", "start", "end").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("dims")))).alias("dims"))
    place = F.array_position(F.array(*[F.lit(m) for m in machines]), F.col("machine")) if machines else F.lit(0)
    ids = numbered(joined.withColumn("place", place.cast("long")), ["place", "machine", "start"], "event_id")
    return ids.select(F.col("event_id").cast("int").alias("event_id"), F.concat(F.col("machine"), F.lit("/test")).alias("series_id"), "start", "end", "dims")
