"""Compression of vectors to codes: integer product quantisation whose codebooks come from Hamerly's form of Lloyd's rounds.

Each part of a vector persists, beside its entry, one upper bound of the distance to it and one lower bound of the distance
to the second nearest. A round moves the bounds by what the entries moved; only where they fail strictly are the integer
distances to all entries taken again, so that results, ties included, are those of full scans.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantarow.llm.common import keep, lean, remove, shared_dir
from vantarow.llm.order import counted

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components must stay below this, so that squared distances of up to 64 components per part fit 64 bits.
LARGEST = float(1 << 15)
#: Relative slack of bounds: far above what 64-bit floats lose in a round, far below any effect on the scans.
SLACK = 1e-9


def _up(x: np.ndarray) -> np.ndarray:
    return x + np.abs(x) * SLACK


def _down(x: np.ndarray) -> np.ndarray:
    return x - np.abs(x) * SLACK


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances over the last axis."""
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


def _geometry(books: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per part and entry: how far it moved, how far any other moved at most, and half the distance to its nearest other."""
    k = books.shape[1]
    moved = np.zeros(books.shape[:2]) if before is None else _up(np.sqrt(_squared(books, before).astype(float)))
    others = np.zeros_like(moved)
    half = np.full(moved.shape, np.inf)
    if k > 1:
        apart = _squared(books[:, :, None], books[:, None, :]).astype(float)
        apart[:, np.arange(k), np.arange(k)] = np.inf
        half = _down(np.sqrt(apart.min(2)) / 2)
        top = np.sort(moved, 1)
        others = np.where(moved == top[:, -1:], top[:, -2:-1], top[:, -1:])
        others = np.where((moved == top[:, -1:]).sum(1, keepdims=True) > 1, top[:, -1:], others)
    return moved, others, half


def assign(x: np.ndarray, books: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray | None) -> int:
    """Move ``code``, ``upper`` and ``lower`` (rows, parts) in place to the entries ``books``; returns how many parts were scanned.

    ``x``: (rows, parts, width) integers. A part keeps its entry without a scan only if its upper bound is strictly below
    the lower bound of all others, or below half the way to the entry's nearest other: then no other entry ties.
    """
    moved, others, half = _geometry(books, before)
    scans = 0
    for p in range(books.shape[0]):
        own, up, low = code[:, p], upper[:, p], lower[:, p]
        up[:] = _up(up + moved[p][own])
        low[:] = _down(low - others[p][own])
        rows = np.flatnonzero(~(up < np.maximum(low, half[p][own])))
        # first the upper bound becomes exact; most parts need no more
        near = _squared(x[rows, p], books[p][own[rows]])
        up[rows] = _up(np.sqrt(near.astype(float)))
        rows = rows[~(up[rows] < np.maximum(low[rows], half[p][own[rows]]))]
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            every = _squared(x[some, p][:, None, :], books[p][None])
            best = every.argmin(1)  # the first of equals
            near = every[np.arange(len(some)), best]
            own[some] = best
            up[some] = _up(np.sqrt(near.astype(float)))
            if every.shape[1] > 1:
                every[np.arange(len(some)), best] = np.iinfo(np.int64).max
                low[some] = _down(np.sqrt(every.min(1).astype(float)))
            else:
                low[some] = np.inf
        scans += len(rows)
    return scans


def _ints(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), PARTS, width)


def _floats(column: pa.Array, fill: float) -> np.ndarray:
    if column.null_count:
        return np.full((len(column), PARTS), fill)
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), PARTS).copy()


@lean
def _round(batches: Iterator[pa.RecordBatch], books: np.ndarray, before: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """One assignment: the rows with their new entries and bounds, and at the end one row of sums: per part and entry its
    components' sums and its count, then the number of scans."""
    parts, k, width = books.shape
    sums = np.zeros((parts, k, width + 1), np.int64)
    scans, schema = 0, None
    for batch in batches:
        schema = batch.schema
        if not batch.num_rows:
            continue
        x = _ints(batch.column(2), width)
        raw = batch.column(3)
        code = np.zeros((len(x), parts), np.int64) if raw.null_count else np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(x), parts).astype(np.int64)
        upper, lower = _floats(batch.column(4), np.inf), _floats(batch.column(5), -np.inf)
        scans += assign(x, books, code, upper, lower, before)
        for p in range(parts):
            np.add.at(sums[p, :, :width], code[:, p], x[:, p])
            sums[p, :, width] += np.bincount(code[:, p], minlength=k)
        held = [pa.array([row.tobytes() for row in a], pa.binary()) for a in (code.astype(np.uint8), upper, lower)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *held, pa.nulls(len(x), pa.list_(pa.int64()))], names=schema.names)
    if schema is not None:
        total = [*sums.ravel().tolist(), scans]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in list(schema)[:6]], pa.array([total], pa.list_(pa.int64()))], names=schema.names)


@lean
def _code(batches: Iterator[pa.RecordBatch], books: np.ndarray, before: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The last assignment: code strings and exact errors."""
    parts, _, width = books.shape
    for batch in batches:
        x = _ints(batch.column(2), width)
        raw = batch.column(3)
        code = np.zeros((len(x), parts), np.int64) if raw.null_count else np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(len(x), parts).astype(np.int64)
        assign(x, books, code, _floats(batch.column(4), np.inf), _floats(batch.column(5), -np.inf), before)
        error = _squared(x, books[np.arange(parts)[None, :], code]).sum(1)
        text = pa.array([row.tobytes().hex() for row in code.astype(np.uint8)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array(error)], names=["vec_id", "label", "code", "error"])


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding and all its components are there and finite, as integers floor(SCALE * x)."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("embedding")).where(F.col("embedding").isNotNull() & finite)
    fits = F.transform("embedding", lambda v: F.when(F.abs(v) < LARGEST, F.floor(v * SCALE).cast("int")).otherwise(F.raise_error(F.lit(f"components must be below {LARGEST:.0f}")).cast("int")))
    none = F.lit(None).cast("binary")
    return rows.select("vec_id", "label", fits.alias("ints"), none.alias("code"), none.alias("upper"), none.alias("lower"), F.lit(None).cast("array<bigint>").alias("sums"))


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, scans: list[int] | None = None) -> DataFrame:
    """Codes of all vectors and the codebooks' digest.

    ``vectors``: vec_id (long), embedding (array of numbers), label; other columns are ignored, whatever their names.
    Rows with a null vector or a null or non-finite component are left out (nulls of vec_id and label are kept). Codebooks
    start from the ``entries`` smallest distinct vec_ids (fewer if there are fewer; of several vectors of one id from the
    least; a null id starts none). Repeated rows count and come out each; equal distances go to the lower entry; an empty
    table gives an empty result. All vectors must have one length, a multiple of 8, with components below 32768 (else an
    error says so). Each round reads the table of the one before and writes its own, which the next replaces.
    Returns vec_id, label, code, error, codebooks_sha256. ``scans``, if given, receives the scanned parts of each round.
    """
    spark = vectors.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/codes-{uuid.uuid4().hex}"
    start = kept_vectors(vectors)
    start.write.parquet(f"{where}/round=0")
    schema = start.schema
    now = spark.read.schema(schema).parquet(f"{where}/round=0")
    least, most = now.agg(F.min(F.size("ints")), F.max(F.size("ints"))).first()
    if least != most or (least or 0) % PARTS:
        raise ValueError(f"vectors have {least} to {most} components; they need one length, a multiple of {PARTS}")
    ids = [r[0] for r in now.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    seeds = sorted((r[0], r[1]) for r in now.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("ints")).collect()) if ids else []
    if not seeds:
        return now.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    width = least // PARTS
    books = np.array([v for _, v in seeds], np.int64).reshape(len(seeds), PARTS, width).transpose(1, 0, 2).copy()
    before: np.ndarray | None = None
    for number in range(1, rounds + 1):
        path = f"{where}/round={number}"
        now.mapInArrow(partial(_round, books=books, before=before), schema).write.parquet(path)
        remove(spark, f"{where}/round={number - 1}")
        both = spark.read.schema(schema).parquet(path)
        now = both.where("sums is null")
        # one row a task is summed where the rows are; 8 x 16 x (width + 1) totals reach the driver
        totals = dict(both.where("sums is not null").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
        flat = [int(totals[i]) for i in range(len(totals))]
        before, books = books, books.copy()
        for p in range(PARTS):
            for e in range(len(seeds)):
                own = flat[(p * len(seeds) + e) * (width + 1) : (p * len(seeds) + e + 1) * (width + 1)]
                if own[-1]:
                    books[p, e] = [s // own[-1] for s in own[:-1]]
        if scans is not None:
            scans.append(flat[-1])
    label = schema["label"].dataType.simpleString()
    coded = now.mapInArrow(partial(_code, books=books, before=before), f"vec_id long, label {label}, code string, error long")
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    return coded.withColumn("codebooks_sha256", F.lit(digest))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of ``embeddings`` with the error of each vector and of all of its label; see :func:`compress`."""
    coded = keep(compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")), "coded")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    found = coded.join(counted(labels), F.col("label").eqNullSafe(F.col("of")))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """DuckDB SQL with a full scan in every round."""
    near = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    ctes = [
        f"kept as materialized (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings "
        "where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        f"dims as (select max(len(v)) // {PARTS} as d from kept)",
        f"pieces as materialized (select rid, p, v[p * d + 1 : (p + 1) * d] as x from kept, dims, range({PARTS}) t(p))",
        f"seeds as (select v, row_number() over (order by vec_id) - 1 as e from (select vec_id, min(v) as v from kept where vec_id is not null group by vec_id order by vec_id limit {ENTRIES}))",
        f"b0 as materialized (select p, e, v[p * d + 1 : (p + 1) * d] as c from seeds, dims, range({PARTS}) t(p))",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} as materialized (select rid, p, any_value(x) as x, arg_min(e, {near}::hugeint * {ENTRIES} + e) as e, min({near}) as err from pieces join b{r} using (p) group by rid, p)")
        if r < ROUNDS:
            floor = "((s - ((s % n) + n) % n) // n)"
            ctes.append(f"m{r} as (select p, e, list({floor} order by i) as c from (select p, e, i, sum(x[i])::bigint as s, count(*) as n from a{r}, dims, range(1, d + 1) t(i) group by p, e, i) group by p, e)")
            ctes.append(f"b{r + 1} as materialized (select b{r}.p, b{r}.e, coalesce(m{r}.c, b{r}.c) as c from b{r} left join m{r} using (p, e))")
    ctes.append(f"digest as (select sha256(string_agg(c[i]::varchar, ',' order by p, e, i)) as codebooks_sha256 from b{ROUNDS}, dims, range(1, d + 1) t(i))")
    ctes.append(f"coded as (select vec_id, label, code, error from (select rid, string_agg(printf('%02x', e), '' order by p) as code, sum(err)::bigint as error from a{ROUNDS} group by rid) join kept using (rid))")
    return "with " + ", ".join(ctes) + " select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded, digest"


ORACLE = _sql()
