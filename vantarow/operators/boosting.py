"""Gradient boosted trees for two or more classes: softmax residuals, histograms, many models in one pass.

Features become bins once. Each pass of a level sums, in every task, the gradients of its rows by (model, class, node, feature,
bin); Spark adds the tasks' sums, and the driver, which sees only those, picks the splits. The trees of all classes and of all
models of a call (folds, settings) grow in the same passes, and the pass of a round's first level also writes each row's new
margins. Gradients are summed as fixed-point numbers, so a fit doesn't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantarow.sinks.store import remove, workspace

#: One is so many units of a fixed-point gradient.
UNIT = float(1 << 24)


@dataclass(frozen=True)
class Settings:
    """Of one model: rounds, depth of a tree, step, least hessian of a leaf, penalty of values, shares of rows and columns a round sees."""

    rounds: int = 20
    depth: int = 3
    rate: float = 0.3
    least: float = 1.0
    penalty: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    seed: int = 42


@dataclass
class Trees:
    """Complete binary trees in heap order: of a node i the children are 2i+1 and 2i+2; feature -1 is a leaf."""

    feature: np.ndarray  # (trees, nodes)
    cut: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray, cuts: bool = True) -> np.ndarray:
        """Values (rows, trees) of rows of features (or, without ``cuts``, of bins)."""
        out = np.zeros((len(x), len(self.feature)))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > self.cut[t, at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out[:, t] = self.value[t, at]
        return out


@dataclass
class Booster:
    """A fitted model: features in order, classes in order, settings and one round of trees (a tree a class) after the other."""

    columns: tuple[str, ...]
    labels: tuple[str, ...]
    settings: Settings
    rounds: list[Trees] = field(default_factory=list)

    def chances(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), len(self.labels)))
        for trees in self.rounds:
            total += trees.margins(x)
        return softmax(total)

    def to_dict(self) -> dict:
        return {"columns": list(self.columns), "labels": list(self.labels), "settings": asdict(self.settings), "rounds": [{k: getattr(t, k).tolist() for k in ("feature", "cut", "value")} for t in self.rounds]}

    @classmethod
    def from_dict(cls, raw: dict) -> Booster:
        rounds = [Trees(np.array(r["feature"], np.int64), np.array(r["cut"], float), np.array(r["value"], float)) for r in raw["rounds"]]
        return cls(tuple(raw["columns"]), tuple(raw["labels"]), Settings(**raw["settings"]), rounds)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def bin_cuts(train: DataFrame, columns: list[str], bins: int = 32) -> list[np.ndarray]:
    """At most ``bins`` - 1 cuts of each feature: distinct percentiles, by Spark's mergeable sketch."""
    shares = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    row = train.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in columns]).first()
    return [np.unique(np.array(row[c] or [], float)) for c in columns]


def _binned(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    zeros = np.zeros(width).tobytes()
    for batch in batches:
        x = [np.searchsorted(c, np.nan_to_num(batch.column(4 + i).to_numpy(zero_copy_only=False).astype(float), nan=-np.inf), "left") for i, c in enumerate(cuts)]
        table = np.stack(x, 1).astype(np.uint8) if x else np.zeros((batch.num_rows, 0), np.uint8)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in table], pa.binary()), pa.array([zeros] * batch.num_rows, pa.binary()), pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64())],
            names=_NAMES,
        )


_NAMES = ["draw", "fold", "label", "weight", "bins", "margins", "slot", "g", "h"]
_STATE = "draw long, fold int, label int, weight double, bins binary, margins binary, slot long, g long, h long"


def _seen(draw: np.ndarray, share: float, number: int, seed: int) -> np.ndarray:
    """Rows of a round: by a hash of their own key, so that any task draws alike."""
    if share >= 1:
        return np.ones(len(draw), bool)
    z = draw.astype(np.uint64) + np.uint64((seed * 1_000_003 + number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53) < share


def _pass(batches: Iterator[pa.RecordBatch], models: list[tuple], n_classes: int, n_bins: int, number: int, write: bool) -> Iterator[pa.RecordBatch]:
    """Sums of one level; ``models``: (settings, fold left out, trees of the last round or null, trees growing, nodes to sum).

    With ``write`` the last round's trees enter the margins first, and rows come out again beside the sums.
    """
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        draw, fold, label, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        raw = batch.column(4).to_pylist()
        x = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        margins = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.float64).reshape(len(raw), len(models), n_classes).copy()
        rows, features = np.arange(len(x)), x.shape[1]
        hot = np.eye(n_classes)[label]
        for m, (settings, left_out, last, growing, nodes) in enumerate(models):
            if write and last is not None:
                margins[:, m] += last.margins(x)
            if nodes is None:
                continue
            mine = np.flatnonzero((fold != left_out) & _seen(draw, settings.rows, number, settings.seed))
            if not len(mine):
                continue
            p = softmax(margins[mine, m])
            g = np.rint((p - hot[mine]) * weight[mine, None] * UNIT).astype(np.int64)
            h = np.rint(np.maximum(p * (1 - p), 1e-16) * weight[mine, None] * UNIT).astype(np.int64)
            for k in range(n_classes):
                at = np.zeros(len(mine), np.int64)
                for _ in range(settings.depth):
                    f = growing.feature[k, at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    at = np.where(inner, 2 * at + 1 + (x[mine, np.maximum(f, 0)] > growing.cut[k, at]), at)
                for node in nodes[k]:
                    some = np.flatnonzero(at == node)
                    if len(some):
                        slots = (np.arange(features) * n_bins + x[mine[some]]).ravel()
                        sums = np.zeros((2, features * n_bins), np.int64)
                        np.add.at(sums[0], slots, np.repeat(g[some, k], features))
                        np.add.at(sums[1], slots, np.repeat(h[some, k], features))
                        key = (m * n_classes + k) * 4096 + node
                        total[key] = total[key] + sums if key in total else sums
        if write:
            held = pa.array([r.tobytes() for r in margins], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], held, *[batch.column(i) for i in range(6, 9)]], names=_NAMES)
    for key, sums in sorted(total.items()):
        used = np.flatnonzero(sums[1])
        empty = [pa.nulls(len(used), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(key * (1 << 32) + used), pa.array(sums[0, used]), pa.array(sums[1, used])], names=_NAMES)


def _choose(g: np.ndarray, h: np.ndarray, settings: Settings, allowed: np.ndarray) -> tuple[int, int, float]:
    """Feature, bin and gain of the best split of a node by sums (features, bins); of equals the first. -1: none."""
    lam = settings.penalty
    gl, hl = np.cumsum(g, 1)[:, :-1] / UNIT, np.cumsum(h, 1)[:, :-1] / UNIT
    gs, hs = g[0].sum() / UNIT, h[0].sum() / UNIT
    gr, hr = gs - gl, hs - hl
    gain = gl**2 / (hl + lam) + gr**2 / (hr + lam) - gs**2 / (hs + lam)
    gain = np.where((hl >= settings.least) & (hr >= settings.least) & allowed[:, None], gain, -np.inf)
    best = int(np.argmax(gain))
    f, b = divmod(best, gain.shape[1])
    return (f, b, float(gain[f, b])) if np.isfinite(gain[f, b]) and gain[f, b] > 1e-9 else (-1, 0, 0.0)


def _allowed(settings: Settings, number: int, k: int, features: int) -> np.ndarray:
    """Features that a tree may use."""
    if settings.columns >= 1:
        return np.ones(features, bool)
    rng = np.random.default_rng([settings.seed, number, k])
    out = np.zeros(features, bool)
    out[rng.permutation(features)[: max(1, int(round(features * settings.columns)))]] = True
    return out


def fit_many(train: DataFrame, columns: list[str], plans: list[tuple[Settings, int]], key: list[str], label: str = "cause", weight: str | None = "weight", fold: str | None = None, bins: int = 32) -> list[Booster]:
    """A model for each (settings, fold left out; -1 for none), all grown in the same passes.

    ``train``: ``columns`` (numbers; null and NaN count as least), ``label`` (rows of a null label are left out), ``key``
    (names a row for its draws), and where named ``weight`` and ``fold``. Classes are ordered by name.
    """
    spark = train.sparkSession
    train = train.where(F.col(label).isNotNull())
    labels = tuple(r[0] for r in train.select(F.col(label).cast("string")).distinct().orderBy(label).collect())
    if not labels:
        raise ValueError("no labelled rows to fit on")
    cuts = bin_cuts(train, columns, bins)
    names = F.array(*[F.lit(x) for x in labels])
    rows = train.select(
        F.xxhash64(*key).alias("draw"), (F.col(fold).cast("int") if fold else F.lit(-2)).alias("fold"), (F.array_position(names, F.col(label).cast("string")) - 1).cast("int").alias("label"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(columns)],
    )
    features, n_classes = len(columns), len(labels)
    where = workspace(spark, "boosting")
    path = f"{where}/round=0"
    rows.mapInArrow(partial(_binned, cuts=cuts, width=len(plans) * n_classes), _STATE).write.parquet(path)
    state = spark.read.schema(_STATE).parquet(path)
    models = [Booster(tuple(columns), labels, settings) for settings, _ in plans]
    last: list[Trees | None] = [None] * len(plans)
    for number in range(max(s.rounds for s, _ in plans)):
        live = [number < s.rounds for s, _ in plans]
        nodes_of = [2 ** (s.depth + 1) - 1 for s, _ in plans]
        growing = [Trees(np.full((n_classes, n), -1, np.int64), np.zeros((n_classes, n)), np.zeros((n_classes, n))) for n in nodes_of]
        open_ = [[[0] for _ in range(n_classes)] if on else None for on in live]
        for level in range(max(s.depth for (s, _), on in zip(plans, live) if on)):
            todo = [(s, out, last[i], growing[i], open_[i] if live[i] and level < s.depth else None) for i, (s, out) in enumerate(plans)]
            made = state.mapInArrow(partial(_pass, models=todo, n_classes=n_classes, n_bins=bins, number=number, write=level == 0), _STATE)
            if level == 0:  # the margins after the last round are written with the first sums of this one
                after = f"{where}/round={number + 1}"
                made.write.parquet(after)
                both = spark.read.schema(_STATE).parquet(after)
                remove(spark, path)
                path, state, made = after, both.where("slot is null"), both.where("slot is not null")
            sums = made.where("slot is not null").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
            slot, g, h = (sums.column(i).to_numpy() for i in range(3))
            for i, (settings, _) in enumerate(plans):
                if todo[i][4] is None:
                    continue
                for k in range(n_classes):
                    allowed, further = _allowed(settings, number, k, features), []
                    for node in open_[i][k]:
                        mine = slot >> 32 == (i * n_classes + k) * 4096 + node
                        table = np.zeros((2, features * bins), np.int64)
                        table[0, slot[mine] & 0xFFFFFFFF], table[1, slot[mine] & 0xFFFFFFFF] = g[mine], h[mine]
                        tg, th = table.reshape(2, features, bins)
                        value = lambda a, b: -settings.rate * (a / UNIT) / (b / UNIT + settings.penalty)
                        if node == 0:
                            growing[i].value[k, 0] = value(tg[0].sum(), th[0].sum())
                        f, b, gain = _choose(tg, th, settings, allowed)
                        if f < 0:
                            continue
                        growing[i].feature[k, node], growing[i].cut[k, node] = f, b
                        lg, lh = tg[f, : b + 1].sum(), th[f, : b + 1].sum()
                        growing[i].value[k, 2 * node + 1] = value(lg, lh)
                        growing[i].value[k, 2 * node + 2] = value(tg[f].sum() - lg, th[f].sum() - lh)
                        further += [2 * node + 1, 2 * node + 2]
                    open_[i][k] = further
            if not any(any(o) for o in open_ if o is not None):
                break
        for i in range(len(plans)):
            last[i] = growing[i] if live[i] else None
            if live[i]:
                real = growing[i]
                cut = np.zeros_like(real.cut)
                for k, n in zip(*np.nonzero(real.feature >= 0)):
                    cut[k, n] = cuts[real.feature[k, n]][int(real.cut[k, n])]
                models[i].rounds.append(replace(real, cut=cut))
    remove(spark, where)
    return models


def fit(train: DataFrame, columns: list[str], key: list[str], settings: Settings = Settings(), label: str = "cause", weight: str | None = "weight") -> Booster:
    return fit_many(train, columns, [(settings, -1)], key, label, weight)[0]


def _verdict(model: Booster) -> Column:
    @F.pandas_udf("predicted string, confidence double")
    def verdict(*columns: pd.Series) -> pd.DataFrame:
        x = np.stack([np.nan_to_num(c.to_numpy(float), nan=-np.inf) for c in columns], 1)
        p = model.chances(x)
        best = p.argmax(1)
        return pd.DataFrame({"predicted": np.array(model.labels)[best], "confidence": p[np.arange(len(p)), best]})

    return verdict(*[F.col(c).cast("double") for c in model.columns])


def predict(model: Booster, rows: DataFrame) -> DataFrame:
    """``rows`` with the likeliest class (of equals the first by name) and its probability."""
    return rows.withColumn("__verdict", _verdict(model)).withColumns({"predicted": F.col("__verdict.predicted"), "confidence": F.col("__verdict.confidence")}).drop("__verdict")


def out_of_fold(models: list[tuple[int, int, Booster]], rows: DataFrame, fold: str = "fold") -> DataFrame:
    """Rows once per trial, with the verdict of the model that didn't see their fold; ``models``: (trial, fold left out, model)."""
    trials = sorted({t for t, _, _ in models})
    columns = models[0][2].columns
    by = {(t, f): m for t, f, m in models}

    @F.pandas_udf("array<string>")
    def verdicts(fold_of: pd.Series, *values: pd.Series) -> pd.Series:
        x = np.stack([np.nan_to_num(c.to_numpy(float), nan=-np.inf) for c in values], 1)
        out = np.full((len(x), len(trials)), None, object)
        for f in fold_of.unique():
            mine = np.flatnonzero(fold_of == f)
            for j, t in enumerate(trials):
                m = by[(t, int(f))]
                out[mine, j] = np.array(m.labels, object)[m.chances(x[mine]).argmax(1)]
        return pd.Series(list(out))

    told = rows.withColumn("__said", verdicts(F.col(fold), *[F.col(c).cast("double") for c in columns]))
    return told.select(*rows.columns, F.posexplode("__said").alias("__i", "predicted")).withColumn("trial", F.array(*[F.lit(t) for t in trials])[F.col("__i")]).drop("__i")
