"""Grouped cross-validation and a sequential search of parameters by Parzen estimators, with its trials as rows."""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantarow.operators import boosting
from vantarow.operators.boosting import Settings
from vantarow.operators.ranks import numbered

#: What is searched: least, most, and how it is drawn.
SPACE: dict[str, tuple[float, float, str]] = {
    "depth": (2, 4, "whole"), "rate": (0.02, 0.3, "log"), "rounds": (4, 12, "whole"), "rows": (0.6, 1.0, "even"), "columns": (0.5, 1.0, "even"), "least": (1, 12, "whole"), "penalty": (1e-3, 10.0, "log"),
}
#: Trials drawn at random before the estimators start; share of trials that count as good; candidates of a draw.
STARTS, GOOD, CANDIDATES = 4, 0.25, 24


def grouped_folds(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Fold of every group (group, n, fold): groups by falling size, dealt there and back, so folds weigh much alike.

    All rows of a group have one fold. Groups of one size go by their value.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(sizes, [F.col("n").desc(), F.col(group).asc()], "place")
    turn = F.pmod(F.col("place"), F.lit(2 * folds))
    return placed.select(group, "n", F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn).cast("int").alias("fold"))


def macro_f1_by(rows: DataFrame, by: list[str]) -> DataFrame:
    """Macro F1 of (cause, predicted) per group of ``by``: mean over the classes that occur on either side."""
    cells = rows.groupBy(*by, "cause", "predicted").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("cause") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("cause").alias("c"), F.col("n"), hit.alias("tp")), F.struct(F.col("predicted").alias("c"), F.col("n"), F.lit(0).cast("long").alias("tp")))
    f1 = cells.select(*by, F.explode(sides).alias("x")).groupBy(*by, "x.c").agg((2.0 * F.sum("x.tp") / F.sum("x.n")).alias("f1"))
    return f1.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def _draw(name: str, rng: np.random.Generator, good: list[float], bad: list[float]) -> float:
    """A value of one parameter: uniform at first, then the candidate that is likeliest among good trials against bad ones."""
    low, high, kind = SPACE[name]
    to, back = (np.log, np.exp) if kind == "log" else (float, float)
    a, b = to(low), to(high)
    if not good:
        value = rng.uniform(a, b)
    else:
        def density(x: np.ndarray, seen: list[float]) -> np.ndarray:
            centres = np.array([*map(to, seen), (a + b) / 2])
            width = np.append(np.full(len(seen), max((b - a) / max(2, len(seen) + 1), 1e-3 * (b - a))), b - a)
            return (np.exp(-(((x[:, None] - centres) / width) ** 2) / 2) / width).mean(1)

        centres = np.array([*map(to, good), (a + b) / 2])
        width = np.append(np.full(len(good), (b - a) / max(2, len(good) + 1)), b - a)
        pick = rng.integers(0, len(centres), CANDIDATES)
        x = np.clip(rng.normal(centres[pick], width[pick]), a, b)
        value = x[np.argmax(np.log(density(x, good) + 1e-12) - np.log(density(x, bad) + 1e-12))]
    out = float(back(value))
    return float(round(out)) if kind == "whole" else float(np.clip(round(out, 6), low, high))


def propose(log: list[tuple[int, dict, float]], number: int, seed: int = 42) -> dict:
    """Parameters of trial ``number`` from the trials that came before (number, parameters, score)."""
    rng = np.random.default_rng([seed, number])
    known = sorted(log, key=lambda r: (-r[2], r[0]))
    good = known[: max(1, int(np.ceil(GOOD * len(known))))] if len(known) >= STARTS else []
    bad = known[len(good) :] if good else []
    return {name: _draw(name, rng, [r[1][name] for r in good], [r[1][name] for r in bad]) for name in SPACE}


def as_settings(params: dict, seed: int = 42) -> Settings:
    whole = {k: int(v) if SPACE[k][2] == "whole" and k in ("depth", "rounds") else float(v) for k, v in params.items()}
    return replace(Settings(seed=seed), **whole)


def search(rows: DataFrame, columns: list[str], key: list[str], trials: int = 12, together: int = 4, folds: int = 5, seed: int = 42, log: DataFrame | None = None) -> DataFrame:
    """Trials (trial, params as JSON, folds, macro_f1, best): each scored by mean macro F1 over folds that keep groups whole.

    ``rows``: cause, weight, fold and ``columns``. ``together`` trials are proposed from one log and their fold models grown
    in the same passes. ``log``: an earlier result with the same seed is gone on from, so a search can be cut in two.
    """
    spark: SparkSession = rows.sparkSession
    known = [] if log is None else [(r["trial"], json.loads(r["params"]), r["macro_f1"]) for r in log.orderBy("trial").collect()]
    while len(known) < trials:
        first = len(known)
        asked = [(n, propose(known, n, seed)) for n in range(first, min(first + together, trials))]
        plans = [(as_settings(params, seed), f) for _, params in asked for f in range(folds)]
        models = boosting.fit_many(rows, columns, plans, key, fold="fold")
        named = [(n, f, models[i * folds + f]) for i, (n, _) in enumerate(asked) for f in range(folds)]
        scores = macro_f1_by(boosting.out_of_fold(named, rows), ["trial", "fold"]).groupBy("trial").agg(F.avg("macro_f1").alias("s"))
        found = {r["trial"]: r["s"] for r in scores.collect()}
        known += [(n, params, round(found[n], 9)) for n, params in asked]
    table = spark.createDataFrame([(n, json.dumps(p, sort_keys=True), folds, s) for n, p, s in known], "trial int, params string, folds int, macro_f1 double")
    return table.withColumn("best", F.row_number().over(Window.orderBy(F.desc("macro_f1"), "trial")) == 1)  # trials are few


def best_settings(log: DataFrame, seed: int = 42) -> Settings:
    return as_settings(json.loads(log.where("best").first()["params"]), seed)
