"""Reconstruction networks on windows: a centred convolutional one and a recurrent one, trained by distributed gradient descent.

A step sums, in every task, the gradients of its windows; the sums travel in blocks, are added where each block meets, and
only the total, of the size of the network, reaches the driver. Which windows a step takes is a hash of their own key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantarow.operators import evaluate
from vantarow.operators.series import Geometry
from vantarow.operators.windows import window_arrays
from vantarow.sources.telemetry import METRICS

BLOCK = 512
CHUNK = 256


class Network:
    """Weights are one flat vector, cut into ``shapes``; windows come as (rows, time, metrics)."""

    name = ""
    shapes: list[tuple[int, ...]]

    def cut(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.shapes:
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape))
            at += n
        return out

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.shapes)

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.uniform(-1, 1, s) / np.sqrt(max(1, np.prod(s[:-1])))).ravel() if len(s) > 1 else np.zeros(s).ravel() for s in self.shapes])

    def given(self, x: np.ndarray) -> np.ndarray:
        """What the network sees of windows and has to give back."""
        return x

    def forward(self, flat: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        raise NotImplementedError

    def backward(self, flat: np.ndarray, held: list, d: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def errors(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Mean squared error of each window."""
        x = self.given(x)
        return ((self.forward(flat, x)[0] - x) ** 2).mean((1, 2))

    def loss(self, flat: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the windows' errors and its gradient."""
        x = self.given(x)
        y, held = self.forward(flat, x)
        gap = y - x
        return float((gap**2).mean((1, 2)).sum()), self.backward(flat, held, 2 * gap / (x.shape[1] * x.shape[2]))

    def score(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.errors(flat, x)


def _gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope, by the tanh form."""
    u = 0.7978845608028654 * (x + 0.044715 * x**3)
    t = np.tanh(u)
    return 0.5 * x * (1 + t), 0.5 * (1 + t) + 0.5 * x * (1 - t * t) * 0.7978845608028654 * (1 + 3 * 0.044715 * x * x)


class ConvNetwork(Network):
    """Two strided convolutions down to a quarter of a centred window, and two transposed ones back; the score is a root mean square."""

    name = "conv_autoencoder"

    def __init__(self, metrics: int, length: int, width: int = 16, latent: int = 8) -> None:
        if length % 4:
            raise ValueError("the window length must be a multiple of four")
        self.metrics, self.length, self.width, self.latent = metrics, length, width, latent
        # kernel, stride, padding, zeros between steps first, channels in and out, GELU after
        self.layers = [
            (5, 2, 2, False, metrics, width, True), (5, 2, 2, False, width, width, True), (3, 1, 1, False, width, latent, False),
            (4, 1, 2, True, latent, width, True), (4, 1, 2, True, width, width, True), (3, 1, 1, False, width, metrics, False),
        ]
        self.shapes = [s for k, _, _, _, a, b, _ in self.layers for s in ((k, a, b), (b,))]

    def spec(self) -> dict:
        return {"name": self.name, "metrics": self.metrics, "length": self.length, "width": self.width, "latent": self.latent}

    def given(self, x: np.ndarray) -> np.ndarray:
        return x - x.mean(1, keepdims=True)

    def forward(self, flat: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        weights, held = self.cut(flat), []
        for i, (k, stride, pad, between, _, _, bend) in enumerate(self.layers):
            if between:
                wide = np.zeros((len(x), 2 * x.shape[1] - 1, x.shape[2]))
                wide[:, ::2] = x
                x = wide
            padded = np.pad(x, ((0, 0), (pad, pad), (0, 0)))
            out = (padded.shape[1] - k) // stride + 1
            cols = np.stack([padded[:, j : j + stride * (out - 1) + 1 : stride] for j in range(k)], 2)
            y = np.einsum("ntka,kab->ntb", cols, weights[2 * i], optimize=True) + weights[2 * i + 1]
            slope = None
            if bend:
                y, slope = _gelu(y)
            held.append((cols, padded.shape, slope))
            x = y
        return x, held

    def backward(self, flat: np.ndarray, held: list, d: np.ndarray) -> np.ndarray:
        weights, grads = self.cut(flat), [None] * len(self.shapes)
        for i in range(len(self.layers) - 1, -1, -1):
            k, stride, pad, between, *_ = self.layers[i]
            cols, shape, slope = held[i]
            d = d if slope is None else d * slope
            grads[2 * i] = np.einsum("ntka,ntb->kab", cols, d, optimize=True)
            grads[2 * i + 1] = d.sum((0, 1))
            back = np.einsum("ntb,kab->ntka", d, weights[2 * i], optimize=True)
            padded = np.zeros(shape)
            for j in range(k):
                padded[:, j : j + stride * (d.shape[1] - 1) + 1 : stride] += back[:, :, j]
            d = padded[:, pad : shape[1] - pad]
            if between:
                d = d[:, ::2]
        return np.concatenate([g.ravel() for g in grads])

    def score(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.sqrt(self.errors(flat, x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class RecurrentNetwork(Network):
    """A long short-term memory reads a window into its last state; another one, given that state at every step, writes it back."""

    name = "lstm_autoencoder"

    def __init__(self, metrics: int, length: int, hidden: int = 16) -> None:
        self.metrics, self.length, self.hidden = metrics, length, hidden
        h = hidden
        self.shapes = [(metrics, 4 * h), (h, 4 * h), (4 * h,), (h, 4 * h), (h, 4 * h), (4 * h,), (h, metrics), (metrics,)]

    def spec(self) -> dict:
        return {"name": self.name, "metrics": self.metrics, "length": self.length, "hidden": self.hidden}

    def _read(self, x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
        n, length, _ = x.shape
        state, cell, out, held = np.zeros((n, self.hidden)), np.zeros((n, self.hidden)), [], []
        for t in range(length):
            i, f, g, o = np.split(x[:, t] @ w + state @ u + b, 4, 1)
            i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
            before, last = cell, state
            cell = f * cell + i * g
            tc = np.tanh(cell)
            state = o * tc
            held.append((i, f, g, o, before, tc, last))
            out.append(state)
        return np.stack(out, 1), held

    def _back(self, x: np.ndarray, held: list, d: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Through time: gradients of w, u, b and x, from those of all states."""
        gw, gu, gb, gx = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1]), np.zeros_like(x)
        later, dc = np.zeros(d[:, 0].shape), np.zeros(d[:, 0].shape)
        for t in range(len(held) - 1, -1, -1):
            i, f, g, o, before, tc, last = held[t]
            dh = d[:, t] + later
            dc = dc + dh * o * (1 - tc * tc)
            gates = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), dh * tc * o * (1 - o)], 1)
            gw += x[:, t].T @ gates
            gu += last.T @ gates
            gb += gates.sum(0)
            gx[:, t] = gates @ w.T
            later, dc = gates @ u.T, dc * f
        return gw, gu, gb, gx

    def forward(self, flat: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        w1, u1, b1, w2, u2, b2, wo, bo = self.cut(flat)
        read, first = self._read(x, w1, u1, b1)
        given = np.repeat(read[:, -1:], x.shape[1], 1)
        written, second = self._read(given, w2, u2, b2)
        return written @ wo + bo, [x, first, given, second, written]

    def backward(self, flat: np.ndarray, held: list, d: np.ndarray) -> np.ndarray:
        w1, u1, _, w2, u2, _, wo, _ = self.cut(flat)
        x, first, given, second, written = held
        go, gbo = np.einsum("nth,ntm->hm", written, d), d.sum((0, 1))
        gw2, gu2, gb2, back = self._back(given, second, d @ wo.T, w2, u2)
        states = np.zeros((len(x), x.shape[1], self.hidden))
        states[:, -1] = back.sum(1)
        gw1, gu1, gb1, _ = self._back(x, first, states, w1, u1)
        return np.concatenate([a.ravel() for a in (gw1, gu1, gb1, gw2, gu2, gb2, go, gbo)])


def network_of(spec: dict) -> Network:
    kinds = {ConvNetwork.name: ConvNetwork, RecurrentNetwork.name: RecurrentNetwork}
    return kinds[spec["name"]](**{k: v for k, v in spec.items() if k != "name"})


def flat_windows(points: DataFrame, g: Geometry, metrics=METRICS) -> DataFrame:
    """Windows (series_id, start, v: metric after metric) with ``draw``, the hash that deals them to steps."""
    return window_arrays(points, g, metrics).select("series_id", "start", F.flatten(F.array(*metrics)).alias("v"), F.xxhash64("series_id", "start").alias("draw"))


def _arrays(column: pa.Array, metrics: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), metrics, -1).transpose(0, 2, 1)


def _gradients(batches: Iterator[pa.RecordBatch], net: Network, flat: np.ndarray, epoch: int, step: int, steps: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the summed gradient of a task's windows of this step; block -1 holds their error and number."""
    total, error, n = np.zeros(net.size), 0.0, 0
    for batch in batches:
        draw = batch.column(1).to_numpy().astype(np.uint64)
        mine = np.flatnonzero(_turn(draw, epoch, steps) == step)
        if not len(mine):
            continue
        x = _arrays(batch.column(0).take(pa.array(mine)), net.metrics)
        for at in range(0, len(x), CHUNK):
            e, g = net.loss(flat, x[at : at + CHUNK])
            total, error, n = total + g, error + e, n + len(x[at : at + CHUNK])
    if n:
        blocks = [(-1, np.array([error, n]).tobytes()), *((i, total[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i in range(-(-net.size // BLOCK)))]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([v for _, v in blocks], pa.binary())], names=["block", "sums"])


def _turn(draw: np.ndarray, epoch: int, steps: int) -> np.ndarray:
    """The step of an epoch that takes a window."""
    z = draw + np.uint64(epoch * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((z ^ (z >> np.uint64(32))) % np.uint64(steps)).astype(np.int64)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            values = np.frombuffer(raw)
            total[b] = total[b] + values if b in total else values
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "sums"])


def _step(windows: DataFrame, net: Network, flat: np.ndarray, epoch: int, step: int, steps: int) -> tuple[np.ndarray, float, int]:
    schema = "block int, sums binary"
    made = windows.select("v", "draw").mapInArrow(partial(_gradients, net=net, flat=flat, epoch=epoch, step=step, steps=steps), schema)
    table = made.repartition("block").mapInArrow(_added, schema).toArrow()
    parts = dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
    if -1 not in parts:
        return np.zeros(net.size), 0.0, 0
    error, n = np.frombuffer(parts.pop(-1))
    return np.concatenate([np.frombuffer(parts[i]) for i in sorted(parts)]) / n, float(error / n), int(n)


@dataclass
class Descent:
    """How to train: epochs, steps an epoch, rate (falling by a cosine or constant), decay of weights, largest gradient, patience."""

    epochs: int = 12
    steps: int = 4
    rate: float = 1e-2
    cosine: bool = True
    decay: float = 1e-4
    largest: float | None = 1.0
    patience: int | None = None
    seed: int = 42


@dataclass
class Fitted:
    net: Network
    flat: np.ndarray
    epoch: int
    history: list[dict] = field(default_factory=list)

    def body(self) -> dict:
        return {"net": self.net.spec(), "weights": self.flat.tolist(), "epoch": self.epoch}

    @classmethod
    def from_body(cls, body: dict) -> Fitted:
        return cls(network_of(body["net"]), np.array(body["weights"]), body["epoch"])


def scores(fitted: Fitted, windows: DataFrame) -> DataFrame:
    """Score of every window (series_id, start, score, and what else ``windows`` has beside v and draw)."""
    net, flat = fitted.net, fitted.flat

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x = np.stack(v.to_numpy()).astype(float).reshape(len(v), net.metrics, -1).transpose(0, 2, 1)
        return pd.Series(np.concatenate([net.score(flat, x[at : at + CHUNK]) for at in range(0, len(x), CHUNK)]))

    return windows.withColumn("score", score("v")).drop("v", "draw")


def descend(net: Network, windows: DataFrame, judge, how: Descent = Descent()) -> Fitted:
    """Train on ``windows`` (v, draw) by Adam with decoupled decay; ``judge(fitted)`` gives an epoch's figures, the first of which, the
    lower the better, chooses the epoch that is kept. With ``patience``, training ends when the figure hasn't fallen for so many epochs.
    """
    spark = windows.sparkSession
    flat = net.start(how.seed)
    first, second, taken = np.zeros(net.size), np.zeros(net.size), 0
    best: Fitted | None = None
    history: list[dict] = []
    for epoch in range(1, how.epochs + 1):
        rate = how.rate * ((1 + np.cos(np.pi * (epoch - 1) / how.epochs)) / 2 if how.cosine else 1.0)
        losses, seen = 0.0, 0
        for step in range(how.steps):
            g, error, n = _step(windows, net, flat, epoch, step, how.steps)
            if not n:
                continue
            losses, seen = losses + error * n, seen + n
            norm = float(np.sqrt((g**2).sum()))
            if how.largest is not None and norm > how.largest:
                g = g * (how.largest / norm)
            taken += 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            flat = flat * (1 - rate * how.decay) - rate * (first / (1 - 0.9**taken)) / (np.sqrt(second / (1 - 0.999**taken)) + 1e-8)
        if not seen:
            raise ValueError("too few windows to train on")
        now = Fitted(net, flat, epoch)
        figures = judge(now)
        history.append({"epoch": epoch, "rate": float(rate), "train": float(losses / seen), **figures})
        chosen = next(iter(figures))
        if best is None or figures[chosen] < min(h[chosen] for h in history[:-1]):
            best = now
        if how.patience is not None:
            errors = spark.createDataFrame([("run", h["epoch"], float(h[chosen])) for h in history], "run string, epoch int, error double")
            waited = evaluate.patience(errors).where(F.col("epoch") == epoch).first()["waited"]
            if waited >= how.patience:
                break
    best.history = history
    return best


def fit_conv(normal: DataFrame, metrics: int, length: int, how: Descent = Descent(), every: int = 10, **shape) -> Fitted:
    """The convolutional network on normal windows; a tenth, chosen by hash, is never trained on and chooses the epoch."""
    held = F.pmod("draw", F.lit(every)) == 0
    out = normal.where(held)

    def judge(now: Fitted) -> dict:
        error = scores(now, out).agg(F.avg(F.col("score") * F.col("score")).alias("e")).first()["e"]
        return {"holdout": float("inf") if error is None else float(error)}

    return descend(ConvNetwork(metrics, length, **shape), normal.where(~held), judge, how)


CRITERIA = ("over_normal", "average_precision", "over_all")


def fit_recurrent(normal: DataFrame, validation: DataFrame, metrics: int, length: int, criterion: str = "over_normal", how: Descent = Descent(cosine=False, decay=0.0, largest=None, patience=4), **shape) -> Fitted:
    """The recurrent network on normal windows; ``validation`` (v, draw, label) chooses the epoch by one of ``CRITERIA``.

    Mean error over normal windows, over all, or average precision (taken negative, so that lower is better; 0 where undefined).
    """
    order = [criterion, *[c for c in CRITERIA if c != criterion]]

    def judge(now: Fitted) -> dict:
        row = evaluate.selection_criterion(scores(now, validation)).first()
        worst = float("inf")
        found = {"over_normal": row["over_normal"], "over_all": row["over_all"], "average_precision": None if row["average_precision"] is None else -row["average_precision"]}
        return {c: (0.0 if c == "average_precision" else worst) if found[c] is None else float(found[c]) for c in order}

    return descend(RecurrentNetwork(metrics, length, **shape), normal, judge, how)


def chosen_epochs(history: list[dict]) -> dict[str, int]:
    """Epoch that each criterion of a history would keep: the first of its best."""
    kinds = [k for k in history[0] if k in (*CRITERIA, "holdout")]
    return {k: min(history, key=lambda h: (h[k], h["epoch"]))["epoch"] for k in kinds}
