"""A small autoencoder trained by mini-batches in one barrier stage, and its errors on rows.

Each task keeps its rows and takes Adam steps on its own batches; SYNCS times an epoch all tasks' weights are averaged, each
counting by its rows. With one task this is plain mini-batch training. A lost executor makes Spark run the stage anew.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.operators import gang

#: Averages an epoch; rows whose errors are worked out at once.
SYNCS, AT_ONCE = 4, 1 << 14


@dataclass(frozen=True)
class Params:
    """Training stops `patience` epochs after the least error on validation rows, if there are any."""

    hidden: Sequence[int] = (64, 32)
    middle: int = 8
    batch: int = 2048
    rate: float = 1e-3
    epochs: int = 60
    patience: int = 5
    seed: int = 42


def _sizes(n: int, p: Params) -> list[int]:
    down = [n, *p.hidden, p.middle]
    return [*down, *down[-2::-1]]


def _start(sizes: list[int], seed: int) -> list[np.ndarray]:
    """Weights and biases in turn, uniform within one over the root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(sizes, sizes[1:], strict=False):
        out += [rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
    return out


def _forward(weights: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """The inputs of all layers, and the output; all layers but the last have rectifiers."""
    layers = len(weights) // 2
    out = [x]
    for k in range(layers):
        z = out[-1] @ weights[2 * k] + weights[2 * k + 1]
        out.append(z if k == layers - 1 else np.maximum(z, 0.0))
    return out


def rebuilt_errors(weights: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The mean squared difference between each row and what is rebuilt of it."""
    parts = [((_forward(weights, x[s : s + AT_ONCE])[-1] - x[s : s + AT_ONCE]) ** 2).mean(axis=1) for s in range(0, len(x), AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def gradients(weights: list[np.ndarray], x: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean squared difference over rows and columns, and its slope by each weight."""
    states = _forward(weights, x)
    slope = 2 * (states[-1] - x) / x.size
    out: list[np.ndarray] = []
    for k in range(len(weights) // 2 - 1, -1, -1):
        out = [states[k].T @ slope, slope.sum(axis=0), *out]
        if k:
            slope = (slope @ weights[2 * k].T) * (states[k] > 0)
    return float(((states[-1] - x) ** 2).mean()), out


class Adam:
    def __init__(self, weights: list[np.ndarray], rate: float):
        self.rate, self.turn = rate, 0
        self.mean, self.square = ([np.zeros_like(w) for w in weights] for _ in range(2))

    def step(self, weights: list[np.ndarray], slopes: list[np.ndarray]) -> None:
        self.turn += 1
        for w, g, m, v in zip(weights, slopes, self.mean, self.square, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.999**self.turn)) + 1e-8)


def train(x: np.ndarray, val: np.ndarray, p: Params, add: Callable[[np.ndarray], np.ndarray], task: int = 0) -> dict:
    """Weights of the best epoch and the history, from a task's rows; all tasks get the same."""
    weights = _start(_sizes(x.shape[1], p), p.seed)
    adam, rng = Adam(weights, p.rate), np.random.default_rng([p.seed, task])
    n, n_val = add(np.array([len(x), len(val)], np.float64))
    history, best, least, stale = [], [w.copy() for w in weights], np.inf, 0
    for epoch in range(1, p.epochs + 1 if n else 1):
        order, total = rng.permutation(len(x)), 0.0
        for part in np.array_split(order, SYNCS):
            for s in range(0, len(part), p.batch):
                rows = x[part[s : s + p.batch]]
                loss, slopes = gradients(weights, rows)
                adam.step(weights, slopes)
                total += loss * len(rows)
            flat = add(np.concatenate([w.ravel() for w in weights]) * len(x)) / n
            at = 0
            for w in weights:
                w[...] = flat[at : at + w.size].reshape(w.shape)
                at += w.size
        seen, missed = add(np.array([total, rebuilt_errors(weights, val).sum()]))
        judged = missed / n_val if n_val else seen / n
        history.append({"epoch": epoch, "train_loss": float(seen / n), "val_loss": float(judged)})
        if judged < least:
            least, best, stale = judged, [w.copy() for w in weights], 0
        else:
            stale += 1
        if stale >= p.patience:
            break
    return {"weights": [w.tolist() for w in best], "history": history}


def fit(rows: DataFrame, vector: str, key: str = "id", held: str | None = None, p: Params = Params(), tasks: int | None = None) -> dict:
    """A model of an array column of finite numbers, all of one length; `held` names a column that marks validation rows.

    Rows are dealt to tasks by key and kept in memory there. No rows: the weights that training would have started from, for
    one column. Null vectors don't count.
    """
    spark = rows.sparkSession
    mark = F.col(held) if held else F.lit(False)
    rows = rows.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("_key"), mark.alias("_held"), F.col(vector).cast("array<double>").alias("_v"))
    n = tasks or min(gang.TASKS, spark.sparkContext.defaultParallelism, rows.count() // gang.ROWS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool), _matrix(b.column(2))) for b in batches]
        context = BarrierTaskContext.get()
        add = gang.summing(context, n)
        width = int(max(context.allGather(str(max((q[2].shape[1] for q in parts), default=0))), key=int))
        keys, out, x = (np.concatenate([q[c] for q in parts]) if parts else None for c in range(3))
        if x is None:
            keys, out, x = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, width))
        # the order of rows within a task is that of their keys, so that reruns agree
        order = np.argsort(keys, kind="stable")
        model = train(x[order][~out[order]], x[order][out[order]], p, add, context.partitionId())
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_pydict({"model": [json.dumps(model)]})

    found = rows.repartition(n, "_key").mapInArrow(run, "model string", barrier=True).collect()
    model = json.loads(found[0].model) if found else {"weights": [w.tolist() for w in _start(_sizes(1, p), p.seed)], "history": []}
    return model | {"params": asdict(p)}


def _matrix(column: pa.ListArray) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def errors(model: dict, rows: DataFrame, vector: str, name: str = "error") -> DataFrame:
    """rows with the mean squared difference between the vector and what the model rebuilds of it; null for a null vector. No shuffle."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = [np.array(w) for w in model["weights"]]
        for c in columns:
            known = c.is_valid().to_numpy(zero_copy_only=False)
            out = np.full(len(c), np.nan)
            if known.any():
                out[known] = rebuilt_errors(weights, _matrix(c.drop_null()))
            yield pa.array(out, mask=~known)

    return rows.withColumn(name, F.arrow_udf(run, "double")(F.col(vector).cast("array<double>")))
