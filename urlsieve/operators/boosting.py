"""Leaf-wise boosted trees on histograms of binned features, for two classes.

One barrier stage grows a whole model: each task keeps its rows, binned to a byte a feature, and the tasks add up histograms of
the smaller children; the other children's are the differences. A gather takes about a second however little it sends, so with
several tasks all leaves that may yet be split are tried in one gather, and the best-first choice among them is made afterwards:
the same trees, in as many gathers as they are deep. Gradients are whole multiples of 2^-GRAIN, so sums don't depend on how rows
are dealt to tasks. A lost executor makes Spark run the stage anew.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.operators import gang, metrics

BINS, GRAIN = 256, 28
#: Rows from which more than one task grows a model, about 100 bytes each; rows whose histogram is counted at once.
ROWS, CHUNK = 2_000_000, 1 << 16
#: Models of a grid that are grown at the same time.
AT_ONCE = 12


@dataclass(frozen=True)
class Params:
    """Growth stops `patience` rounds after the least loss on validation rows, if there are any."""

    leaves: int = 31
    least_rows: int = 20
    rounds: int = 2000
    rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    patience: int = 50
    least_weight: float = 1e-3
    #: Of category splits: smoothing of their order, penalty, and the most categories on the smaller side.
    smooth: float = 10.0
    penalty: float = 10.0
    most: int = 32
    seed: int = 42


GRID = (Params(31, 20), Params(127, 50), Params(255, 100))


def bins(rows: DataFrame, numeric: Sequence[str], categories: Sequence[str] = ()) -> dict:
    """Cuts of numeric features, which values up to a cut are below, and numbers of the most frequent categories from 1; 0 are others and null.

    Up to 254 cuts are quantiles, as close as 1 in 20,000; a null value counts as below all.
    """
    at = [k / (BINS - 1) for k in range(1, BINS - 1)]
    spots = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 20_000).alias(c) for c in numeric]).first() if numeric else {}
    names = {c: [r[0] for r in rows.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(BINS - 1).collect()] for c in categories}
    return {"numeric": {c: sorted(set(spots[c] or ())) for c in numeric}, "categories": names}


def binned(made: dict, columns: list[np.ndarray | list]) -> np.ndarray:
    """A byte for each row and feature, from the columns of features in order."""
    n, out = len(columns[0]) if columns else 0, []
    for (_, cuts), x in zip(made["numeric"].items(), columns, strict=False):
        values = np.asarray(x, np.float64)
        out.append(np.where(np.isnan(values), 0, np.searchsorted(np.array(cuts), values, side="left")))
    for (_, names), x in zip(made["categories"].items(), columns[len(made["numeric"]) :], strict=True):
        number = {c: k for k, c in enumerate(names, 1)}
        out.append(np.fromiter((number.get(v, 0) for v in x), np.int64, n))
    return np.stack(out, axis=1).astype(np.uint8) if out else np.zeros((n, 0), np.uint8)


def _features(made: dict) -> list[str]:
    return [*made["numeric"], *made["categories"]]


def best_split(hist: np.ndarray, allowed: np.ndarray, n_numeric: int, p: Params) -> tuple[float, int, np.ndarray] | None:
    """(gain, feature, whether each bin goes left) of a leaf from its (feature, bin, [gradient, weight, rows]); the first of equal gains."""
    total = hist[0].sum(axis=0) if len(hist) else np.zeros(3)
    best: tuple[float, int, np.ndarray] | None = None

    def offer(feature: int | np.ndarray, left: np.ndarray, sides: Callable[[int], np.ndarray], penalty: float) -> None:
        nonlocal best
        right = total - left
        ok = (left[:, 2] >= p.least_rows) & (right[:, 2] >= p.least_rows) & (left[:, 1] >= p.least_weight) & (right[:, 1] >= p.least_weight)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[:, 0] ** 2 / (left[:, 1] + penalty) + right[:, 0] ** 2 / (right[:, 1] + penalty) - total[0] ** 2 / (total[1] + penalty)
        gain = np.where(ok, gain, -np.inf)
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
            best = float(gain[k]), int(feature if np.ndim(feature) == 0 else feature[k // (BINS - 1)]), sides(k)

    numeric = np.flatnonzero(allowed[:n_numeric])
    if len(numeric):
        # features one after the other, so that the first of equal gains is found as if each were searched by itself
        offer(numeric, hist[numeric].cumsum(axis=1)[:, :-1].reshape(-1, 3), lambda k: np.arange(BINS) <= k % (BINS - 1), 0.0)
    for f in np.flatnonzero(allowed):
        if f < n_numeric:
            continue
        used = np.flatnonzero(hist[f][:, 2] > 0)
        order = used[np.argsort(hist[f][used, 0] / (hist[f][used, 1] + p.smooth), kind="stable")]
        for way in (order, order[::-1]):
            few = way[: min(p.most, len(way) - 1)]
            offer(int(f), hist[f][few].cumsum(axis=0), lambda k, few=few: np.isin(np.arange(BINS), few[: k + 1]), p.penalty)
    return best


def _share(keys: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) for each row and round, from the row's own key."""
    x = keys.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xC2B2AE3D27D4EB4F) & 2**64 - 1)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * 2.0**GRAIN)


class Node:
    """A part of a tree's rows that may be split: its histogram, its best split, and its children if they were tried."""

    def __init__(self, number: int, hist: np.ndarray, allowed: np.ndarray, n_numeric: int, p: Params):
        self.number, self.hist, self.children = number, hist, None
        self.split = best_split(hist * np.array([2.0**-GRAIN, 2.0**-GRAIN, 1.0]), allowed, n_numeric, p)


def _best_first(root: Node, most: int) -> tuple[list[tuple[int, Node, int]], dict[int, int], Node | None]:
    """(leaf, node, new leaf) of the splits in order of gain, as far as nodes were tried; the leaf of each node that is one; the node to try next."""
    heap = [(-root.split[0], 0, root)] if root.split else []
    splits, leaves = [], {root.number: 0}
    while heap and len(splits) + 1 < most:
        _, leaf, node = heapq.heappop(heap)
        if not node.children:
            return splits, leaves, node
        splits.append((leaf, node, len(splits) + 1))
        del leaves[node.number]
        for child, k in zip(node.children, (leaf, len(splits)), strict=True):
            leaves[child.number] = k
            if child.split:
                heapq.heappush(heap, (-child.split[0], k, child))
    return splits, leaves, None


def grow(x: np.ndarray, y: np.ndarray, held: np.ndarray, keys: np.ndarray, n_numeric: int, p: Params, add: Callable[[np.ndarray], np.ndarray], alone: bool = True) -> dict:
    """A model from a task's rows (bins, labels, whether for validation, keys); `add` sums whole numbers over tasks."""
    features = x.shape[1]
    cells = features * BINS
    spots = np.arange(features) * BINS
    fit = ~held
    counts = add(np.array([fit.sum(), (fit & (y > 0)).sum(), held.sum()], np.int64))
    share = min(max(counts[1] / max(counts[0], 1), 1e-6), 1 - 1e-6)
    start = math.log(share / (1 - share))
    score = np.full(len(y), start)
    trees, history, gains = [], [], []

    def histogram(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros((cells, 3), np.int64)
        for k in range(0, len(rows), CHUNK):
            some = rows[k : k + CHUNK]
            at = (x[some] + spots).ravel()
            for c, w in enumerate((np.repeat(g[some], features), np.repeat(h[some], features), None)):
                out[:, c] += np.bincount(at, w, cells).astype(np.int64)
        return out

    def loss() -> int:
        z = np.where(y[held] > 0, score[held], -score[held])
        return int(_whole(np.logaddexp(0, -z)).sum())

    best, least = 0, math.inf
    for turn in range(p.rounds + 1):
        prob = 1 / (1 + np.exp(-score))
        g, h = _whole(prob - y), _whole(prob * (1 - prob))
        bag = fit & (_share(keys, p.seed, turn) < p.row_share) if p.row_share < 1 else fit
        # the last tree's loss goes with the next one's first histogram
        sums = add(np.append(histogram(np.flatnonzero(bag), g, h).ravel(), loss()))
        if trees and counts[2]:
            history.append(int(sums[-1]) * 2.0**-GRAIN / int(counts[2]))
            if history[-1] < least - 1e-12:
                least, best = history[-1], len(trees)
            if len(trees) - best >= p.patience:
                break
        if turn == p.rounds:
            break
        rng = np.random.default_rng([p.seed, turn])
        allowed = np.zeros(features, bool)
        allowed[rng.permutation(features)[: max(1, round(features * p.column_share))]] = True
        nodes = [Node(0, sums[:-1].reshape(features, BINS, 3), allowed, n_numeric, p)]
        of = np.zeros(len(y), np.int32)
        held_by = {0: np.arange(len(y), dtype=np.int32)}
        while True:
            splits, leaves, wanted = _best_first(nodes[0], p.leaves)
            if wanted is None:
                break
            tried = [wanted]
            if not alone:
                open_ = sorted((k for k in nodes if k.split and not k.children), key=lambda k: (-k.split[0], k.number))
                tried = list(dict.fromkeys([wanted, *open_[: p.leaves - 1]]))
            smaller, found = [], []
            for node in tried:
                _, f, left = node.split
                a, b = len(nodes) + 2 * len(smaller), len(nodes) + 2 * len(smaller) + 1
                own = held_by.pop(node.number)
                goes = left[x[own, f]]
                held_by[a], held_by[b] = own[goes], own[~goes]
                of[own] = np.where(goes, a, b)
                small = a if 2 * node.hist[f][left][:, 2].sum() <= node.hist[f][:, 2].sum() else b
                smaller.append((node, a, b, small))
                found.append(histogram(own[(goes if small == a else ~goes) & bag[own]], g, h))
            sums = add(np.concatenate(found)).reshape(-1, features, BINS, 3)
            for (node, a, b, small), hist in zip(smaller, sums, strict=True):
                node.children = tuple(Node(k, hist if k == small else node.hist - hist, allowed, n_numeric, p) for k in (a, b))
                nodes += node.children
        if not splits:
            break
        # nodes that were tried below a leaf belong to it
        leaf = np.zeros(len(nodes), np.int32)
        value = np.zeros(len(leaves))
        for number, k in leaves.items():
            node = nodes[number]
            below, (grad, weight, _) = [node], node.hist[0].sum(axis=0)
            value[k] = -p.rate * grad / max(weight, 1)
            while below:
                node = below.pop()
                leaf[node.number] = k
                below += node.children or ()
        score += value[leaf[of]]
        trees.append({"splits": [(k, node.split[1], np.packbits(node.split[2]).tobytes().hex(), new) for k, node, new in splits], "values": value.tolist()})
        gains.append(np.bincount([node.split[1] for _, node, _ in splits], [node.split[0] for _, node, _ in splits], features))
    kept = best if counts[2] else len(trees)
    total = np.sum(gains[:kept], axis=0) if kept else np.zeros(features)
    return {"start": start, "trees": trees[:kept], "history": history, "gains": total.tolist()}


def fit(rows: DataFrame, made: dict, p: Params = Params(), label: str = "label", key: str = "id", held: str | None = None, tasks: int | None = None) -> dict:
    """A model of `label` (0 or 1) on rows binned by `made`; `held` names a column that marks validation rows.

    Keys deal rows to bags and should be unique. Rows without a label don't count. No rows, or one class: no trees.
    """
    spark = rows.sparkSession
    names = _features(made)
    mark = F.col(held) if held else F.lit(False)
    rows = rows.where(F.col(label).isNotNull()).select(F.xxhash64(key).alias("_key"), F.col(label).cast("int").alias("_y"), mark.alias("_held"), *[F.col(c).cast("double") for c in made["numeric"]], *made["categories"])
    n = tasks or min(gang.TASKS, spark.sparkContext.defaultParallelism, rows.count() // ROWS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), binned(made, [c.to_numpy(zero_copy_only=False) if k < len(made["numeric"]) else c.to_pylist() for k, c in enumerate(b.columns[3:])])) for b in batches]
        keys, y, out, x = (np.concatenate([q[c] for q in parts]) if parts else None for c in range(4))
        if keys is None:
            keys, y, out, x = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool), np.zeros((0, len(names)), np.uint8)
        context = BarrierTaskContext.get()

        model = grow(x, y, out.astype(bool), keys, len(made["numeric"]), p, gang.summing(context, n), n == 1)
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_pydict({"model": [json.dumps(model)]})

    grown = rows.repartition(n, "_key").mapInArrow(run, "model string", barrier=True).collect()
    model = json.loads(grown[0].model) if grown else {"start": 0.0, "trees": [], "history": [], "gains": [0.0] * len(names)}
    return model | {"bins": made, "params": asdict(p)}


def tune(rows: DataFrame, made: dict, fold: str, grid: Sequence[Params] = GRID, label: str = "label", key: str = "id") -> tuple[dict, list[dict]]:
    """The model of the grid's best by mean average precision over folds (the first among equals), refitted on all rows with the mean number of trees.

    The models of all folds and parameters are grown side by side, the largest trees first.

    Each fold in turn is held out: trees stop by its loss, and its scores are judged. Also what was found of each in the grid.
    """
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())

    def tried(p: Params, f: int) -> tuple[float, int]:
        model = fit(rows.withColumn("_out", F.col(fold) == f), made, p, label, key, "_out")
        judged = scores(model, rows.where(F.col(fold) == f), label).select(label, F.round("probability", 9).alias("score"))
        return metrics.average_precision(metrics.tally(judged, label=label)).first()[0] or 0.0, len(model["trees"])

    # the models don't depend on each other, and each keeps one task busy
    with ThreadPoolExecutor(AT_ONCE) as pool:
        found = [[pool.submit(tried, p, f) for f in folds] for p in reversed(grid)]
    table = []
    for p, runs in zip(grid, reversed(found), strict=True):
        values, trees = zip(*(r.result() for r in runs), strict=True) if runs else ((), ())
        table.append({"params": p, "mean": float(np.mean(values)), "std": float(np.std(values)), "trees": max(1, round(float(np.mean(trees))))})
    best = max(range(len(table)), key=lambda k: (table[k]["mean"], -k))
    return fit(rows, made, replace(grid[best], rounds=table[best]["trees"]), label, key), table


class Forest:
    """A model's trees as tables: each node's feature, child by bin, and each leaf's value."""

    def __init__(self, model: dict):
        self.start, self.trees = model["start"], []
        for tree in model["trees"]:
            feature, child, depth = [0], np.zeros((0, BINS), np.int32), {0: 0}
            at, rows, names = {0: 0}, [], [0]
            # nodes are numbered as they come; a split's node gets two children for the leaf that stays and the new one
            for k, f, left, new in tree["splits"]:
                goes = np.unpackbits(np.frombuffer(bytes.fromhex(left), np.uint8)).astype(bool)
                node, a, b = at[k], len(names), len(names) + 1
                names += [k, new]
                feature += [0, 0]
                depth[a] = depth[b] = depth[node] + 1
                feature[node] = f
                rows.append((node, np.where(goes, a, b)))
                at[k], at[new] = a, b
            child = np.repeat(np.arange(len(names), dtype=np.int32)[:, None], BINS, axis=1)
            for node, to in rows:
                child[node] = to
            self.trees.append((np.array(feature), child, np.array(tree["values"])[names], max(depth.values())))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, child, value, depth in self.trees:
            node = np.zeros(len(x), np.int32)
            for _ in range(depth):
                node = child[node, x[rows, feature[node]]]
            out += value[node]
        return 1 / (1 + np.exp(-out))


def scores(model: dict, rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, probability) of rows, without a shuffle."""
    made = model["bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, n = Forest(model), len(keep)
        for b in batches:
            x = binned(made, [c.to_numpy(zero_copy_only=False) if k < len(made["numeric"]) else c.to_pylist() for k, c in enumerate(b.columns[n:])])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(forest(x) if x.shape[1] else np.full(b.num_rows, 1 / (1 + math.exp(-model["start"]))))], [*keep, "probability"])

    chosen = rows.select(*keep, *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(made["numeric"])], *[F.col(c).alias(f"_c{k}") for k, c in enumerate(made["categories"])])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[: len(keep)])
    return chosen.mapInArrow(run, kinds + ", probability double")


def importances(model: dict) -> list[tuple[str, float]]:
    """Each feature's share of all splits' gain in percent, most first."""
    gains = np.array(model["gains"])
    share = 100 * gains / max(gains.sum(), 1e-300)
    return sorted(zip(_features(model["bins"]), share.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
