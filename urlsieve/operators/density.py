"""Density clusters of a bounded sample: core distances and a spanning tree by blocks in Spark, then the condensed tree.

Points that merge at one distance merge at once, however many they are, so that ties leave no choice: the result depends on
the points alone, not on their order or on which of several spanning trees was found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points in a sample, by default; rows compared with all points at once.
MOST, BLOCK = 30_000, 256
#: Cluster of points that are in none.
NOISE = -1
#: Decimals of distances: points nearer than half of the last count as one.
DECIMALS = 6


def _distances(some: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (some * some).sum(axis=1)[:, None] - 2 * some @ points.T + (points * points).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(square, 0.0)).round(DECIMALS)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for batch in batches:
        own = batch.id.to_numpy()
        for k in range(0, len(own), BLOCK):
            yield own[k : k + BLOCK]


def _every(spark: SparkSession, n: int) -> DataFrame:
    """Row numbers, in as many tasks as there are blocks, but for no more than run at once."""
    return spark.range(0, n, 1, max(1, min(n // BLOCK, 4 * spark.sparkContext.defaultParallelism)))


def core_distances(spark: SparkSession, points: np.ndarray, neighbours: int) -> np.ndarray:
    """Each point's distance to its neighbour of that number, itself being the first; with fewer points, to the farthest."""
    k = min(neighbours, len(points)) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _blocks(batches):
            yield pd.DataFrame({"id": part, "core": np.partition(_distances(points[part], points), k, axis=1)[:, k]})

    found = _every(spark, len(points)).mapInPandas(run, "id long, core double").toPandas()
    return found.sort_values("id").core.to_numpy()


def spanning_tree(spark: SparkSession, points: np.ndarray, core: np.ndarray) -> pd.DataFrame:
    """(a, b, distance): edges of a least spanning tree by mutual reachability, the largest of a distance and both core distances.

    Boruvka rounds: each point's nearest one in another component, then the nearest of each component, which joins them. The
    number of components at least halves in a round.
    """
    n = len(points)
    component, edges = np.arange(n), []
    while len(np.unique(component)) > 1:

        def run(batches: Iterator[pd.DataFrame], component: np.ndarray = component) -> Iterator[pd.DataFrame]:
            for part in _blocks(batches):
                far = np.maximum(np.maximum(_distances(points[part], points), core[part][:, None]), core[None, :])
                far[component[part][:, None] == component[None, :]] = np.inf
                to = far.argmin(axis=1)
                yield pd.DataFrame({"component": component[part], "distance": far[np.arange(len(part)), to], "a": np.minimum(part, to), "b": np.maximum(part, to)})

        nearest = _every(spark, n).mapInPandas(run, "component long, distance double, a long, b long")
        best = nearest.groupBy("component").agg(F.min(F.struct("distance", "a", "b")).alias("e")).select("e.*").distinct().toPandas()
        # edges are ordered by distance and ends, so those that components choose make no cycle
        root = {int(c): int(c) for c in np.unique(component)}

        def find(c: int, root: dict[int, int] = root) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for distance, a, b in best.sort_values(["distance", "a", "b"]).itertuples(index=False):
            x, y = find(int(component[a])), find(int(component[b]))
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((a, b, distance))
        component = np.array([find(int(c)) for c in component])
    return pd.DataFrame(edges, columns=["a", "b", "distance"])


def merges(edges: pd.DataFrame, n: int) -> tuple[list[list[int]], list[float], np.ndarray]:
    """Nodes of the single-linkage tree: children (points are 0 to n - 1, nodes follow), distances and sizes; the last is the root.

    Points and nodes that meet at one distance have one parent.
    """
    top, node_of = list(range(n)), list(range(n))
    children: list[list[int]] = [[] for _ in range(n)]
    at, size = [0.0] * n, [1] * n

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a, b, distance in edges.sort_values("distance", kind="stable").itertuples(index=False):
        x, y = find(int(a)), find(int(b))
        p, q = node_of[x], node_of[y]
        open_ = [m for m in (p, q) if m >= n and at[m] == distance]
        if open_:
            node = open_[0]
            for m in (p, q):
                if m != node:
                    children[node] += children[m] if m in open_ else [m]
        else:
            node = len(children)
            children.append([p, q])
            at.append(distance)
            size.append(0)
        size[node] = size[p] + size[q]
        top[x] = y
        node_of[y] = node
    # nodes that were taken up by another of their distance are left out
    used, out = {}, []
    stack = [node_of[find(0)]] if n else []
    while stack:
        m = stack.pop()
        out.append(m)
        stack += [c for c in children[m] if c >= n]
    for k, m in enumerate(reversed(out)):
        used[m] = n + k if m >= n else m
    kept = [m for m in reversed(out) if m >= n]
    return [[used.get(c, c) for c in children[m]] for m in kept], [at[m] for m in kept], np.array([1] * n + [size[m] for m in kept])


def condensed(children: list[list[int]], at: list[float], size: np.ndarray, n: int, least: int) -> tuple[np.ndarray, list[float], list[int]]:
    """(cluster of each point, stability of each cluster, parent of each cluster), clusters numbered from the root, 0, down.

    Going down, a cluster splits where two or more parts have `least` points; smaller parts fall out of it. A point counts for
    the last cluster that held it, with 1 / distance of its fall less that of the cluster's birth.
    """
    last = np.zeros(n, np.int64)
    stability, born, parent = [0.0], [0.0], [-1]
    if not children:
        return last, stability, parent
    stack = [(n + len(children) - 1, 0)]
    while stack:
        node, cluster = stack.pop()
        here = 1.0 / at[node - n] if at[node - n] > 0 else np.inf
        large = [c for c in children[node - n] if size[c] >= least]
        own = here - born[cluster]
        for c in children[node - n]:
            if size[c] >= least and len(large) == 1:
                stack.append((c, cluster))
                continue
            stability[cluster] += own * int(size[c])
            to = cluster
            if size[c] >= least:
                to = len(stability)
                stability.append(0.0)
                born.append(here)
                parent.append(cluster)
                stack.append((c, to))
            else:
                inside = [c]
                while inside:
                    x = inside.pop()
                    if x < n:
                        last[x] = to
                    else:
                        inside += children[x - n]
    return last, stability, parent


def chosen(stability: list[float], parent: list[int]) -> list[int]:
    """The cluster that each cluster's points belong to: of a cluster and those inside it, whichever are more stable; never the root."""
    best, picked = list(stability), [False] * len(stability)
    inside = [0.0] * len(stability)
    has = [False] * len(stability)
    for c in range(len(stability) - 1, 0, -1):
        picked[c] = not has[c] or stability[c] >= inside[c]
        best[c] = stability[c] if picked[c] else inside[c]
        inside[parent[c]] += best[c]
        has[parent[c]] = True
    of = [NOISE] * len(stability)
    for c in range(1, len(stability)):
        of[c] = of[parent[c]] if of[parent[c]] != NOISE else c if picked[c] else NOISE
    return of


def labels_of(edges: pd.DataFrame, n: int, least: int) -> np.ndarray:
    """Clusters of points from the edges of their spanning tree, numbered by their first points; NOISE for those in none."""
    if n < 2:
        return np.full(n, NOISE, np.int64)
    last, stability, parent = condensed(*merges(edges, n), n, max(2, least))
    of = np.array(chosen(stability, parent))[last]
    out = np.full(n, NOISE, np.int64)
    found, first = np.unique(of[of != NOISE], return_index=True)
    spots = np.flatnonzero(of != NOISE)[first]
    for k, c in enumerate(found[np.argsort(spots)]):
        out[of == c] = k
    return out


class Sample:
    """A bounded sample's points with their spanning tree, from which clusters of any least size come without more distances.

    `rows` has a unique id and an array of numbers; more than `most` rows, which bounds what tasks and the driver hold, and
    null or non-finite numbers are errors. Points are in order of id.
    """

    def __init__(self, rows: DataFrame, neighbours: int = 10, most: int = MOST, id_col: str = "vec_id", vector: str = "embedding"):
        held = rows.select(F.col(id_col).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).limit(most + 1).toPandas().sort_values("i")
        if len(held) > most:
            raise ValueError(f"at most {most} points are clustered; others take the cluster of their nearest one")
        self.spark, self.ids = rows.sparkSession, held.i.to_numpy()
        self.points = np.stack([np.asarray(v, np.float64) for v in held.v]) if len(held) else np.zeros((0, 1))
        if not np.isfinite(self.points).all():
            raise ValueError("points to cluster must be finite numbers")
        self.core = core_distances(self.spark, self.points, neighbours) if len(held) else np.zeros(0)
        self.edges = spanning_tree(self.spark, self.points, self.core)

    def clusters(self, least: int) -> DataFrame:
        """(id, vector, cluster) of the sample: NOISE where a point is in no cluster of `least` points."""
        frame = pd.DataFrame({"id": self.ids, "vector": self.points.tolist(), "cluster": labels_of(self.edges, len(self.ids), least)})
        return self.spark.createDataFrame(frame, "id long, vector array<double>, cluster long")
