"""Mini-batch K-means for several numbers of clusters in one pass over the rows.

Each centre is the mean of the points that it got so far: a batch moves it by the batch's share of its count. Every task goes
through its rows batch by batch from the same first centres; in the end each centre is the mean of the tasks' by their counts.
First centres come from a bounded sample: k-means++, the best of INITS tries by the sample's distances.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points in a batch, in the sample for the first centres, and tries.
BATCH, SAMPLE, INITS = 4096, 3 * 4096, 3


def _far(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points * points).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(axis=1)[None, :], 0.0)


def first_centres(points: np.ndarray, k: int, seed: int, tries: int = INITS) -> np.ndarray:
    """k of the points (repeated, if there are fewer distinct ones), each drawn by its squared distance from those before."""
    best, least = points[:0], np.inf
    for turn in range(tries):
        rng = np.random.default_rng([seed, k, turn])
        chosen = [int(rng.integers(len(points)))]
        near = _far(points, points[chosen])[:, 0]
        while len(chosen) < k:
            total = near.sum()
            chosen.append(int(np.searchsorted(near.cumsum(), rng.uniform() * total, side="right").clip(0, len(points) - 1)) if total > 1e-12 else int(rng.integers(len(points))))
            near = np.minimum(near, _far(points, points[chosen[-1:]])[:, 0])
        if near.sum() < least:
            best, least = points[chosen], near.sum()
    return best


def step(centres: np.ndarray, counts: np.ndarray, batch: np.ndarray) -> None:
    """Moves centres by a batch, in place: each to the mean of all points that it got so far."""
    of = _far(batch, centres).argmin(axis=1)
    n = np.bincount(of, minlength=len(centres))
    sums = np.zeros_like(centres)
    np.add.at(sums, of, batch)
    hit = n > 0
    counts += n
    centres[hit] += (sums[hit] - n[hit, None] * centres[hit]) / counts[hit, None]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame, ks: Sequence[int], vector: str, key: str = "id", batch: int = BATCH, seed: int = 42) -> dict[int, np.ndarray]:
    """Centres for each number of clusters, all from one pass; none where there are no rows. Null vectors don't count.

    Rows are dealt to tasks and ordered there by the key's hash, so that reruns agree; results depend on the number of
    tasks, as they do on the size of a batch. The sample for the first centres is of the rows of least hash.
    """
    rows = rows.where(F.col(vector).isNotNull()).select(F.xxhash64(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    held = rows.orderBy("_key").limit(SAMPLE).toPandas()
    if not len(held):
        return {}
    points = np.stack([np.asarray(v, np.float64) for v in held._v])
    start = {k: first_centres(points, k, seed) for k in ks}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = {k: c.copy() for k, c in start.items()}
        counts = {k: np.zeros(k, np.int64) for k in start}
        waiting = np.zeros((0, points.shape[1]))
        for b in batches:
            waiting = np.concatenate([waiting, _matrix(b.column(1))])
            while len(waiting) >= batch:
                for k in start:
                    step(centres[k], counts[k], waiting[:batch])
                waiting = waiting[batch:]
        if len(waiting):
            for k in start:
                step(centres[k], counts[k], waiting)
        out = [(k, c, int(counts[k][c]), centres[k][c].tolist()) for k in start for c in range(k) if counts[k][c]]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["k", "cluster", "n", "centre"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "_key").sortWithinPartitions("_key")
    found = dealt.mapInArrow(run, "k int, cluster int, n long, centre array<double>")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("k", "cluster"))
    means = found.withColumn("share", share).select("k", "cluster", F.posexplode(F.transform("centre", lambda x: x * F.col("share"))).alias("pos", "x"))
    means = means.groupBy("k", "cluster", "pos").agg(F.sum("x").alias("x")).toPandas()
    out = {k: c.copy() for k, c in start.items()}
    for (k, c), own in means.groupby(["k", "cluster"]):
        out[k][c] = own.sort_values("pos").x.to_numpy()
    return out


def assign(rows: DataFrame, centres: dict[int, np.ndarray], vector: str, name: str = "clusters") -> DataFrame:
    """rows with the nearest centre's number for each number of clusters, as an array in order of the numbers; ties go to the lower. No shuffle.

    A null vector gives null.
    """
    sets = [c for _, c in sorted(centres.items())]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            known = c.is_valid().to_numpy(zero_copy_only=False)
            points = _matrix(c.drop_null()) if known.any() else np.zeros((0, 1))
            near = [_far(points, s).argmin(axis=1) for s in sets] if len(points) else []
            ends = np.append(0, np.cumsum(known * len(sets))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.stack(near, axis=1).ravel().astype(np.int32) if near else np.zeros(0, np.int32)), mask=pa.array(~known))

    return rows.withColumn(name, F.arrow_udf(run, "array<int>")(F.col(vector).cast("array<double>")))
