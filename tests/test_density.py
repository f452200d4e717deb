"""Density clusters against a definition by thresholds: components of the full matrix of mutual reachability."""

from __future__ import annotations

import numpy as np
import pytest

from urlsieve.operators import density


def parts(near: np.ndarray) -> list[np.ndarray]:
    of = np.arange(len(near))
    while True:
        least = np.where(near, of[None, :], len(near)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == of).all():
            return [np.flatnonzero(of == c) for c in np.unique(of)]
        of = least


def brute(points: np.ndarray, neighbours: int, least: int) -> np.ndarray:
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)).round(6)
    core = np.sort(far, axis=1)[:, min(neighbours, len(points)) - 1]
    reach = np.maximum(np.maximum(far, core[:, None]), core[None])
    label = np.full(len(points), -1)

    def split(own: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The distance at which these points come together, and the parts that they are in below it."""
        inner = reach[np.ix_(own, own)]
        levels = np.unique(inner)
        below = lambda t: parts((inner < t) | np.eye(len(own), dtype=bool))
        low, high = 0, len(levels) - 1  # in parts below the first level; together below those over the one sought
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(below(levels[mid])) > 1 else (low, mid - 1)
        return levels[low], [own[p] for p in below(levels[low])]

    def best(own: np.ndarray, born: float, root: bool) -> tuple[float, list[np.ndarray]]:
        """The most stable clusters among these points, and how stable they are together."""
        stability, members = 0.0, own
        while True:
            t, found = split(own)
            here = 1 / t if t > 0 else np.inf
            large = [p for p in found if len(p) >= least]
            if len(large) == 1:
                stability += (here - born) * (len(own) - len(large[0]))
                own = large[0]
                continue
            stability += (here - born) * len(own)
            inside = [best(p, here, False) for p in large]
            total = sum(x for x, _ in inside)
            if not root and stability >= total:
                return stability, [members]
            return total, [c for _, cs in inside for c in cs]

    for k, own in enumerate(sorted(best(np.arange(len(points)), 0.0, True)[1], key=lambda c: c[0])):
        label[own] = k
    return label


def cloud(seed: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    made = [rng.normal(m, s, (n // 4, 3)) for m, s in (((0, 0, 0), 0.3), ((4, 0, 0), 0.5), ((4, 1.5, 0), 0.2))]
    return np.concatenate([*made, rng.uniform(-3, 8, (n - 3 * (n // 4), 3))])


@pytest.mark.parametrize(("points", "least"), [
    (cloud(1, 500), 25), (cloud(2, 300), 10), (cloud(3, 200).round(0), 5), (np.repeat(cloud(4, 40), 12, axis=0), 8), (cloud(5, 30), 40),
])
def test_labels_equal_brute_force(spark, points, least):
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(3)
    sample = density.Sample(rows, 10)
    got = sample.clusters(least).toPandas().sort_values("id").cluster.to_numpy()
    assert got.tolist() == brute(points, 10, least).tolist()
    assert len(sample.edges) == len(points) - 1


def test_empty_single_and_too_many(spark):
    rows = spark.createDataFrame([(1, [0.5, 1.0])], "vec_id long, embedding array<double>")
    assert density.Sample(rows).clusters(5).first().cluster == -1
    assert density.Sample(rows.limit(0)).clusters(5).count() == 0
    with pytest.raises(ValueError, match="at most 0"):
        density.Sample(rows, most=0)
