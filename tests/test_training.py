"""The autoencoder and mini-batch K-means: slopes and steps against plain ones, and quality on held-out rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from urlsieve.operators import autoencoder, clusters, minibatch


def curved(n: int, seed: int) -> np.ndarray:
    """Points on a surface of three dimensions, bent through twelve."""
    rng = np.random.default_rng(seed)
    t = rng.uniform(-2, 2, (n, 3))
    mixed = np.concatenate([t, np.sin(2 * t), t**2 - 1.3, np.cos(t.sum(axis=1, keepdims=True) * [1, 2, 3])], axis=1)
    return mixed + rng.normal(0, 0.02, mixed.shape)


def test_slopes_equal_differences():
    rng = np.random.default_rng(1)
    weights, x = autoencoder._start([5, 4, 2, 4, 5], 3), rng.normal(size=(7, 5))
    loss, slopes = autoencoder.gradients(weights, x)
    assert loss == pytest.approx(autoencoder.rebuilt_errors(weights, x).mean())
    for w, g in zip(weights, slopes, strict=True):
        for spot in list(np.ndindex(w.shape))[::3]:
            w[spot] += 1e-6
            high = autoencoder.rebuilt_errors(weights, x).mean()
            w[spot] -= 2e-6
            low = autoencoder.rebuilt_errors(weights, x).mean()
            w[spot] += 1e-6
            assert g[spot] == pytest.approx((high - low) / 2e-6, abs=1e-5)


def test_autoencoder_beats_projection(spark):
    x, other = curved(4000, 1), curved(800, 2)
    rows = spark.createDataFrame([(k, v.tolist(), k % 10 == 0) for k, v in enumerate(x)], "id long, v array<double>, held boolean").repartition(3)
    p = autoencoder.Params(hidden=(32, 16), middle=3, batch=64, rate=3e-3, epochs=40)
    model = autoencoder.fit(rows, "v", held="held", p=p)
    losses = [h["val_loss"] for h in model["history"]]
    assert min(losses) < losses[0] / 4 and len(losses) <= 40
    test = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(other)] + [(900, None)], "id long, v array<double>")
    found = {r.id: r.error for r in autoencoder.errors(model, test, "v").collect()}
    assert found.pop(900) is None and len(found) == 800
    mean = x.mean(axis=0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    lost = (other - mean) - (other - mean) @ axes[:3].T @ axes[:3]
    assert np.mean(list(found.values())) < 0.7 * (lost**2).mean()
    assert autoencoder.fit(rows.repartition(5), "v", held="held", p=p)["weights"] == model["weights"]


def test_several_tasks_train_one_model(spark):
    x = curved(600, 3)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    p = autoencoder.Params(hidden=(16,), middle=3, batch=50, rate=5e-3, epochs=3)
    model = autoencoder.fit(rows, "v", p=p, tasks=2)
    losses = [h["train_loss"] for h in model["history"]]
    assert len(losses) == 3 and losses[-1] < losses[0]
    empty = autoencoder.fit(rows.limit(0), "v", p=p)
    assert empty["history"] == [] and autoencoder.errors(model, rows.limit(0), "v").count() == 0


def test_steps_are_running_means():
    rng = np.random.default_rng(5)
    centres, counts, seen = rng.normal(size=(3, 2)), np.zeros(3, np.int64), [[], [], []]
    for _ in range(6):
        batch = rng.normal(size=(40, 2))
        of = ((batch[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c, point in zip(of, batch, strict=True):
            seen[c].append(point)
        minibatch.step(centres, counts, batch)
    assert counts.tolist() == [len(s) for s in seen]
    assert np.allclose(centres, [np.mean(s, axis=0) for s in seen])


def test_one_pass_agrees_with_full_kmeans(spark):
    rng = np.random.default_rng(6)
    middles = rng.uniform(-9, 9, (6, 4))
    x = np.concatenate([rng.normal(m, 0.5, (700, 4)) for m in middles])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99999, None)], "id long, v array<double>").repartition(3)
    centres = minibatch.fit(rows, (2, 6, 100), "v", batch=256)
    assert {k: c.shape for k, c in centres.items()} == {2: (2, 4), 6: (6, 4), 100: (100, 4)}
    placed = minibatch.assign(rows, centres, "v").selectExpr("id", "v", "clusters[1] AS cluster").where("v IS NOT NULL")
    points = placed.select(array_to_vector("v").alias("f")).cache()
    full = min((KMeans(k=6, seed=s, featuresCol="f", predictionCol="label").fit(points) for s in range(4)), key=lambda m: m.summary.trainingCost)
    cells = clusters.contingency(full.transform(placed.withColumn("f", array_to_vector("v"))))
    assert clusters.external(cells).first().ari > 0.95
    true = clusters.contingency(placed.selectExpr("cluster", "id div 700 AS label"))
    assert clusters.external(true).first().ari > 0.95
    assert {k: c.tolist() for k, c in minibatch.fit(rows.repartition(7), (2, 6, 100), "v", batch=256).items()} == {k: c.tolist() for k, c in centres.items()}


def test_few_and_no_points(spark):
    rows = spark.createDataFrame([(k, [float(k % 2), 1.0]) for k in range(5)], "id long, v array<double>")
    centres = minibatch.fit(rows, (3,), "v")
    assert len(centres[3]) == 3
    assert {tuple(r.v): r.clusters for r in minibatch.assign(rows, centres, "v").collect()}.keys() == {(0.0, 1.0), (1.0, 1.0)}
    assert minibatch.fit(rows.limit(0), (3,), "v") == {}
