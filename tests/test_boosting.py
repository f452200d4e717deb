"""Leaf-wise trees against a plain best-first search over raw values, and their quality against level-wise ones."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlsieve.operators import boosting, metrics, models

ALL = boosting.Params(leaves=8, least_rows=5, rounds=3, row_share=1.0, column_share=1.0)


def table(spark, n: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n).round(2), rng.integers(0, 6, n), rng.uniform(size=n).round(2)
    tld = rng.choice(["com", "net", "xyz", "top", "", "org"], n, p=[0.4, 0.2, 0.15, 0.1, 0.05, 0.1])
    logit = np.where(a > 0.3, 2.0, -1.5) * np.where(b > 2, 1, -1) + np.isin(tld, ["xyz", "top"]) * 1.5 + np.sin(6 * c)
    y = (rng.uniform(size=n) < 1 / (1 + np.exp(-logit))).astype(int)
    rows = [(k, float(a[k]), int(b[k]), float(c[k]), str(tld[k]) if k % 50 else None, int(y[k])) for k in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b int, c double, tld string, label int")


def brute(x: np.ndarray, y: np.ndarray, p: boosting.Params) -> tuple[list, np.ndarray]:
    """(leaf, feature, greatest value on the left, new leaf) of each tree's splits, and the scores."""
    share = y.mean()
    score = np.full(len(y), math.log(share / (1 - share)))
    trees = []
    for _ in range(p.rounds):
        prob = 1 / (1 + np.exp(-score))
        g, h = prob - y, prob * (1 - prob)
        leaf, splits = np.zeros(len(y), int), []
        while len(splits) + 1 < p.leaves:
            best = None
            for k in range(len(splits) + 1):
                own = np.flatnonzero(leaf == k)
                for f in range(x.shape[1]):
                    for cut in np.unique(x[own, f])[:-1]:
                        left = x[own, f] <= cut
                        if min(left.sum(), (~left).sum()) < p.least_rows:
                            continue
                        gain = sum(g[own][s].sum() ** 2 / h[own][s].sum() for s in (left, ~left)) - g[own].sum() ** 2 / h[own].sum()
                        if best is None or gain > best[0] + 1e-7:
                            best = gain, k, f, cut
            if best is None or best[0] <= 1e-9:
                break
            _, k, f, cut = best
            splits.append((k, f, cut, len(splits) + 1))
            leaf[(leaf == k) & (x[:, f] > cut)] = len(splits)
        for k in range(len(splits) + 1):
            score[leaf == k] -= p.rate * g[leaf == k].sum() / h[leaf == k].sum()
        trees.append(splits)
    return trees, score


def test_splits_equal_brute_force(spark):
    rows = table(spark, 240)
    made = boosting.bins(rows, ["a", "b", "c"])
    model = boosting.fit(rows, made, ALL)
    held = rows.toPandas().sort_values("id")
    x = held[["a", "b", "c"]].to_numpy(float)
    trees, score = brute(x, held.label.to_numpy(), ALL)
    assert len(model["trees"]) == len(trees) == 3
    for tree, want in zip(model["trees"], trees, strict=True):
        assert len(tree["splits"]) == len(want) == 7
        leaf, plain = np.zeros(len(x), int), np.zeros(len(x), int)
        for (k, f, left, new), (k2, f2, cut, new2) in zip(tree["splits"], want, strict=True):
            assert (k, f, new) == (k2, f2, new2)
            goes = np.unpackbits(np.frombuffer(bytes.fromhex(left), np.uint8)).astype(bool)[boosting.binned(made, list(x.T))[:, f]]
            leaf[(leaf == k) & ~goes] = new
            plain[(plain == k) & (x[:, f] > cut)] = new
        assert (leaf == plain).all()
    got = boosting.scores(model, rows, "id").toPandas().sort_values("id").probability.to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-score)), atol=1e-6)


def test_tasks_and_order_make_no_difference(spark):
    rows = table(spark, 900)
    made = boosting.bins(rows, ["a", "b", "c"], ["tld"])
    p = boosting.Params(rounds=3, leaves=9)
    one, three = boosting.fit(rows, made, p, tasks=1), boosting.fit(rows.orderBy("c"), made, p, tasks=3)
    assert one == three and len(one["trees"]) == 3
    assert sum(x for _, x in boosting.importances(one)) == pytest.approx(100)
    assert {f for t in one["trees"] for _, f, _, _ in t["splits"]} == {0, 1, 2, 3}


def test_stops_by_validation_and_beats_level_wise_trees(spark):
    rows = table(spark, 6000).fillna("", ["tld"])
    rows = rows.selectExpr("*", "pmod(xxhash64(id), 5) AS part", "pmod(xxhash64(id), 3) AS fold")
    fit, test = rows.where("part > 0").cache(), rows.where("part = 0").cache()
    made = boosting.bins(fit, ["a", "b", "c"], ["tld"])
    best, found = boosting.tune(fit, made, "fold", (boosting.Params(15, 20, patience=10), boosting.Params(63, 50, patience=10)))
    assert all(10 < f["trees"] < 400 for f in found) and len(best["trees"]) in {f["trees"] for f in found}

    def judged(scored):
        return metrics.average_precision(metrics.tally(scored.selectExpr("label", "round(p, 9) AS score"))).first()[0]

    own = judged(boosting.scores(best, test, "label").selectExpr("label", "probability AS p"))
    logged = [t.selectExpr("*", "a AS log_a", "b AS log_b", "c AS log_c") for t in (fit, test)]
    level = models.score(models.trees(("a", "b", "c"), 40, 5).fit(logged[0]), logged[1], "label").selectExpr("label", "phishing_probability AS p")
    assert own > judged(level) > 0.7


def test_nothing_to_learn(spark):
    rows = table(spark, 30)
    made = boosting.bins(rows, ["a"], ["tld"])
    for some in (rows.limit(0), rows.where("label = 1"), rows.selectExpr("id", "a", "tld", "CAST(NULL AS INT) AS label")):
        model = boosting.fit(some, made, ALL)
        assert model["trees"] == [] and boosting.scores(model, rows, "id").count() == 30
    assert boosting.scores(boosting.fit(rows, made, ALL), rows.limit(0), "id").count() == 0


def test_models_of_a_grid_are_grown_side_by_side(spark, monkeypatch):
    import threading

    both = threading.Barrier(4, timeout=20)
    plain = boosting.fit

    def fit(rows, made, p, label, key, held=None):
        if held:
            both.wait()  # fails unless all are on their way
        return plain(rows, made, p, label, key, held)

    monkeypatch.setattr(boosting, "fit", fit)
    rows = spark.range(400).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 7 > 3).cast("int").alias("label"), (F.col("id") % 2).alias("fold"))
    model, table = boosting.tune(rows, boosting.bins(rows, ["x"]), "fold", [boosting.Params(leaves=3, rounds=3), boosting.Params(leaves=2, rounds=3)])
    assert model["trees"] and [t["params"].leaves for t in table] == [3, 2] and table[0]["mean"] == 1.0
