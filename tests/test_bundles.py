"""Stored models: refused on any changed byte, and scored alike before and after; samples, folds and files by place."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from urlsieve.operators import autoencoder, boosting, bundles, models, splits
from urlsieve.sources import files


@pytest.fixture(scope="module")
def feature_rows(spark):
    rng = random.Random(6)
    names = [f"log_{n}" for n in (*models.NUMERIC, *models.BRAND)]
    rows = []
    for i in range(400):
        y = i % 2
        rows.append((i, y, "com" if rng.random() < 0.8 - 0.6 * y else "org", "val" if i % 5 == 0 else "fit", *[rng.gauss(2 * y if k < 3 else 0, 1) + 5 for k in range(len(names))]))
    return spark.createDataFrame(rows, "id long, label int, tld string, part string, " + ", ".join(f"{n} double" for n in names)).cache()


def fitted(spark, rows) -> dict[str, dict]:
    fit, val = rows.where("part = 'fit'"), rows.where("part = 'val'")
    names = [f"log_{n}" for n in (*models.NUMERIC, *models.BRAND)]
    made = boosting.bins(fit, names, ["tld"])
    small = autoencoder.Params(hidden=(16,), middle=4, batch=64, epochs=8)
    return {
        "char_ngram": {"coefficients": spark.createDataFrame([(-1, 0.5, 2.0), (7, 1.0, 1.0)], "bucket long, coef double, idf double")},
        "linear": {"pipeline": models.linear().fit(fit)},
        "trees": {"model": boosting.fit(fit, made, boosting.Params(rounds=10))},
        "kmeans": models.best_minibatch(fit, val, (2, 5))[0],
        "density": models.best_density(fit, val, (10, 20), most=200)[0],
        "autoencoder": models.best_autoencoder(fit, val, small),
    }


def test_all_kinds_are_stored_and_loaded(spark, feature_rows, tmp_path):
    rows = feature_rows.withColumn("masked", F.lit("example.com/login"))
    for kind, parts in fitted(spark, feature_rows).items():
        path = str(tmp_path / kind)
        seal = bundles.save(spark, kind, path, 0.4, **parts)
        bundle = bundles.load(spark, path, seal)
        assert bundle["kind"] == kind and bundle["threshold"] == 0.4
        before = {r.id: r.phishing_probability for r in bundles.predict({"kind": kind, "threshold": 0.4, **parts}, rows, "id").collect()}
        after = {r.id: r for r in bundles.predict(bundle, rows, "id").collect()}
        assert before.keys() == after.keys() == set(range(400)), kind
        assert all(after[i].phishing_probability == pytest.approx(p, abs=1e-9) and after[i].is_phishing == (after[i].phishing_probability >= 0.4) for i, p in before.items()), kind
        assert bundles.predict(bundle, rows.limit(0), "id").count() == 0
        assert bundles.predict(bundle, rows, "id", threshold=0.0).where("NOT is_phishing").count() == 0
        if kind in ("linear", "trees", "kmeans"):
            right = sum((after[i].phishing_probability >= 0.5) == (i % 2 == 1) for i in after)
            assert right > 320, kind


def test_changed_files_are_refused_before_they_are_parsed(spark, tmp_path, monkeypatch):
    path = tmp_path / "m"
    rows = spark.range(50).selectExpr("id - 1 AS bucket", "id / 7.0 AS coef", "1.0 AS idf")
    seal = bundles.save(spark, "char_ngram", str(path), coefficients=rows)
    assert bundles.load(spark, str(path), seal)["coefficients"].count() == 50
    stored = next(p for p in (path / "coefficients").glob("part-*"))
    whole = stored.read_bytes()

    def refused(match: str):
        (stored.parent / f".{stored.name}.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError, match=match):
            bundles.load(spark, str(path), seal)

    monkeypatch.setattr(bundles, "_read_text", lambda s, p, f=bundles._read_text: f(s, p) if p.endswith("about") else pytest.fail("parsed"))
    stored.write_bytes(whole[:20] + bytes([whole[20] ^ 1]) + whole[21:])
    refused("differs from its description: coefficients/part-")
    stored.write_bytes(whole[:-1])
    refused("differs from its description")
    stored.unlink()
    refused("differs from its description")
    stored.write_bytes(whole)
    extra = path / "coefficients" / "part-extra.parquet"
    extra.write_bytes(b"x")
    refused("differs from its description: coefficients/part-extra.parquet")
    extra.unlink()
    assert bundles.load(spark, str(path), seal)
    (about,) = (path / "about").glob("part-*")
    kept = about.read_text()
    for change, match in (({"threshold": 0.9}, "not the sealed one"), ({"format": 2}, "not the sealed one")):
        about.write_text(json.dumps(json.loads(kept) | change))
        (about.parent / f".{about.name}.crc").unlink(missing_ok=True)
        refused(match)
    with pytest.raises(ValueError, match="unknown format"):
        bundles.load(spark, str(path))
    assert bundles.load(spark, str(tmp_path / "nothing")) is None
    with pytest.raises(ValueError, match="no such kind"):
        bundles.save(spark, "other", str(path))
    with pytest.raises(ValueError, match="has the parts"):
        bundles.save(spark, "linear", str(path))


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(spark_mode(df, "simple"))


def spark_mode(df, name: str):
    return df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(name)


def test_samples_are_cut_by_counts(spark):
    rows = spark.range(5000).selectExpr("id AS key", "id % 7 AS other", "concat('k', id % 1200) AS name")
    for n, key in ((0, "key"), (1, "key"), (37, "key"), (2500, "key"), (4999, "key"), (5000, "key"), (9000, "key"), (1500, "name")):
        got = splits.sample(rows, n, key)
        want = sorted(rows.selectExpr("*", f"md5(concat('42:', {key})) AS h").collect(), key=lambda r: (r.h, r[key]))[:n]
        assert sorted(r[key] for r in got.collect()) == sorted(r[key] for r in want), (n, key)
        assert key == "name" or "TakeOrdered" not in plan(got)
    nulls = spark.createDataFrame([(None,), (1,), (None,)], "key long")
    assert splits.sample(nulls, 2, "key").count() == 2 and splits.sample(nulls.limit(0), 2, "key").count() == 0


def test_folds_are_packed_largest_first(spark):
    rng = random.Random(2)
    sizes = [int(rng.paretovariate(1.1)) for _ in range(700)] + [300, 299, 5, 5, 5]
    rows = spark.createDataFrame([(f"g{g}", k) for g, n in enumerate(sizes) for k in range(min(n, 400))] + [(None, 1), (None, 2)], "domain string, k int")
    for k in (2, 3, 5):
        loads = [0] * k
        for n in sorted((min(n, 400) for n in [*sizes, 2]), reverse=True):
            loads[loads.index(min(loads))] += n
        got = splits.balanced_folds(rows, "domain", k)
        assert {r.fold: r["count"] for r in got.groupBy("fold").count().collect()} == dict(enumerate(loads))
        assert got.groupBy("domain").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert splits.balanced_folds(rows.limit(0), "domain").count() == 0


def test_files_come_side_by_side_by_place(spark, tmp_path):
    rows = spark.range(1, 3001).selectExpr("id", "concat('x', id) AS name", "id * 0.5 AS y")
    for name, parts, columns in (("a", 4, ("id", "name")), ("b", 7, ("y",)), ("c", 1, ("y",))):
        rows.repartitionByRange(parts, "id").sortWithinPartitions("id").select(*columns).write.csv(str(tmp_path / name))
    left = spark.read.schema("id long, name string").csv(str(tmp_path / "a"))
    for other in "bc":
        got = files.beside(left, spark.read.schema("y double").csv(str(tmp_path / other)))
        assert got.count() == 3000 and got.where("y != id * 0.5 OR name != concat('x', id)").count() == 0
    with pytest.raises(ValueError, match="2999 and 3000"):
        files.beside(left.where("id > 1"), spark.read.schema("y double").csv(str(tmp_path / "b")))
    with pytest.raises(ValueError, match="columns name"):
        files.beside(left, spark.read.schema("Name string").csv(str(tmp_path / "b")))
