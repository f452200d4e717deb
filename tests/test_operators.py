"""Operators whose results are checked by hand-made cases or brute force: matching, quantiles, models, bundles, reports, the limiter on a stream."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from urlsieve.functions import suffix, text
from urlsieve.operators import brands, bundles, clusters, explain, models, quantiles, reports, splits
from urlsieve.streaming import limiter


def common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_closest_brands_are_those_of_brute_force():
    rng = random.Random(1)
    word = lambda most: "".join(rng.choice("abcdexyzé-") for _ in range(rng.randrange(most)))
    names = sorted({word(14) for _ in range(80)})
    match = brands.Matcher(names)
    for label in [word(20) for _ in range(120)] + [word(150) for _ in range(20)] + ["", "a" * 63, "ab" * 70, *names[:5]]:
        scores = [2 * common(label, b) / (len(label) + len(b)) if label or b else 1.0 for b in names]
        k = max(range(len(names)), key=lambda i: (scores[i], -i))
        assert match(label) == (pytest.approx(scores[k]), names[k])
    assert brands.Matcher([])("x") == (-1.0, "")


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_quantiles_are_exact(spark, n):
    rng = random.Random(n)
    rows = [(g, rng.choice([None, round(rng.gauss(0, 5), 1), float(rng.randrange(3))])) for g in ("a", None, "b") for _ in range(n)] + [("empty", None)]
    found = quantiles.exact(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"low": (0.0, "linear"), "q": (0.37, "linear"), "p": (0.95, "nearest"), "top": (1.0, "linear")})
    got = {r.g: r for r in found.collect()}
    for g in ("a", None, "b"):
        x = sorted(v for k, v in rows if k == g and v is not None)
        if not x:
            assert g not in got
            continue
        r = got[g]
        assert (r.low, r.top) == (x[0], x[-1]) and r.q == pytest.approx(np.quantile(x, 0.37)) and r.p == x[max(0, math.ceil(round(0.95 * len(x), 9)) - 1)]
    assert "empty" not in got
    assert quantiles.exact(spark.createDataFrame([], "g string, x double"), [], "x", {"q": (0.5, "linear")}).collect() in ([], [(None,)])


def test_quantiles_do_not_depend_on_the_order_of_rows(spark):
    """As on a cluster, rows come in another order each time that the plan reads them."""

    def mixed(batches):
        yield pd.concat(batches).sample(frac=1, random_state=int.from_bytes(os.urandom(4)))

    n, before = 120_000, spark.conf.get("spark.sql.shuffle.partitions")
    wanted = {f"q{k}": (k / 20, "nearest") for k in range(1, 20)}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        rows = spark.range(n, numPartitions=1).selectExpr("CAST(id AS DOUBLE) AS x").mapInPandas(mixed, "x double")
        assert quantiles.exact(rows, [], "x", wanted).collect() == [tuple(float(n * k // 20 - 1) for k in range(1, 20))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quantiles_deal_out_counts_not_rows(spark):
    rows = spark.range(1000).selectExpr("CAST(id % 2 AS STRING) AS g", "CAST(id % 7 AS DOUBLE) AS x")
    found = quantiles.exact(rows, ["g"], "x", {"q": (0.5, "linear")})
    assert {r.g: r.q for r in found.collect()} == {"0": 3.0, "1": 3.0}
    lines = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert any("Range (" in x for x in lines)
    for k, line in enumerate(lines):
        if "Range (" in line:  # the first step above the rows' columns counts them, by group and value
            above = next(x for x in reversed(lines[:k]) if "Project" not in x and "Filter" not in x)
            assert "Aggregate(" in above and "_x" in above.split("functions")[0], above


def test_even_samples(spark):
    for total, n in ((10, 4), (1000, 7), (5, 9), (131_072, 1000)):
        found = sorted(r.id for r in splits.even_sample(spark.range(total), n, "id", 4096).collect())
        assert found == (list(range(total)) if total <= n else [i * total // n for i in range(n)])


def test_common_prefix(spark):
    pairs = [("abc", "abd"), ("", "x"), ("same", "same"), ("a", "ab"), ("𝔘x", "𝔘y"), ("x\ny", "x\nz")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(text.common_prefix(F.col("a"), F.col("b")).alias("n")).collect()
    assert [r.n for r in rows] == [2, 0, 4, 1, 1, 2]


def test_suffixes_of_second_level_registries(spark):
    hosts = ["www.example.co.nz", "x.gov.br", "shop.example.com.au.", "a.b.c.ck", "www.ck", "１.２.３.４", "unknown.zzz"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string")
    want = [("co.nz", "example.co.nz"), ("gov.br", "x.gov.br"), ("com.au", "example.com.au"), ("c.ck", "b.c.ck"), ("ck", "www.ck"), ("", "１.２.３.４"), ("", "unknown.zzz")]
    assert [(r.suffix, r.domain) for r in suffix.attach(rows, F.col("h")).collect()] == want
    by = {r.h: (r.suffix, r.domain) for r in suffix.split_by(rows, suffix.rules_table(spark), "h").collect()}
    assert [by[h] for h in hosts] == want


def test_nearest_labelled_points(spark):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(rng.normal(size=(60, 5)))] + [(60, [0.0] * 5, 1), (61, [0.0] * 5, 2)], "vec_id long, embedding array<double>, cluster int")
    known = points.where("vec_id < 20")
    v = {r.vec_id: np.array(r.embedding) for r in points.collect()}
    for r in clusters.nearest_labelled(points, known).collect():
        far = [((v[r.vec_id] - v[k]) ** 2).sum() for k in range(20)]
        assert (r.cluster, r.distance) == (int(np.argmin(far)) % 3, pytest.approx(min(far) ** 0.5, abs=1e-6))
    assert {r.cluster for r in clusters.nearest_labelled(points, known.limit(0)).collect()} == {None}
    with pytest.raises(ValueError, match="at most 5"):
        clusters.nearest_labelled(points, known, most=5)


@pytest.fixture(scope="module")
def labelled_urls(spark):
    rng = random.Random(4)
    good, bad = ["garden", "library", "museum", "weather", "recipes"], ["verify", "login", "secure", "account", "update"]
    rows = []
    for i in range(400):
        y = i % 2
        words = [rng.choice(bad if y and rng.random() < 0.9 else good) for _ in range(3)]
        rows.append((i, f"{words[0]}-{words[1]}.com/{words[2]}{words[2] if i % 5 == 0 else ''}", y))
    return spark.createDataFrame([*rows, (400, "x", 1), (401, "", 0)], "id long, masked string, label int").cache()


def test_ngram_model_learns_and_its_stored_form_scores_alike(spark, labelled_urls, tmp_path):
    rows = labelled_urls
    fit, val = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    n = fit.count()
    weights = models.idf(models.gram_counts(fit), n)
    made = models.tfidf(rows, models.gram_counts(rows), weights).cache()
    vectors = {r.id: r.features for r in made.collect()}
    assert all(abs(sum(v.values**2) - 1) < 1e-9 for i, v in vectors.items() if i < 400 and i % 4) and vectors[401].numNonzeros() == 0
    # one text by hand: counts, smoothed idf, length 1
    r = fit.where("id = 5").first()
    grams = [r.masked[i : i + k] for k in (3, 4, 5) for i in range(len(r.masked) - k + 1)]
    df = {g: sum(g in t.masked for t in fit.collect()) for g in set(grams)}
    x = sorted((1 + math.log(grams.count(g))) * (math.log((1 + n) / (1 + df[g])) + 1) for g in set(grams))
    assert sorted(vectors[5].values) == pytest.approx([v / math.sqrt(sum(w * w for w in x)) for v in x])
    best, values = models.grid([models.char_ngram(c, n, 30) for c in (0.01, 1.0, 10.0)], made.where("id % 4 > 0"), made.where("id % 4 = 0"))
    assert len(values) == 3 and max(values) > 0.9
    coef = models.stored_coefficients(spark, best, weights)
    bundles.save(spark, "char_ngram", str(tmp_path / "m"), 0.6, coefficients=coef)
    bundle = bundles.load(spark, str(tmp_path / "m"))
    direct = {r.id: r.phishing_probability for r in models.score(best, made, "id").collect()}
    stored = {r.id: r for r in bundles.predict(bundle, rows, "id").collect()}
    assert stored.keys() == direct.keys()
    assert all(stored[i].phishing_probability == pytest.approx(p, abs=1e-9) and stored[i].is_phishing == (stored[i].phishing_probability >= 0.6) for i, p in direct.items())
    assert bundles.predict(bundle, rows.limit(0), "id").count() == 0
    # the shares of a text's n-grams and the intercept make up its logit
    shares = explain.occurrences(val, bundle["coefficients"], column="masked").groupBy("id").agg(F.sum("share").alias("s"))
    logit = {r.id: r.logit for r in models.linear_scores(val, bundle["coefficients"]).collect()}
    assert all(r.s + best.intercept == pytest.approx(logit[r.id], abs=1e-9) for r in shares.collect())


def test_vectors_are_made_within_their_rows(spark, labelled_urls):
    rows = labelled_urls.union(spark.createDataFrame([(402, None, 0)], "id long, masked string, label int"))
    counts = models.gram_counts(rows)
    plain = rows.select("id", F.explode(F.transform(text.ngrams(F.col("masked")), lambda g: text.bucket(g["gram"]))).alias("bucket")).groupBy("id", "bucket").count()
    assert sorted((r.id, r.bucket, r.tf) for r in counts.collect()) == sorted(tuple(r) for r in plain.collect())
    weights = models.idf(models.gram_counts(rows.where("id % 4 > 0")), 302)
    one = {r.id: r.features for r in models.tfidf(rows, counts, weights).collect()}
    made = models.vectors(rows, weights)
    two = {r.id: r.features for r in made.collect()}
    assert one.keys() == two.keys() and two[402].numNonzeros() == 0
    assert all(v.size == two[i].size and list(v.indices) == list(two[i].indices) and list(v.values) == pytest.approx(list(two[i].values)) for i, v in one.items())
    scores = models.linear_scores(rows, weights.select("bucket", F.lit(0.5).alias("coef"), "idf"))
    assert not any("Exchange" in d._jdf.queryExecution().executedPlan().toString() for d in (counts, made, scores))


def test_ngrams_are_dealt_to_tasks_by_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(explain, "ROWS", 10, raising=False)
    rows = spark.range(100).select("id", F.lit("example.org/a").alias("rest"))
    found = explain.occurrences(rows, spark.createDataFrame([(7, 1.0)], "bucket long, coef double"))
    assert found.rdd.getNumPartitions() == 11


def test_long_rows_are_fewer_a_task(spark):
    rows = spark.range(40).select("id", F.repeat(F.lit("example.org/a/"), 2_000).alias("rest"))
    coefficients = spark.createDataFrame([(7, 1.0)], "bucket long, coef double")
    assert explain.occurrences(rows, coefficients).rdd.getNumPartitions() == 40 * 3 * 28_000 // explain.GRAMS + 1
    assert explain.occurrences(rows.limit(0), coefficients).count() == 0


def test_pruned_brand_search_is_exact():
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 14))) for _ in range(300)] + [""]
    matcher = brands.Matcher(names)
    for label in ["", "zzz", "a" * 150, *("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 90))) for _ in range(120)), *names[:20]]:
        total = matcher.sizes + len(label)
        score = np.where(total > 0, 2 * matcher.common(label) / np.maximum(total, 1), 1.0)
        assert matcher(label) == (float(score.max()), matcher.brands[int(score.argmax())])


def test_described_equals_exact_quantiles(spark):
    rng = random.Random(10)
    rows = spark.createDataFrame([(rng.choice("ab") if rng.random() < 0.9 else None, rng.choice([None, *range(9)])) for _ in range(500)] + [("c", 4), ("d", None)], "g string, x int")
    wanted = {"p10": (0.1, "linear"), "p50": (0.5, "linear"), "p95": (0.95, "nearest")}
    for by in (["g"], []):
        found = {tuple(r[b] for b in by): r for r in quantiles.described(rows, by, "x", wanted).collect()}
        want = {tuple(r[b] for b in by): r for r in quantiles.exact(rows, by, "x", wanted).collect()}
        plain = {tuple(r[b] for b in by): r for r in rows.where("x IS NOT NULL").groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")).collect()}
        assert found.keys() == want.keys() == plain.keys()
        for k, r in found.items():
            assert all(r[p] == pytest.approx(want[k][p]) for p in wanted) and r.n == plain[k].n and r["mean"] == pytest.approx(plain[k]["mean"])
            assert r["std"] == (None if plain[k]["std"] is None else pytest.approx(plain[k]["std"]))


def test_log_odds_lean_to_the_labels(labelled_urls):
    coef = {r.bucket: r.coef for r in models.log_odds(labelled_urls, "masked").collect()}
    of = lambda gram: next(r.b for r in labelled_urls.limit(1).select(text.bucket(F.lit(gram)).alias("b")).collect())
    assert coef[of("verif")] > 1 and coef[of("museu")] < -1


def test_numeric_models(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        y = i % 2
        rows.append((i, y, "com" if y else "org", "val" if i % 5 == 0 else "fit", *[rng.gauss(2 * y if k < 2 else 0, 1) + 5 for k in range(len(models.NUMERIC) + len(models.BRAND))]))
    names = [f"log_{n}" for n in (*models.NUMERIC, *models.BRAND)]
    frame = spark.createDataFrame(rows, "id long, label int, tld string, part string, " + ", ".join(f"{n} double" for n in names)).cache()
    fit, val = frame.where("part = 'fit'"), frame.where("part = 'val'")
    trees = models.grown_trees(fit, val, depths=(2,), rounds=5)
    assert models.average_precision(trees, val) > 0.85
    share = models.importances(trees)
    assert {n for n, _ in share[:2]} == set(models.NUMERIC[:2]) and sum(x for _, x in share) == pytest.approx(100)
    best, values = models.best_clusters(fit, val, (2, 3))
    assert set(values) == {2, 3} and models.cluster_scores(best, fit, val, "id").count() == val.count()
    k, found, stable = models.kinds_of_phishing(fit.where("label = 1"), (4, 5), (1, 2))
    assert k in found and all(0 <= r.jaccard <= 1 and r.ari <= 1 for r in stable.collect()) and stable.count() == 2


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 1, 0.12345), (None, 2, None)], "name string, n int, x double").orderBy("n")
    assert reports.markdown(rows, {"x": 2}) == "| name | n | x |\n| --- | --- | --- |\n| a\\|b | 1 | 0.12 |\n|  | 2 |  |\n"
    reports.write_report(rows, "T", str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r"), wholetext=True).first().value.startswith("# T\n\n| name")
    with pytest.raises(ValueError, match="at most 1 "):
        reports.markdown(rows, most=1)
    assert reports.credential("KEY", "Set it.", {"KEY": "v"}) == "v"
    with pytest.raises(SystemExit, match="KEY is not set. Set it."):
        reports.credential("KEY", "Set it.", {})


def test_store_of_clients_seen_last(spark):
    rng = random.Random(12)
    events = [(i, 1_700_000_000 + rng.randrange(2000), rng.choice([None, *(f"c{rng.choice([2, 9, 40]) * rng.random():.0f}" for _ in range(3))])) for i in range(1500)]
    frame = spark.createDataFrame(events, "event_id long, t long, user_id string").select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id")
    for most, parts in ((5, 7), (50, 3), (1, 4), (5, 1)):
        store, want = {}, {}
        for i, _, name in sorted(events, key=lambda e: (e[1], e[0])):
            want[i] = name not in store
            store.pop(name, None)
            store[name] = True
            if len(store) > most:
                del store[next(iter(store))]
        got = {r.event_id: r.fresh for r in limiter.forgotten(frame, most, parts=parts).collect()}
        assert got == want and 10 < sum(want.values())
    assert limiter.forgotten(frame.limit(0), 5).count() == 0


def test_limiter_on_a_stream_gives_the_rows_of_the_table(spark, tmp_path):
    rng = random.Random(8)
    t0 = 1_700_000_000
    rows = sorted((t0 + rng.randrange(400), i, f"c{rng.randrange(4)}") for i in range(120))
    frame = spark.createDataFrame([(i, float(t), c) for t, i, c in rows], "event_id long, t double, user_id string").select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id")
    for k in range(3):  # later files hold later events
        frame.where(f"unix_seconds(ts) >= {t0 + 134 * k} AND unix_seconds(ts) < {t0 + 134 * (k + 1)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {(r.event_id, r.allowed, r.retry_after) for r in limiter.batch(frame, capacity=3, seconds=60.0).collect()}
    events = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = limiter.stream(events, capacity=3, seconds=60.0, delay="10 minutes")
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_id, r.allowed, r.retry_after) for r in spark.table("limited").collect()} == want


def test_timed_stream_goes_on_from_a_checkpoint(spark, tmp_path):
    rng = random.Random(18)
    t0 = 1_700_000_000
    rows = sorted((t0 + rng.randrange(400), i, f"c{rng.randrange(4)}") for i in range(120))
    frame = spark.createDataFrame([(i, float(t), c) for t, i, c in rows], "event_id long, t double, user_id string").select("event_id", F.timestamp_seconds("t").alias("ts"), "user_id")
    want = {(r.event_id, r.allowed, r.retry_after) for r in limiter.batch(frame, capacity=3, seconds=60.0).collect()}
    (tmp_path / "in").mkdir()
    events = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="RocksDB"):
        limiter.timed_stream(events)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, limiter.ROCKS)
    try:
        for k in range(2):  # each part is read by a query of its own, the second from the first one's checkpoint
            frame.where(f"unix_seconds(ts) >= {t0 + 200 * k} AND unix_seconds(ts) < {t0 + 200 * (k + 1)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            out = limiter.timed_stream(events, capacity=3, seconds=60.0, delay="10 minutes")
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(120)
    finally:
        spark.conf.set(provider, before)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 120 and {(r.event_id, r.allowed, r.retry_after) for r in got} == want
