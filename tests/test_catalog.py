"""Every query whose rows SQL can give, against DuckDB on the smallest tables."""

from __future__ import annotations

import decimal
import math
import os

import duckdb
import pytest

from urlsieve.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    other = duck.sql(catalog.SQL[name])
    assert sorted(other.columns) == sorted(df.columns)
    at = [other.columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["rate_dist", "status_stats"])
def test_groups_without_name_or_values_stay(spark, tmp_path, name):
    """A null event type is a group, and so is one that has no values."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES ('a', 1.0::DOUBLE), ('a', 2.5), (NULL, 3.0), (NULL, 4.5), (NULL, NULL), ('none', NULL)) AS e(event_type, value)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL[name]})").fetchall(), key=repr)


ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.SQL))
#: Models score every URL, with a probability and a decision by 0.5.
SCORED = ("model_char_ngram", "model_linear", "model_trees", "model_minibatch", "model_density", "model_autoencoder", "model_reconstruction")


@pytest.mark.parametrize("name", SCORED)
def test_models_score_every_url(spark, name):
    rows = catalog.QUERIES[name](spark, DIR).collect()
    n = spark.read.parquet(f"{DIR}/pages.parquet").count()
    assert len({r.id for r in rows}) == len(rows) >= n
    assert all(0 <= r.phishing_probability <= 1 and r.is_phishing == (r.phishing_probability >= 0.5) for r in rows)


def test_dispatch_scores_by_every_kind(spark):
    kinds = {r.kind: r["count"] for r in catalog.QUERIES["model_dispatch"](spark, DIR).groupBy("kind").count().collect()}
    assert kinds.keys() == {"char_ngram", "linear", "trees", "kmeans", "density", "autoencoder"} and len(set(kinds.values())) == 1


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert catalog.entry(spark, DIR).count() > 0


def test_rows_that_models_are_fitted_on_are_spread(spark):
    from urlsieve.plans import model_queries

    for rows in (model_queries._rows(spark, DIR), model_queries._masked(spark, DIR)):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_features_and_inputs_are_made_of_spread_urls(spark, monkeypatch):
    from urlsieve.plans import model_queries

    own = f"{DIR}/."  # nothing is stored for it yet
    assert model_queries._urls(spark, own).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(model_queries, "urls", None)  # as files hold them, a task each: nothing is worked out of these
    assert model_queries._matched(spark, own).count() == model_queries._urls(spark, own).count()
    assert model_queries._inputs(spark, own).columns == ["id", "submitted_url", "analysed", "model_input", "folded"]


def test_ngram_model_is_fitted_on_few_partitions_however_many_the_urls_have(spark, monkeypatch):
    """A step of the fit shuffles a gradient per partition, of up to 2^20 numbers."""
    from urlsieve.operators import models
    from urlsieve.plans import model_queries

    held = []

    def grid(makers, fit, val):
        held.extend((fit.rdd.getNumPartitions(), fit.count(), val.count()))
        return makers[0].copy().setMaxIter(1).fit(fit), []

    monkeypatch.setattr(models, "grid", grid)
    several = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1", "spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in several}
    try:
        for k, v in several.items():
            spark.conf.set(k, v)
        own = f"{DIR}/./."  # nothing is stored for it yet
        model_queries._ngrams(spark, own)
        masked = model_queries._masked(spark, own)
        assert masked.rdd.getNumPartitions() > 5 >= held[0] and held[1] + held[2] == masked.where("part IN ('fit', 'val')").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
