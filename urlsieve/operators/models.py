"""Models of URL risk on Spark's own learners. Where a learner differs from the usual tool, its docstring says so."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlsieve.functions import text
from urlsieve.operators import autoencoder, clusters, density, metrics, minibatch, splits

NUMERIC = (
    "url_length", "hostname_length", "path_length", "query_length", "dot_count", "hyphen_count", "digit_count", "at_count", "underscore_count", "percent_count", "equals_count", "ampersand_count",
    "digit_ratio", "subdomain_count", "path_depth", "is_ip_hostname", "has_port", "has_punycode", "suspicious_keyword_count", "hostname_entropy",
)
BRAND = ("brand_similarity_score", "is_exact_brand_match")
BUCKETS = text.BUCKETS


def log_odds(rows: DataFrame, column: str = "rest", key: str = "id", label: str = "label") -> DataFrame:
    """(bucket, coef) of a naive Bayes model of n-gram presence: log-odds of a bucket, positive rows against others, each by (n + 1) / (N + 2)."""
    seen = rows.select(key, F.col(label).cast("double").alias("y"), F.explode(F.array_distinct(F.transform(text.ngrams(F.col(column)), lambda g: text.bucket(g["gram"])))).alias("bucket"))
    every = rows.agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1 - F.col(label).cast("double")).alias("q"))
    n = seen.groupBy("bucket").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).crossJoin(F.broadcast(every))
    return n.select("bucket", (F.ln((F.col("a") + 1) / (F.col("p") + 2)) - F.ln((F.col("b") + 1) / (F.col("q") + 2))).alias("coef"))


def gram_counts(rows: DataFrame, column: str = "masked", key: str = "id", keep: Sequence[str] = ("label",)) -> DataFrame:
    """(key, keep, bucket, tf): how often each bucket of n-grams occurs in a row, counted within it. Rows of under three characters have none."""
    return rows.select(key, *keep, F.inline(text.bucket_counts(F.col(column))))


def idf(counts: DataFrame, n_rows: int) -> DataFrame:
    """(bucket, idf, pos) with smoothed frequencies, ln((1 + n) / (1 + df)) + 1; bucket -1 stands for all that no row has.

    pos numbers the buckets that rows have, at most BUCKETS of them, which one task sorts.
    """
    seen = counts.groupBy("bucket").agg(F.count("*").alias("df")).select("bucket", (F.ln(F.lit(1.0 + n_rows) / (1 + F.col("df"))) + 1).alias("idf"))
    seen = seen.withColumn("pos", F.row_number().over(Window.orderBy("bucket")) - 1)
    return seen.union(counts.sparkSession.range(1).select(F.lit(-1).cast("long").alias("bucket"), F.lit(math.log(1.0 + n_rows) + 1).alias("idf"), F.lit(-1).alias("pos")))


def _table(rows: DataFrame, *columns: str, rare: str) -> tuple[np.ndarray, ...]:
    """Arrays of columns by bucket, of at most BUCKETS rows and that of bucket -1, which holds `rare` of all others; the other columns are 0 there, and pos -1."""
    held = rows.select("bucket", *columns).toArrow()
    at = held["bucket"].to_numpy()
    out = []
    for c in columns:
        values = held[c].to_numpy()
        whole = np.full(BUCKETS, values[at < 0].max() if c == rare else -1 if c == "pos" else 0, values.dtype)
        whole[at[at >= 0]] = values[at >= 0]
        out.append(whole)
    return tuple(out)


def _terms(buckets: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, 1 + ln tf) of the distinct buckets of each row, in this order."""
    rows = np.repeat(np.arange(len(buckets)), pc.fill_null(pc.list_value_length(buckets), 0).to_numpy(zero_copy_only=False))
    held, tf = np.unique(rows * BUCKETS + buckets.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    return held // BUCKETS, held % BUCKETS, 1 + np.log(tf)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def tfidf(rows: DataFrame, counts: DataFrame, weights: DataFrame, key: str = "id") -> DataFrame:
    """rows with features, a sparse vector by pos of (1 + ln tf) * idf over its length; weights is idf(), broadcast: at most BUCKETS rows.

    A bucket that weights lacks has no place in the vector, but counts in its length.
    """
    rare = weights.where("bucket = -1").agg(F.max("idf").alias("_rare"))
    x = counts.join(F.broadcast(weights.where("bucket >= 0")), "bucket", "left").crossJoin(F.broadcast(rare)).select(key, F.struct(F.col("pos").alias("i"), ((1 + F.ln("tf")) * F.coalesce("idf", "_rare")).alias("v")).alias("e"))
    packed = x.groupBy(key).agg(F.sort_array(F.collect_list("e")).alias("e"))
    both = rows.join(packed, key, "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<i:int,v:double>>")))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, e: s + e["v"] * e["v"]))
    both = both.withColumn("_norm", norm).withColumn("e", F.filter("e", lambda e: e["i"].isNotNull()))
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(max(1, weights.count() - 1)).alias("size"), F.transform("e", lambda e: e["i"]).alias("indices"), F.transform("e", lambda e: e["v"] / F.col("_norm")).alias("values"))
    # the vector type can't be cast to, but it can be parsed
    kind = T.StructType([T.StructField("features", VectorUDT())])
    return both.withColumn("features", F.from_json(F.to_json(F.struct(vector.alias("features"))), kind)["features"]).drop("e", "_norm")


def vectors(rows: DataFrame, weights: DataFrame, column: str = "masked") -> DataFrame:
    """What tfidf() gives, from the texts: counted and weighed within each row, so that no n-gram is shuffled; weights is sent to each executor once.
    """
    idfs, places = _table(weights, "idf", "pos", rare="idf")
    held = rows.sparkSession.sparkContext.broadcast((idfs, places.astype(np.int32)))

    @F.arrow_udf("i array<int>, v array<double>")
    def weighed(buckets: pa.Array) -> pa.Array:
        idf, pos = held.value
        row, bucket, x = _terms(buckets)
        x = x * idf[bucket]
        norm = np.sqrt(np.bincount(row, x * x, len(buckets)))
        known = pos[bucket] >= 0
        row, place, x = row[known], pos[bucket[known]], x[known]
        sizes = np.bincount(row, minlength=len(buckets))
        return pa.StructArray.from_arrays([_lists(sizes, place), _lists(sizes, x / norm[row])], ["i", "v"])

    both = rows.withColumn("_e", weighed(text.gram_buckets(F.coalesce(column, F.lit("")))))
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(max(1, int(places.max()) + 1)).alias("size"), F.col("_e.i").alias("indices"), F.col("_e.v").alias("values"))
    # the vector type can't be cast to, but it can be parsed
    kind = T.StructType([T.StructField("features", VectorUDT())])
    return both.withColumn("features", F.from_json(F.to_json(F.struct(vector.alias("features"))), kind)["features"]).drop("_e")


def char_ngram(c: float, n_rows: int, rounds: int = 50) -> LogisticRegression:
    """Logistic regression on tfidf() of 3- to 5-grams in 2^20 buckets. The intercept isn't penalised, unlike in liblinear."""
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (c * max(1, n_rows)), maxIter=rounds, standardization=False)


def stored_coefficients(spark: SparkSession, model, weights: DataFrame) -> DataFrame:
    """(bucket, coef, idf) of a fitted char_ngram model: buckets that some row had, and -1 with the intercept and the idf of the others."""
    vector = model.coefficients.toArray()
    coef = spark.createDataFrame(pd.DataFrame({"pos": np.arange(-1, len(vector), dtype="int32"), "coef": np.append(model.intercept, vector)}))
    return weights.join(coef, "pos").select("bucket", "coef", "idf")


def linear_scores(rows: DataFrame, coefficients: DataFrame, column: str = "masked") -> DataFrame:
    """rows with logit and probability by stored coefficients, for texts that are preprocessed already; a null text has no n-grams. Nothing leaves its row."""
    idfs, coefs = _table(coefficients, "idf", "coef", rare="idf")
    shift = float(coefficients.where("bucket = -1").agg(F.max("coef")).first()[0])
    held = rows.sparkSession.sparkContext.broadcast((idfs, coefs))

    @F.arrow_udf("double")
    def scored(buckets: pa.Array) -> pa.Array:
        idf, coef = held.value
        row, bucket, x = _terms(buckets)
        x = x * idf[bucket]
        norm = np.sqrt(np.bincount(row, x * x, len(buckets)))
        return pa.array(shift + np.bincount(row, coef[bucket] * x, len(buckets)) / np.where(norm > 0, norm, 1))

    out = rows.withColumn("logit", scored(text.gram_buckets(F.coalesce(column, F.lit("")))))
    return out.withColumn("probability", 1 / (1 + F.exp(-F.col("logit"))))


def log_features(rows: DataFrame, names: Sequence[str] = NUMERIC) -> DataFrame:
    return rows.withColumns({f"log_{n}": F.log1p(F.col(n).cast("double")) for n in names})


def linear(names: Sequence[str] = (*NUMERIC, *BRAND)) -> Pipeline:
    return Pipeline(stages=[
        StringIndexer(inputCol="tld", outputCol="tld_i", handleInvalid="keep"),
        OneHotEncoder(inputCols=["tld_i"], outputCols=["tld_v"], handleInvalid="keep"),
        VectorAssembler(inputCols=[f"log_{n}" for n in names], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        VectorAssembler(inputCols=["scaled", "tld_v"], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01, maxIter=50),
    ])


def trees(names: Sequence[str] = (*NUMERIC, *BRAND), rounds: int = 10, depth: int = 5, early: str | None = None) -> Pipeline:
    """Gradient-boosted trees, Spark's own, not leaf-wise ones; `early` names the column that marks validation rows, on which growth stops."""
    boost = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=42, validationTol=0.001)
    if early:
        boost = boost.setValidationIndicatorCol(early)
    return Pipeline(stages=[VectorAssembler(inputCols=[f"log_{n}" for n in names], outputCol="features"), boost])


def grown_trees(fit: DataFrame, val: DataFrame, depths: Sequence[int] = (3, 5), rounds: int = 20, names: Sequence[str] = (*NUMERIC, *BRAND)):
    """The best depth by average precision on val, each grown until val's loss stops falling, then refitted on all with that many trees."""
    both = fit.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)))
    tried = [trees(names, rounds, d, "_val").fit(both) for d in depths]
    values = [average_precision(m, val) for m in tried]
    best = max(range(len(depths)), key=lambda k: (values[k] or 0.0, -k))
    return trees(names, max(1, tried[best].stages[-1].getNumTrees), depths[best]).fit(fit.unionByName(val))


def importances(model, names: Sequence[str] = (*NUMERIC, *BRAND)) -> list[tuple[str, float]]:
    """Each feature's share of the trees' gain in percent, most first."""
    share = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, (100 * share / max(share.sum(), 1e-300)).tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def kmeans(k: int, names: Sequence[str] = NUMERIC) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=[f"log_{n}" for n in names], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), KMeans(featuresCol="features", predictionCol="cluster", k=k, seed=42)])


def reconstruction(k: int = 8, names: Sequence[str] = NUMERIC) -> Pipeline:
    """Projection on principal components, a stand-in for an autoencoder: reconstruction_error() measures what it loses."""
    return Pipeline(stages=[VectorAssembler(inputCols=[f"log_{n}" for n in names], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(inputCol="scaled", outputCol="projected", k=k)])


def reconstruction_error(model, rows: DataFrame, names: Sequence[str] = NUMERIC) -> DataFrame:
    """rows with error, the mean squared difference: components are orthonormal, so lengths alone give it."""

    def length(x: str):
        return F.aggregate(vector_to_array(x), F.lit(0.0), lambda a, v: a + v * v)

    return model.transform(rows).withColumn("error", F.greatest(length("scaled") - length("projected"), F.lit(0.0)) / len(names))


def error_feature(rows: DataFrame, error: str = "error") -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.array(F.ln(F.col(error) + 1e-12))))


def platt(rows: DataFrame, error: str = "error", label: str = "label"):
    """Logistic regression on the logarithm of an error, which makes it a probability."""
    return LogisticRegression(featuresCol="features", labelCol=label).fit(error_feature(rows, error).select("features", label))


def score(model, rows: DataFrame, *keep: str, threshold: float = 0.5) -> DataFrame:
    """(keep, phishing_probability, is_phishing)."""
    p = vector_to_array("probability")[1]
    return model.transform(rows).select(*keep, p.alias("phishing_probability"), (p >= threshold).alias("is_phishing"))


def cluster_scores(fitted, train: DataFrame, rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, cluster, phishing_probability) by smoothed shares of the training rows' clusters; unseen ones get the prior."""
    known = clusters.probabilities(fitted.transform(train))
    prior = known.agg(F.max("prior").alias("_prior"))
    out = fitted.transform(rows).join(F.broadcast(known.select("cluster", "proba")), "cluster", "left").crossJoin(F.broadcast(prior))
    return out.select(*keep, "cluster", F.coalesce("proba", "_prior").alias("phishing_probability"))


def average_precision(model, val: DataFrame) -> float | None:
    scored = score(model, val, "label").select("label", F.round("phishing_probability", 9).alias("score"))
    return metrics.average_precision(metrics.tally(scored)).first()[0]


def grid(makers: list, fit: DataFrame, val: DataFrame):
    """The model of the highest average precision on val, the first one among equals, and all values."""
    models = [make.fit(fit) for make in makers]
    values = [average_precision(m, val) for m in models]
    best = max(range(len(models)), key=lambda k: (values[k] or 0.0, -k))
    return models[best], values


def best_clusters(fit: DataFrame, val: DataFrame, ks: Sequence[int] = (2, 5, 10, 20, 50, 100)):
    """The K-means model whose cluster probabilities have the highest average precision on val, and all values."""
    ks = [k for k in ks if k <= max(2, fit.count() // 2)]
    models, values = [kmeans(k).fit(fit) for k in ks], []
    for m in models:
        scored = cluster_scores(m, fit, val, "label").select("label", F.round("phishing_probability", 9).alias("score"))
        values.append(metrics.average_precision(metrics.tally(scored)).first()[0])
    best = max(range(len(ks)), key=lambda k: (values[k] or 0.0, -k))
    return models[best], dict(zip(ks, values, strict=True))


def kinds_of_phishing(rows: DataFrame, ks: Sequence[int] = (4, 5, 6, 7, 8), seeds: Sequence[int] = (1, 2, 3), names: Sequence[str] = NUMERIC) -> tuple[int, dict[int, float], DataFrame]:
    """K by silhouette, the first among equals; all silhouettes; and (seed, ari, jaccard) of refits with other seeds.

    ari compares a refit's clusters with the first fit's; jaccard is the least of the clusters' best overlaps.
    """
    scaled = Pipeline(stages=kmeans(2, names).getStages()[:-1]).fit(rows).transform(rows)
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")

    def fitted(k: int, seed: int):
        return KMeans(featuresCol="features", predictionCol="cluster", k=k, seed=seed).fit(scaled)

    found = {k: judge.evaluate(fitted(k, 42).transform(scaled)) for k in ks}
    best = max(found, key=lambda k: (found[k], -k))
    first = fitted(best, 42).transform(scaled).withColumnRenamed("cluster", "_first").drop("prediction")
    out = None
    for seed in seeds:
        cells = clusters.contingency(fitted(best, seed).transform(first), "cluster", "_first")
        row = clusters.external(cells).select(F.lit(seed).alias("seed"), "ari").crossJoin(clusters.jaccard(cells).agg(F.min("best").alias("jaccard")))
        out = row if out is None else out.union(row)
    return best, found, out


def scaler(names: Sequence[str] = NUMERIC) -> Pipeline:
    """Logarithms of the features less their means, in deviations."""
    return Pipeline(stages=[VectorAssembler(inputCols=[f"log_{n}" for n in names], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)])


def scaled(fitted, rows: DataFrame) -> DataFrame:
    """rows with vector, what a fitted scaler makes of them as an array."""
    return fitted.transform(rows).withColumn("vector", vector_to_array("scaled")).drop("raw", "scaled")


def _judged(rows: DataFrame, shares: DataFrame) -> float:
    """Average precision of rows (cluster, label) by their clusters' shares."""
    prior = shares.agg(F.max("prior").alias("_prior"))
    p = rows.join(shares.select("cluster", "proba"), "cluster", "left").crossJoin(prior)
    return metrics.average_precision(metrics.tally(p.select("label", F.round(F.coalesce("proba", "_prior"), 9).alias("score")))).first()[0] or 0.0


def best_minibatch(fit: DataFrame, val: DataFrame, ks: Sequence[int] = (2, 5, 10, 20, 50, 100), names: Sequence[str] = NUMERIC) -> tuple[dict, dict[int, float]]:
    """The mini-batch K-means whose cluster shares judge val best, the first among equals: scaler, centres, shares; and all values.

    One pass over fit gives the centres of all numbers of clusters.
    """
    made = scaler(names).fit(fit)
    fit, val = scaled(made, fit), scaled(made, val)
    ks = [k for k in ks if k <= max(2, fit.count() // 2)]
    centres = minibatch.fit(fit, ks, "vector")
    placed, judged = (minibatch.assign(x, centres, "vector").select("label", "clusters") for x in (fit, val))
    values, shares = {}, {}
    for j, k in enumerate(sorted(centres)):
        shares[k] = clusters.probabilities(placed.select("label", F.col("clusters")[j].alias("cluster")))
        values[k] = _judged(judged.select("label", F.col("clusters")[j].alias("cluster")), shares[k])
    best = max(values, key=lambda k: (values[k], -k))
    return {"scaler": made, "centres": centres[best].tolist(), "shares": shares[best]}, values


def best_density(fit: DataFrame, val: DataFrame, leasts: Sequence[int] = (25, 50, 100), neighbours: int = 10, most: int = density.MOST, names: Sequence[str] = NUMERIC) -> tuple[dict, dict[int, float]]:
    """The density clusters of a sample of fit whose shares judge val best, the first among equals: scaler, points, shares; and all values.

    The sample, of `most` rows by hash of id, is the operator's own bound; all other rows take the cluster of their nearest point.
    """
    made = scaler(names).fit(fit)
    fit, val = scaled(made, fit), scaled(made, val)
    sample = splits.sample(fit, most, "id").select("id", "label", "vector")
    held = density.Sample(sample, neighbours, most, "id", "vector")
    found, values = {}, {}
    for least in leasts:
        points = held.clusters(least).select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding"), "cluster")
        own = sample.select("id", "label").join(points.select(F.col("vec_id").alias("id"), "cluster"), "id")
        shares = clusters.probabilities(own)
        near = clusters.nearest_labelled(val.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")), points, most)
        values[least] = _judged(val.select(F.col("id").alias("vec_id"), "label").join(near, "vec_id").select("label", "cluster"), shares)
        found[least] = {"scaler": made, "points": points, "shares": shares}
    best = max(values, key=lambda k: (values[k], -k))
    return found[best], values


def best_autoencoder(fit: DataFrame, val: DataFrame, p: autoencoder.Params = autoencoder.Params(), names: Sequence[str] = NUMERIC) -> dict:
    """scaler, model and line: an autoencoder of fit's legitimate rows that stops by val's, and a logistic line on val's errors, all labels."""
    good = fit.where("label = 0")
    made = scaler(names).fit(good)
    both = scaled(made, good.withColumn("_held", F.lit(False)).unionByName(val.where("label = 0").withColumn("_held", F.lit(True))))
    model = autoencoder.fit(both, "vector", held="_held", p=p)
    line = platt(autoencoder.errors(model, scaled(made, val), "vector"))
    return {"scaler": made, "model": model, "line": {"slope": float(line.coefficients[0]), "shift": float(line.intercept)}}
