"""Models of URL risk, each fitted once for a folder of tables and stored, and what is explained with them."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlsieve.functions import text
from urlsieve.functions import values as V
from urlsieve.operators import boosting, brands, bundles, clusters, density, explain, minibatch, models, rules, splits
from urlsieve.plans.inputs import domains, parts, table, urls
from urlsieve.plans.risk_queries import MODEL, features
from urlsieve.sources import folders

QUERIES: dict = {}
SQL: dict = {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- fitting once ---

#: Inverse strengths of the penalty that validation chooses from.
STRENGTHS = (1.0, 3.0, 10.0, 30.0)
#: The most partitions that the n-gram model is fitted on: in every step each shuffles a gradient of up to 2^20 numbers, however few its
#: rows, to the task that adds them up, and those of more than five partitions would be shuffled once more before.
GRADIENTS = 5
#: By session: the stored tables and models of a folder of tables, by folder and name; a model's path goes with its seal.
_STORED: WeakKeyDictionary[SparkSession, dict] = WeakKeyDictionary()


def _once(s: SparkSession, d: str, name: str, make):
    held = _STORED.setdefault(s, {})
    if (d, name) not in held:
        held[d, name] = make()
    return held[d, name]


def _written(s: SparkSession, d: str, name: str, make) -> DataFrame:
    """A table that make() gives, written when it is first asked for."""

    def write() -> str:
        path = folders.fresh(s, name)
        make().write.parquet(path)
        return path

    return s.read.parquet(_once(s, d, name, write))


def stored(s: SparkSession, d: str, kind: str) -> dict:
    """The model of a kind on these tables, fitted and stored when it is first asked for, and verified whenever it is loaded."""

    def make() -> tuple[str, str]:
        path = folders.fresh(s, kind)
        return path, bundles.save(s, kind, path, **FITTED[kind](s, d))

    path, seal = _once(s, d, kind, make)
    return bundles.load(s, path, seal)


def _parted(rows):
    """rows with part: test, val or fit, by domain, so that no domain is in two of them."""
    rows = splits.by_group(splits.by_group(rows, "domain"), "domain", 10, "val:", "inner")
    return rows.withColumn("part", F.when(c("part") == "test", "test").when(c("inner") == "test", "val").otherwise("fit")).drop("inner")


def _of(rows, *names):
    return rows.where(c("part").isin(*names))


#: Rows in a file of a stored table that models are fitted on; there are as many files as cores at least.
SPREAD = 20_000


def _spread(rows, n: int):
    """rows dealt out by id, so that every core has its share of the fits: files as they come from joins would be few."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, n // SPREAD + 1), "id")


def _urls(s, d):
    """The URLs, written and spread before anything is worked out: Spark would move filters, and all they need, before the dealing."""

    def make():
        rows = urls(s, d)
        return _spread(rows, rows.count())

    return _written(s, d, "urls", make)


def _masked(s, d):
    """(id, url, label, part, masked) of URLs."""

    def make():
        rows = _urls(s, d).where("url IS NOT NULL")
        return _parted(domains(parts(brands.mask(rows, "url", "masked")))).select("id", "url", "label", "part", "masked")

    return _written(s, d, "masked", make)


def _matched(s, d):
    """The numeric features of each URL and its part, written, as the steps after it go over them several times."""

    def make():
        rows = models.log_features(features(_urls(s, d)))
        rows = brands.similarity(rows, "label_name", list(V.CURATED_BRANDS)).fillna({"brand_similarity_score": 0.0, "is_exact_brand_match": 0})
        return _parted(models.log_features(rows, models.BRAND))

    return _written(s, d, "matched", make)


def _rows(s, d):
    """The numeric features of each URL, with its part and one of three folds, by domain."""

    def make():
        rows = _matched(s, d)
        kept = rows.where("part = 'fit'").groupBy("tld").agg(F.count("*").alias("m")).where("m >= 100").select("tld", F.lit(True).alias("often"))
        n = rows.count()
        rows = rows.join(kept, "tld", "left").withColumn("tld", F.when(c("tld") == "", "(none)").when(c("often"), c("tld")).otherwise("(other)")).drop("often")
        return _spread(splits.balanced_folds(rows, "domain", 3), n)

    return _written(s, d, "features", make)


def _ngrams(s, d) -> dict:
    """The char n-gram model, chosen by average precision."""
    rows = _masked(s, d)
    fit = _of(rows, "fit")
    n = fit.count()
    weights = _written(s, d, "idf", lambda: models.idf(models.gram_counts(fit), n))
    tried = _of(rows, "fit", "val")
    made = models.vectors(tried, weights).select("id", "label", "part", "features").coalesce(GRADIENTS).cache()
    best, _ = models.grid([models.char_ngram(x, n) for x in STRENGTHS], _of(made, "fit"), _of(made, "val"))
    made.unpersist()
    return {"coefficients": models.stored_coefficients(s, best, weights)}


TREE_FEATURES = [f"log_{n}" for n in (*models.NUMERIC, *models.BRAND)]


def _trees(s, d) -> dict:
    """Leaf-wise trees: the grid by folds, then all training rows."""
    rows = _of(_rows(s, d), "fit", "val")
    made = boosting.bins(rows, TREE_FEATURES, ["tld"])
    return {"model": boosting.tune(rows, made, "fold")[0]}


#: How each kind of model is fitted: the parts of its bundle.
FITTED = {
    "char_ngram": _ngrams,
    "linear": lambda s, d: {"pipeline": models.linear().fit(_of(_rows(s, d), "fit", "val"))},
    "trees": _trees,
    "kmeans": lambda s, d: models.best_minibatch(_of(_rows(s, d), "fit"), _of(_rows(s, d), "val"))[0],
    "density": lambda s, d: models.best_density(_of(_rows(s, d), "fit"), _of(_rows(s, d), "val"))[0],
    "autoencoder": lambda s, d: models.best_autoencoder(_of(_rows(s, d), "fit"), _of(_rows(s, d), "val")),
}


# --- signals ---


def _signals(s, d, coefficients, rows, limit: int = 10):
    """N-gram signals first, then rules, at most `limit`. Offsets refer to the analysed text; where the model reads a folded
    text, n-grams have no place in it and their text is the model's."""
    seg = explain.segments(explain.occurrences(rows, coefficients, column="model_input")).join(rows, "id")
    at = F.when(~c("folded"), text.aligned_span(c("analysed"), c("model_input"), c("start"), c("end")))
    seg = seg.withColumn("at", at)
    shown = F.when(c("at").isNotNull(), F.substring(c("analysed"), c("at.start") + 1, c("at.end") - c("at.start"))).otherwise(F.substring(c("model_input"), c("start") + 1, c("end") - c("start")))
    why = F.concat(F.when(c("weight") > 0, F.lit("raises the score by ")).otherwise(F.lit("lowers the score by ")), F.format_string("%.4f", F.abs("weight")), F.when(c("folded"), F.lit(", in the text with look-alikes replaced")).otherwise(F.lit("")))
    grams = seg.select("id", F.concat(F.lit("ngram-"), "rank").alias("signal"), F.lit("ngram").alias("kind"), F.when(c("weight") > 0, "phishing").otherwise("legitimate").alias("direction"), F.round("weight", 4).alias("weight"), c("at.start").alias("start"), c("at.end").alias("stop"), shown.alias("text"), why.alias("explanation"), c("rank").alias("place"))
    titles = F.create_map(*[F.lit(x) for k, n in enumerate(rules.TITLES) for x in (n, 1000 + k)])
    found = rules.signal_rows(rows, c("analysed")).select("id", c("rule").alias("signal"), F.lit("rule").alias("kind"), F.lit("phishing").alias("direction"), F.lit(None).cast("double").alias("weight"), "start", c("end").alias("stop"), "text", "explanation", titles[c("rule")].alias("place"))
    order = Window.partitionBy("id").orderBy("place", "signal")
    return grams.union(found).withColumn("n", F.row_number().over(order)).where(c("n") <= limit).drop("place")


def _inputs(s, d):
    """The texts of each URL: analysed, and what the model reads, folded where that changes it; written, as signals need them several times."""

    def make():
        rows = brands.model_inputs(_urls(s, d).where(text.check_url(c("url")).isNull()))
        return rows.select("id", c("url").alias("submitted_url"), text.preprocess(c("url")).alias("analysed"), c("defended").alias("model_input"), (c("defended") != c("baseline")).alias("folded"))

    return _written(s, d, "inputs", make)


@query("signals")
def signals(s, d):
    return _signals(s, d, stored(s, d, "char_ngram")["coefficients"], _inputs(s, d))


@query("analyze")
def analyze(s, d):
    """One row per URL that passes the checks: texts, decision by the fitted n-gram model, and its signals."""
    bundle = stored(s, d, "char_ngram")
    rows = _inputs(s, d)
    out = models.linear_scores(rows, bundle["coefficients"], "model_input").withColumnRenamed("probability", "phishing_probability").withColumn("x", text.decide(c("phishing_probability"), bundle["threshold"]))
    found = _signals(s, d, bundle["coefficients"], rows).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "signal"))), lambda x: x["signal"]).alias("signals"))
    return out.join(found, "id", "left").select("id", "submitted_url", c("analysed").alias("analysed_url"), "model_input", "folded", "phishing_probability", c("x.label").alias("verdict"), c("x.confidence").alias("confidence"), c("x.trust").alias("trust_score"), F.coalesce("signals", F.array().cast("array<string>")).alias("signals"))


@query("scoring_conditions")
def scoring_conditions(s, d):
    """One fitted scorer over three texts of each URL, a row per URL and condition."""
    coefficients = stored(s, d, "char_ngram")["coefficients"]
    rows = brands.model_inputs(_urls(s, d).where("url IS NOT NULL"))
    long_ = rows.select("id", F.stack(F.lit(3), *[x for n in ("baseline", "naive_fold", "defended") for x in (F.lit(n), c(n))]).alias("condition", "input"))
    return models.linear_scores(long_, coefficients, "input").select("id", "condition", "input", F.round("probability", 6).alias("p"))


# --- models ---


@query("model_manifest", f"WITH {MODEL} SELECT count(*) AS n, round(sum(coef), 6) AS total FROM cf")
def model_manifest(s, d):
    """Coefficients stored, then loaded only if every byte is as described."""
    path = folders.fresh(s, "coefficients")
    odds = models.log_odds(parts(urls(s, d)).select("id", "rest", "label"))
    seal = bundles.save(s, "char_ngram", path, coefficients=odds.withColumn("idf", F.lit(1.0)))
    return bundles.load(s, path, seal)["coefficients"].agg(F.count("*").alias("n"), F.round(F.sum("coef"), 6).alias("total"))


@query("model_char_ngram")
def model_char_ngram(s, d):
    return bundles.predict(stored(s, d, "char_ngram"), _masked(s, d), "id", "url")


def _scored(kind: str):
    """Every URL by the model of a kind."""

    def run(s, d):
        return bundles.predict(stored(s, d, kind), _rows(s, d), "id", "url")

    return run


query("model_linear")(_scored("linear"))
query("model_trees")(_scored("trees"))
query("model_minibatch")(_scored("kmeans"))
query("model_density")(_scored("density"))
query("model_autoencoder")(_scored("autoencoder"))


@query("model_importance")
def model_importance(s, d):
    found = boosting.importances(stored(s, d, "trees")["model"])
    return s.createDataFrame([(k, n.removeprefix("log_"), round(x, 4)) for k, (n, x) in enumerate(found, 1)], "rank int, feature string, percent double")


@query("model_kmeans")
def model_kmeans(s, d):
    """Full-batch K-means over the whole grid."""
    rows = _rows(s, d)
    fit = _of(rows, "fit")
    best, _ = models.best_clusters(fit, _of(rows, "val"))
    return models.cluster_scores(best, fit, rows, "id", "url")


@query("model_phishing_kinds")
def model_phishing_kinds(s, d):
    best, found, stable = models.kinds_of_phishing(_of(_rows(s, d), "fit", "val").where("label = 1"))
    return stable.select(F.lit(best).alias("k"), F.lit(found[best]).alias("silhouette"), "seed", "ari", "jaccard")


@query("model_reconstruction")
def model_reconstruction(s, d):
    """Errors of a projection on principal components, which an autoencoder is measured against."""
    rows = _rows(s, d)
    fit = _of(rows, "fit")
    model = models.reconstruction().fit(fit.where("label = 0"))
    line = models.platt(models.reconstruction_error(model, _of(rows, "fit", "val")))
    p = 1 / (1 + F.exp(-(float(line.coefficients[0]) * F.ln(c("error") + 1e-12) + float(line.intercept))))
    out = models.reconstruction_error(model, rows).withColumn("phishing_probability", p)
    return out.select("id", "url", "phishing_probability", (c("phishing_probability") >= 0.5).alias("is_phishing"))


@query("model_dispatch")
def model_dispatch(s, d):
    """Every URL by the stored models of all six kinds, each loaded by what it says it is; a missing one is skipped."""
    rows = _rows(s, d).join(_masked(s, d).select("id", "masked"), "id", "left").fillna("", ["masked"])
    out = None
    for kind in (*bundles.KINDS, "other"):
        if bundle := stored(s, d, kind) if kind in FITTED else bundles.load(s, folders.fresh(s, kind)):
            one = bundles.predict(bundle, rows, "id").withColumn("kind", F.lit(bundle["kind"]))
            out = one if out is None else out.unionByName(one)
    return out


@query("minibatch_agreement")
def minibatch_agreement(s, d, ks=(5, 20, 100)):
    """How far one pass of mini-batches agrees with full K-means on the embeddings, by number of clusters."""
    rows = table(s, d, "embeddings", "vec_id", "embedding").where("embedding IS NOT NULL")
    n = rows.count()
    centres = minibatch.fit(rows, [k for k in ks if k <= max(2, n // 2)], "embedding", "vec_id")
    placed = minibatch.assign(rows, centres, "embedding")
    out = None
    for j, k in enumerate(sorted(centres)):
        full = models.KMeans(featuresCol="features", predictionCol="label", k=k, seed=42)
        both = placed.select(models.array_to_vector(c("embedding").cast("array<double>")).alias("features"), c("clusters")[j].alias("cluster"))
        cells = clusters.contingency(full.fit(both).transform(both))
        one = clusters.external(cells).select(F.lit(k).alias("k"), F.round("ari", 6).alias("ari"), F.round("v_measure", 6).alias("v_measure"))
        out = one if out is None else out.union(one)
    return out


@query("density_clusters")
def density_clusters(s, d, least: int = 10):
    """Density clusters of a sample of the embeddings, carried to all of them by their nearest point."""
    rows = table(s, d, "embeddings", "vec_id", "embedding").where("embedding IS NOT NULL")
    held = density.Sample(splits.sample(rows, density.MOST, "vec_id"))
    points = held.clusters(least).select(c("id").alias("vec_id"), c("vector").alias("embedding"), "cluster")
    return clusters.nearest_labelled(rows, points).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))
