"""Stored models of six kinds, checked byte by byte before anything of them is parsed, and scoring by whichever kind it is.

A bundle is a folder: each part in a folder of its own (a table as Parquet, a fitted pipeline, or a document of JSON), and
`about`, written last: format, kind, threshold, parts, and the length and SHA-256 of every other file.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.operators import autoencoder, boosting, clusters, minibatch, models
from urlsieve.sources import folders

FORMAT = 1
#: The parts of each kind: a pipeline, a document, or a table's columns.
KINDS = {
    "char_ngram": {"coefficients": "bucket long, coef double, idf double"},
    "linear": {"pipeline": "pipeline"},
    "trees": {"model": "document"},
    "kmeans": {"scaler": "pipeline", "centres": "document", "shares": "cluster int, proba double, prior double"},
    "density": {"scaler": "pipeline", "points": "vec_id long, embedding array<double>, cluster long", "shares": "cluster long, proba double, prior double"},
    "autoencoder": {"scaler": "pipeline", "model": "document", "line": "document"},
}
#: The most points of a density bundle, each of which is compared with every row.
POINTS = 30_000


def _files(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    """Length and SHA-256 of each file in the folder but `about`, by its path inside; Spark's own marks are not among them."""
    base = folders.qualified(spark, path)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = rows.select(F.substring("path", len(base) + 2, 1 << 20).alias("name"), "length", F.sha2("content", 256).alias("digest"))
    return {r.name: (r.length, r.digest) for r in rows.where("name NOT LIKE 'about/%'").collect()}


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    """A text file's bytes without the line's end."""
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return bytes(rows[0].content).decode().removesuffix("\n")


def save(spark: SparkSession, kind: str, path: str, threshold: float = 0.5, **parts) -> str:
    """Writes a bundle; the SHA-256 of its description, which load() can be asked to check."""
    if kind not in KINDS:
        raise ValueError(f"no such kind of model: {kind}")
    if set(parts) != set(KINDS[kind]):
        raise ValueError(f"a bundle of kind {kind} has the parts {', '.join(KINDS[kind])}")
    for name, form in KINDS[kind].items():
        if form == "pipeline":
            parts[name].write().overwrite().save(f"{path}/{name}")
        elif form == "document":
            _write_text(spark, f"{path}/{name}", json.dumps(parts[name]))
        else:
            parts[name].selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in form.split(", ")]).write.mode("overwrite").parquet(f"{path}/{name}")
    about = json.dumps({"format": FORMAT, "kind": kind, "threshold": threshold, "files": _files(spark, path)}, sort_keys=True)
    _write_text(spark, f"{path}/about", about)
    return hashlib.sha256(about.encode()).hexdigest()


def load(spark: SparkSession, path: str, seal: str | None = None) -> dict | None:
    """kind, threshold and parts of a bundle, or None where there is none.

    A description other than the sealed one, an unknown format or kind, and files that are missing, new or other than described
    are errors, raised before any part is parsed.
    """
    try:
        text = _read_text(spark, f"{path}/about")
    except AnalysisException:
        return None
    if seal and hashlib.sha256(text.encode()).hexdigest() != seal:
        raise ValueError("the stored model's description is not the sealed one")
    about = json.loads(text)
    if about.get("format") != FORMAT or about.get("kind") not in KINDS:
        raise ValueError(f"the stored model is of an unknown format or kind: {about.get('format')}, {about.get('kind')}")
    want, found = {k: tuple(v) for k, v in about["files"].items()}, _files(spark, path)
    if bad := sorted(set(want.items()) ^ set(found.items())):
        raise ValueError(f"the stored model differs from its description: {bad[0][0]}")
    out = {"kind": about["kind"], "threshold": about["threshold"]}
    for name, form in KINDS[about["kind"]].items():
        if form == "pipeline":
            out[name] = PipelineModel.load(f"{path}/{name}")
        elif form == "document":
            out[name] = json.loads(_read_text(spark, f"{path}/{name}"))
        else:
            out[name] = spark.read.schema(form).parquet(f"{path}/{name}")
    return out


def _by_cluster(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """rows with the share of their cluster, or the prior for an unseen one; a bundle has a row per cluster."""
    known = F.broadcast(shares.select("cluster", "proba")) if shares.count() <= POINTS else shares.select("cluster", "proba")
    prior = shares.agg(F.max("prior").alias("_prior"))
    return rows.join(known, "cluster", "left").crossJoin(prior).withColumn("phishing_probability", F.coalesce("proba", "_prior"))


def predict(bundle: dict, rows: DataFrame, *keep: str, threshold: float | None = None) -> DataFrame:
    """(keep, phishing_probability, is_phishing) by a bundle of any kind, with its own threshold or another; no rows give none.

    rows has a unique id; n-gram models read `masked`, the others log_ features, trees and linear models `tld`, too.
    """
    cut = bundle["threshold"] if threshold is None else threshold
    if bundle["kind"] == "char_ngram":
        p = models.linear_scores(rows, bundle["coefficients"]).withColumnRenamed("probability", "phishing_probability")
    elif bundle["kind"] == "linear":
        p = bundle["pipeline"].transform(rows).withColumn("phishing_probability", vector_to_array("probability")[1])
    elif bundle["kind"] == "trees":
        p = boosting.scores(bundle["model"], rows, *keep).withColumnRenamed("probability", "phishing_probability")
    elif bundle["kind"] == "kmeans":
        centres = {len(bundle["centres"]): np.array(bundle["centres"])}
        placed = minibatch.assign(models.scaled(bundle["scaler"], rows), centres, "vector").withColumn("cluster", F.col("clusters")[0])
        p = _by_cluster(placed, bundle["shares"])
    elif bundle["kind"] == "density":
        points = models.scaled(bundle["scaler"], rows).select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding"))
        near = clusters.nearest_labelled(points, bundle["points"], POINTS).select(F.col("vec_id").alias("id"), "cluster")
        p = _by_cluster(rows.join(near, "id"), bundle["shares"])
    else:
        lost = autoencoder.errors(bundle["model"], models.scaled(bundle["scaler"], rows), "vector")
        p = lost.withColumn("phishing_probability", 1 / (1 + F.exp(-(bundle["line"]["slope"] * F.ln(F.col("error") + 1e-12) + bundle["line"]["shift"]))))
    return p.select(*keep, "phishing_probability", (F.col("phishing_probability") >= cut).alias("is_phishing"))
