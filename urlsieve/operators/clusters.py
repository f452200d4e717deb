"""Metrics and tables of clusterings, from contingency tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.operators import quantiles, splits


def contingency(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    return rows.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def external(cells: DataFrame) -> DataFrame:
    """ari, homogeneity, completeness, v_measure, nmi (arithmetic mean) and purity."""

    def pairs(x: Column) -> Column:
        return x * (x - 1) / 2.0

    def nlogn(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x)).otherwise(0.0)

    a, b = cells.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("n").alias("top")), cells.groupBy("label").agg(F.sum("n").alias("n"))
    s = cells.agg(F.sum("n").cast("double").alias("t"), F.sum(pairs(F.col("n"))).alias("ij"), F.sum(nlogn(F.col("n"))).alias("hij"))
    s = s.crossJoin(a.agg(F.sum(pairs(F.col("n"))).alias("ai"), F.sum(nlogn(F.col("n"))).alias("ha"), F.sum("top").alias("top")))
    s = s.crossJoin(b.agg(F.sum(pairs(F.col("n"))).alias("bj"), F.sum(nlogn(F.col("n"))).alias("hb")))
    c = F.col
    expected = c("ai") * c("bj") / pairs(c("t"))
    # entropies times t: of clusters, of labels, of labels within clusters, of clusters within labels
    tt = nlogn(c("t"))
    h_label, h_cluster, h_lc, h_cl = tt - c("hb"), tt - c("ha"), c("ha") - c("hij"), c("hb") - c("hij")
    hom = F.when(h_label == 0, 1.0).otherwise(1 - h_lc / h_label)
    com = F.when(h_cluster == 0, 1.0).otherwise(1 - h_cl / h_cluster)
    v = F.when(hom + com == 0, 0.0).otherwise(2 * hom * com / (hom + com))
    nmi = F.when((h_label == 0) & (h_cluster == 0), 1.0).otherwise((h_label - h_lc) / ((h_label + h_cluster) / 2))
    ari = F.when((c("ai") + c("bj")) / 2 == expected, 1.0).otherwise((c("ij") - expected) / ((c("ai") + c("bj")) / 2 - expected))
    return s.select(ari.alias("ari"), hom.alias("homogeneity"), com.alias("completeness"), v.alias("v_measure"), nmi.alias("nmi"), (c("top") / c("t")).alias("purity"))


def jaccard(cells: DataFrame) -> DataFrame:
    """(cluster, best): each cluster's best overlap with the label's groups, intersection over union."""
    of = Window.partitionBy("cluster")
    into = Window.partitionBy("label")
    share = F.col("n") / (F.sum("n").over(of) + F.sum("n").over(into) - F.col("n"))
    return cells.withColumn("j", share).groupBy("cluster").agg(F.max("j").alias("best"))


def probabilities(rows: DataFrame, weight: float = 10.0, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """(cluster, proba, prior): each cluster's share of positives, drawn to the overall share."""
    sums = rows.groupBy(F.col(cluster).alias("cluster")).agg(F.sum(label).alias("s"), F.count("*").alias("m"))
    all_ = Window.partitionBy(F.lit(1))
    prior = F.sum("s").over(all_) / F.sum("m").over(all_)
    return sums.withColumn("prior", prior).select("cluster", ((F.col("s") + weight * F.col("prior")) / (F.col("m") + weight)).alias("proba"), "prior")


def squared(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def centres(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, centre): means by position, so that no cluster's vectors meet in one task."""
    long_ = rows.select(F.col(cluster).alias("cluster"), F.posexplode(vector).alias("pos", "x"))
    means = long_.groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("c")).select("cluster", F.transform("c", lambda p: p["x"]).alias("centre"))


def internal(rows: DataFrame, cluster: str = "cluster", vector: str = "embedding", noise: int = -1) -> DataFrame:
    """davies_bouldin and calinski_harabasz, noise left out. Only centres meet in pairs."""
    rows = rows.where(F.col(cluster) != noise).select(F.col(cluster).alias("cluster"), F.col(vector).alias("v"))
    mid = centres(rows, "cluster", "v")
    all_ = centres(rows.select(F.lit(0).alias("cluster"), "v"), "cluster", "v").select(F.col("centre").alias("m"))
    sq = squared(F.col("v"), F.col("centre"))
    size = rows.join(mid, "cluster").groupBy("cluster").agg(F.count("*").alias("n"), F.sum(sq).alias("w"), F.avg(F.sqrt(sq)).alias("s")).join(mid, "cluster")
    a, b = size.alias("a"), size.alias("b")
    worst = a.join(b, F.col("a.cluster") != F.col("b.cluster")).select(F.col("a.cluster").alias("cluster"), ((F.col("a.s") + F.col("b.s")) / F.sqrt(squared(F.col("a.centre"), F.col("b.centre")))).alias("r")).groupBy("cluster").agg(F.max("r").alias("r"))
    between = size.crossJoin(all_).agg(F.sum(F.col("n") * squared(F.col("centre"), F.col("m"))).alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    k, n = F.col("k"), F.col("n")
    return worst.agg(F.avg("r").alias("davies_bouldin")).crossJoin(between.select((F.col("b") / (k - 1) / (F.col("w") / (n - k))).alias("calinski_harabasz")))


def silhouette(rows: DataFrame, sample: int = 10_000, seed: str = "42", id_col: str = "vec_id", cluster: str = "cluster", vector: str = "embedding") -> DataFrame:
    """Mean silhouette of a bounded sample, whose pairs are compared by blocks of matrix products; the sample is the feature's own bound."""
    pick = splits.sample(rows.where(F.col(cluster) != -1), sample, id_col, seed).select(F.col(cluster).cast("long").alias("c"), F.col(vector).cast("array<double>").alias("v"))
    held = pick.toPandas()
    points, names = _matrix(held.v), held.c.to_numpy()
    groups, at = np.unique(names, return_inverse=True)
    member = np.eye(len(groups))[at] if len(groups) else np.zeros((0, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch.i.to_numpy()
            for k in range(0, len(own), BLOCK):
                part = own[k : k + BLOCK]
                far = np.sqrt(np.maximum(((points[part, None, :] - points[None, :, :]) ** 2).sum(axis=2) if len(points) * len(part) <= EXACT else _squares(points[part], points), 0.0))
                far[np.arange(len(part)), part] = 0.0
                sums, sizes = far @ member, member.sum(axis=0)
                mine = np.arange(len(part)), at[part]
                inner = sums[mine] / np.maximum(sizes[at[part]] - 1, 1)
                means = sums / sizes
                means[mine] = np.inf
                outer = means.min(axis=1)
                alone = (sizes[at[part]] < 2) | ~np.isfinite(outer)
                yield pd.DataFrame({"s": np.where(alone, 0.0, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300))})

    return rows.sparkSession.range(len(points)).select(F.col("id").alias("i")).mapInPandas(run, "s double").agg(F.avg("s").alias("silhouette"))


#: Rows compared at once, and distances up to which they are taken without the shortcut by products.
BLOCK, EXACT = 256, 1 << 17


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :]


def nearest_labelled(points: DataFrame, labelled: DataFrame, most: int = 30_000, id_col: str = "vec_id", vector: str = "embedding", label: str = "cluster") -> DataFrame:
    """(id, label, distance) of each point's nearest labelled one, ties to the least id: a clustering of a sample, carried to all rows.

    The labelled sample has at most `most` rows, which bounds what is sent to each task; more are an error. Points are
    compared with it by blocks of matrix products; nothing is shuffled.
    """
    held = labelled.select(F.col(id_col).cast("long").alias("i"), F.col(label).cast("long").alias("c"), F.col(vector).cast("array<double>").alias("v")).limit(most + 1).toPandas().sort_values("i")
    if len(held) > most:
        raise ValueError(f"at most {most} labelled points are compared with all others")
    known, names = _matrix(held.v), held.c.to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                part = batch.iloc[k : k + BLOCK]
                own = _matrix(part.v)
                best = np.argmin(_squares(own, known).round(9), axis=1)
                yield pd.DataFrame({"i": part.i, "label": names[best], "distance": np.sqrt(((own - known[best]) ** 2).sum(axis=1))})

    rows = points.select(F.col(id_col).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    if not len(held):
        return rows.select(F.col("i").alias(id_col), F.lit(None).cast("long").alias(label), F.lit(None).cast("double").alias("distance"))
    return rows.mapInPandas(run, "i long, label long, distance double").select(F.col("i").alias(id_col), F.col("label").alias(label), "distance")


def profile(rows: DataFrame, features: list[str], cluster: str = "cluster", label: str = "label", top: int = 15) -> DataFrame:
    """(cluster, size, share, medians) of the largest clusters."""
    out = rows.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("size"), F.avg(label).alias("share")).orderBy(F.desc("size"), "cluster").limit(top)
    for f in features:
        out = out.join(quantiles.exact(rows.withColumn("cluster", F.col(cluster)), ["cluster"], f, {f"median_{f}": (0.5, "linear")}), "cluster", "left")
    return out


def z_scores(rows: DataFrame, features: list[str], cluster: str = "cluster", top: int = 3) -> DataFrame:
    """(cluster, feature, z, mean, overall): the features in which a cluster's mean is furthest off, in population deviations."""
    long_ = rows.select(F.col(cluster).alias("cluster"), F.stack(F.lit(len(features)), *[x for f in features for x in (F.lit(f), F.col(f).cast("double"))]).alias("feature", "x"))
    all_ = long_.groupBy("feature").agg(F.avg("x").alias("overall"), F.stddev_pop("x").alias("sd"))
    own = long_.groupBy("cluster", "feature").agg(F.avg("x").alias("mean")).join(all_, "feature")
    z = (F.col("mean") - F.col("overall")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    best = Window.partitionBy("cluster").orderBy(F.desc(F.round(F.abs("z"), 9)), "feature")
    return own.withColumn("z", z).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("cluster", "rank", "feature", "z", "mean", "overall")


def nearest(points: DataFrame, centres_: DataFrame, id_col: str = "vec_id", vector: str = "embedding", key: str = "cluster", centre: str = "centre") -> DataFrame:
    """(id, key, distance) of each point's nearest centre, ties to the least key. The centres are a model: a small, fixed
    number of rows, packed into one that is joined to every point."""
    packed = centres_.agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(centre).alias("c")))).alias("all"))
    far = F.transform("all", lambda x: F.struct(squared(F.col(vector), x["c"]).alias("d"), x["k"].alias("k")))
    return points.crossJoin(F.broadcast(packed)).select(id_col, F.array_min(far).alias("m")).select(id_col, F.col("m.k").alias(key), F.sqrt("m.d").alias("distance"))
