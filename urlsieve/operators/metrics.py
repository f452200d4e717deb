"""Metrics of scores against 0/1 labels as relational queries. Undefined values are null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the score range that are summed first, so that running sums never meet in one task.
PARTS = 1000
EPS = 1e-15


def tally(rows: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """(by, score, pos, neg): a row per distinct score, counted on the map side."""
    return rows.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def running(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """counts with tp and fp, the positives and negatives of this score and above, and the totals p and n.

    Sums run within parts of the score range; what lies above a part comes from the at most PARTS + 1 parts' sums.
    """
    part = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))) * PARTS)
    counts = counts.withColumn("_part", part)
    above = Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*by)
    sums = counts.groupBy(*by, "_part").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    sums = sums.select(*by, "_part", F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("_fp"), F.sum("_pos").over(all_).alias("p"), F.sum("_neg").over(all_).alias("n"))
    own = Window.partitionBy(*by, "_part").orderBy(F.desc("score"))
    out = counts.join(sums, [*by, "_part"])
    return out.select(*by, "score", "pos", "neg", (F.sum("pos").over(own) + F.col("_tp")).alias("tp"), (F.sum("neg").over(own) + F.col("_fp")).alias("fp"), "p", "n")


def _grouped(rows: DataFrame, by: Sequence[str]):
    return rows.groupBy(*by) if by else rows.groupBy()


def roc_auc(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties counting half."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0))
    return _grouped(running(counts, by), by).agg(F.try_divide(area, F.max("p") * F.max("n")).alias("roc_auc"))


def average_precision(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision at each distinct score times the growth in recall there."""
    step = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return _grouped(running(counts, by), by).agg(F.try_divide(step, F.max("p")).alias("pr_auc"))


def recall_at_fpr(counts: DataFrame, target: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """Recall at a false-positive rate, interpolated between the curve's points; the highest one at an equal rate."""
    points = running(counts, by).where("p > 0 AND n > 0").select(*by, (F.col("fp") / F.col("n")).alias("x"), (F.col("tp") / F.col("p")).alias("y"))
    at = F.struct("x", "y")
    ends = _grouped(points, by).agg(F.max(F.when(F.col("x") <= target, at)).alias("a"), F.min(F.when(F.col("x") > target, at)).alias("b"))
    x0, y0 = F.coalesce(F.col("a.x"), F.lit(0.0)), F.coalesce(F.col("a.y"), F.lit(0.0))
    between = y0 + (F.col("b.y") - y0) * F.try_divide(F.lit(target) - x0, F.col("b.x") - x0)
    return ends.select(*by, F.when(F.col("b").isNull(), F.col("a.y")).when(x0 == target, y0).otherwise(between).alias("recall_at_fpr"))


def roc_points(counts: DataFrame, most: int = 2000) -> DataFrame:
    """(ordinal, score, tpr, fpr, precision, recall) of every k-th distinct score, descending, so that about `most` are left."""
    points = running(counts)
    # ordinals come from the score parts' sizes, as the running sums do
    part = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))) * PARTS)
    points = points.withColumn("_part", part)
    above = Window.partitionBy(F.lit(1)).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = points.groupBy("_part").agg(F.count("*").alias("_m"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_m").over(above), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(F.lit(1))).alias("_all"))
    own = Window.partitionBy("_part").orderBy(F.desc("score"))
    points = points.join(sizes, "_part").withColumn("ordinal", F.col("_before") + F.row_number().over(own) - 1)
    points = points.where(F.col("ordinal") % F.greatest(F.lit(1), F.floor(F.col("_all") / most)) == 0)
    return points.select("ordinal", "score", F.try_divide(F.col("tp"), F.col("p")).alias("tpr"), F.try_divide(F.col("fp"), F.col("n")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def confusion(rows: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    up = F.col(score) >= threshold
    cells = {"tp": (1, up), "fp": (0, up), "fn": (1, ~up), "tn": (0, ~up)}
    return _grouped(rows, by).agg(*[F.count_if((F.col(label) == y) & hit).alias(n) for n, (y, hit) in cells.items()])


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if empty is None else F.coalesce(r, F.lit(empty))


def rates(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1, accuracy (0 where undefined), specificity, balanced_accuracy, mcc (null where undefined)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    one_class = (tp + fn == 0) | (tn + fp == 0)
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    spec = F.when(one_class, None).otherwise(_ratio(tn, tn + fp))
    mcc = F.when(one_class, None).otherwise(_ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))
    return cells.select(*by, precision.alias("precision"), recall.alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), spec.alias("specificity"), ((recall + spec) / 2).alias("balanced_accuracy"), mcc.alias("mcc"))


def probability_errors(rows: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """mae, mse, rmse and log_loss, probabilities being kept off 0 and 1 in the last."""
    e = F.col(score) - F.col(label)
    p = F.least(F.greatest(F.col(score), F.lit(EPS)), F.lit(1 - EPS))
    loss = -F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p))
    return _grouped(rows, by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(loss).alias("log_loss"))


def per_class(cells: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) of both classes, and their macro and weighted means."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def row(name: str, a: Column, wrong: Column, missed: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), _ratio(a, a + wrong).alias("precision"), _ratio(a, a + missed).alias("recall"), _ratio(2 * a, 2 * a + wrong + missed).alias("f1"), (a + missed).cast("long").alias("support"))

    two = cells.select(F.inline(F.array(row("0", tn, fn, fp), row("1", tp, fp, fn))))
    names = ("precision", "recall", "f1")
    macro = two.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("macro").alias("class"), *names, "support")
    mean = two.agg(*[F.try_divide(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("weighted").alias("class"), *names, "support")
    return two.union(macro).union(mean)
