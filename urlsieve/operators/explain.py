"""Exact shares of character n-grams in a linear score, merged to spans of the URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.functions import text

CANDIDATES, LEAST_SHARE, LEAST_WEIGHT = 12, 0.1, 0.1
#: Rows, and n-grams of them, that one task holds on average: long rows have many, and are fewer a task.
ROWS, GRAMS = 4_000, 200_000


def occurrences(rows: DataFrame, coefficients: DataFrame, key: str = "id", column: str = "rest", counts: str | None = None) -> DataFrame:
    """(key, start, end, gram, bucket, share): each n-gram's share of the score of a linear model.

    A bucket's value, sublinear count times idf over the row's length, times its coefficient is dealt evenly to the
    occurrences that fall into it. coefficients: bucket, coef and perhaps idf, at most one row for each of text.BUCKETS
    buckets, which bounds what is broadcast; bucket -1 holds the idf of buckets that aren't there. counts names a column
    with the model's own counts (bucket: count, a map) of the row: where they differ from those found here, all its shares
    are null. Rows are dealt out once, by key, so many rows and n-grams to a task; all windows run within a row's n-grams.
    Counting runs when this is called.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(3 * F.length(column)), F.lit(0))).first()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // ROWS + 1, total // GRAMS + 1)
    own = [F.col(counts).alias("_counts")] if counts else []
    grams = rows.select(key, F.col(column).alias("_x"), *own).repartition(parts, key).select(key, *["_counts"] * bool(counts), F.inline(text.ngrams(F.col("_x"))))
    grams = grams.withColumn("bucket", text.bucket(F.col("gram")))
    hits = F.count("*").over(Window.partitionBy(key, "bucket"))
    found = grams.withColumn("hits", hits).join(F.broadcast(coefficients.where("bucket >= 0")), "bucket", "left")
    idf = F.lit(1.0)
    if "idf" in coefficients.columns:
        found = found.crossJoin(F.broadcast(coefficients.where("bucket = -1").agg(F.max("idf").alias("_rare"))))
        idf = F.coalesce("idf", "_rare", F.lit(1.0))
    found = found.withColumn("x", (1 + F.ln("hits")) * idf)
    norm = F.sqrt(F.sum(F.col("x") * F.col("x") / F.col("hits")).over(Window.partitionBy(key)))
    share = F.coalesce("coef", F.lit(0.0)) * F.col("x") / norm / F.col("hits")
    if counts:
        right = F.coalesce(F.try_element_at("_counts", F.col("bucket")) == F.col("hits"), F.lit(False)).cast("int")
        whole = F.sum(F.lit(1.0) / F.col("hits")).over(Window.partitionBy(key))  # the number of buckets
        share = F.when((F.min(right).over(Window.partitionBy(key)) == 1) & (F.round(whole) == F.size("_counts")), share)
    return found.select(key, "start", (F.col("start") + F.length("gram")).alias("end"), "gram", "bucket", share.alias("share"))


def candidates(found: DataFrame, key: str = "id") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("share"), 9)), "start", "end")
    return found.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= CANDIDATES) & (F.abs("share") >= LEAST_SHARE))


def merge_spans(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end): unions of half-open spans that share a place; touching ones stay apart."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    furthest = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (furthest.isNull() | (F.col("start") >= furthest)).cast("int")
    island = spans.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def segments(found: DataFrame, key: str = "id", limit: int = 5) -> DataFrame:
    """(key, rank, start, end, weight): merged spans of one sign with the sum of all shares inside them.

    A row's few candidate spans are gathered and merged beside each of its n-grams, so nothing is joined.
    """
    best = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("share"), 9)), "start", "end")
    sign = F.signum("share").cast("int")
    span = F.when((F.row_number().over(best) <= CANDIDATES) & (F.abs("share") >= LEAST_SHARE) & (sign != 0), F.struct(sign.alias("sign"), "start", "end"))
    every = found.withColumn("_span", span).withColumn("_spans", F.sort_array(F.collect_list("_span").over(Window.partitionBy(key)))).where(F.size("_spans") > 0)

    def merge(done, x):
        last = F.element_at(done, -1)
        grown = F.struct(last["sign"].alias("sign"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((last["sign"] == x["sign"]) & (x["start"] < last["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    rest = F.slice("_spans", 2, F.size("_spans"))
    merged = F.aggregate(rest, F.slice("_spans", 1, 1), merge)
    inside = F.filter(merged, lambda m: (F.col("start") >= m["start"]) & (F.col("end") <= m["end"]))
    inside = F.transform(inside, lambda m: F.struct(m["sign"].alias("sign"), m["start"].alias("from"), m["end"].alias("to")))
    weight = every.select(key, "share", F.inline(inside)).groupBy(key, "sign", "from", "to").agg(F.sum("share").alias("weight"))
    weight = weight.where(F.col("weight") * F.col("sign") >= LEAST_WEIGHT).select(key, F.col("from").alias("start"), F.col("to").alias("end"), "weight")
    order = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("weight"), 9)), "start", "end")
    return weight.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(key, "rank", "start", "end", "weight")


def owners(signals: DataFrame, length: str = "n", key: str = "id") -> DataFrame:
    """(key, start, end, signal): the URL cut to pieces, each owned by the signal of the largest weight there, or by none.

    signals: key, n (the URL's length), signal (ordinal), start, end, weight. No weight ranks under all; ties go to the
    earlier signal.
    """
    place = signals.select(key, F.explode(F.sequence(F.lit(0), F.col(length) - 1)).alias("at"), "signal", "start", "end", "weight")
    covers = F.col("start").isNotNull() & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))
    best = F.max_by(F.when(covers, F.col("signal")), F.when(covers, F.struct(F.coalesce(F.round(F.abs("weight"), 9), F.lit(-1.0)), -F.col("signal"))))
    owned = place.groupBy(key, "at").agg(best.alias("signal"))
    order = Window.partitionBy(key).orderBy("at")
    new = (~F.col("signal").eqNullSafe(F.lag("signal").over(order)) | (F.row_number().over(order) == 1)).cast("int")
    island = owned.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"), F.first("signal").alias("signal")).drop("_island")


def cut_at(pieces: DataFrame, first: Column, last: Column, key: str = "id") -> DataFrame:
    """pieces cut at a selected span, with selected."""
    a, b = F.greatest(F.col("start"), F.least(first, F.col("end"))), F.least(F.col("end"), F.greatest(last, F.col("start")))
    parts = F.array(F.struct(F.col("start").alias("s"), a.alias("e"), F.lit(False).alias("selected")), F.struct(a.alias("s"), F.greatest(a, b).alias("e"), F.lit(True).alias("selected")), F.struct(F.greatest(a, b).alias("s"), F.col("end").alias("e"), F.lit(False).alias("selected")))
    return pieces.select(key, "signal", F.inline(F.filter(parts, lambda p: p["s"] < p["e"]))).select(key, F.col("s").alias("start"), F.col("e").alias("end"), "signal", "selected")
