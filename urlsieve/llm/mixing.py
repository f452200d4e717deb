"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urlsieve.llm.common import free, n_words, quoted, scope, written

#: Weights dealt to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's size as a share of all sizes, and the most often that a document may be taken.
SHARE, MOST = 1.5, 2
#: A document's place is a number of LEVELS * BITS bits; a histogram has 2 ** BITS buckets.
LEVELS, BITS = 4, 12
SEED = "mix-1"


def place(*key: str | Column) -> Column:
    """A 48-bit number from a document's key: what a null holds and what an empty text holds are told apart."""
    parts = [F.coalesce(F.col(quoted(k)).cast("string") if isinstance(k, str) else k, F.lit("\u0001")) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("\u0002", F.lit(SEED), *parts)), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from a row per source: target = min(most * size, rate * weight), one rate for all.

    That rate is what sharing the excess again and again ends in. Sources are filled up in order of size per weight:
    rate = (budget - the limits of the sources filled) / (the weights of the others). Rows are sources, not documents: one
    task sorts them, which holds for millions of sources, not for a source per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(1))
    rows = sizes.withColumn("w", deal).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("filled", F.coalesce(F.sum("cap").over(rising), F.lit(0.0)))
    rows = rows.withColumn("open_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(rising), F.lit(0.0)))
    rows = rows.withColumn("rate", (F.col("budget") - F.col("filled")) / F.col("open_w"))
    # the first source whose limit is above its share fixes the rate; without one all are full
    rate = F.min(F.when(F.col("cap") > F.col("rate") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("rate")))).over(every)["rate"]
    return rows.withColumn("target", F.when(rate.isNull(), F.col("cap")).otherwise(F.least("cap", rate * F.col("w")))).select("source", "source_size", "target")


def thresholds(slim: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, cut): documents of a source whose place is below cut are those to take once more.

    slim: source, place, size. goals: source, budget. At each level sizes are summed by source and bucket, partly on
    the map side; the bucket in which the budget ends is the only one that the next level looks into. Nothing sorts
    documents. The last bucket, one place, is taken if that brings the sum nearer to the budget.
    """
    spark_rows = goals.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("base"), F.lit(True).alias("open"))
    rows = slim
    for level in range(LEVELS):
        step = 2 ** (BITS * (LEVELS - 1 - level))
        inside = rows.alias("d").join(spark_rows.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & F.col("t.open"))
        inside = inside.where((F.col("d.place") >= F.col("t.base")) & (F.col("d.place") < F.col("t.base") + step * 2**BITS))
        bins = inside.groupBy(F.col("t.source").alias("source"), ((F.col("d.place") - F.col("t.base")) / step).cast("long").alias("bin")).agg(F.sum("d.size").alias("size"))
        bins = bins.join(spark_rows.select(F.col("source").alias("s"), "left", "base"), F.col("source").eqNullSafe(F.col("s")))
        run = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("size").over(run)).withColumn("before", F.col("upto") - F.col("size"))
        end = bins.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min_by(F.struct("bin", "before", "upto", "left", "base"), "bin").alias("e"))
        joined = spark_rows.alias("t").join(end.select(F.col("source").alias("s"), "e"), F.col("t.source").eqNullSafe(F.col("s")), "left")
        if level < LEVELS - 1:
            base, left, still = F.col("e.base") + F.col("e.bin") * step, F.col("e.left") - F.col("e.before"), F.lit(True)
        else:
            near = F.col("e.upto") - F.col("e.left") < F.col("e.left") - F.col("e.before")
            base, left, still = F.col("e.base") + F.col("e.bin") + near.cast("long"), F.lit(0.0), F.lit(False)
        past = F.when(F.col("t.open"), F.col("t.base") + step * 2**BITS).otherwise(F.col("t.base"))
        spark_rows = joined.select(F.col("t.source").alias("source"), F.when(F.col("e").isNull(), F.lit(0.0)).otherwise(left).alias("left"), F.when(F.col("e").isNull(), past).otherwise(base).alias("base"), (F.col("e").isNotNull() & still).alias("open"))
        spark_rows = written(spark_rows, "cuts")
    return spark_rows.select("source", F.col("base").alias("cut"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The written (slim, goals): a document's id, source, size and place; a source's size, target, whole and cut.

    The mix takes a document `whole` times, and once more if its place is below `cut`.

    Null text: size 0. Null source: a source of its own, last. Documents of size 0 are taken as their place says, with
    no words. Rows equal in id and text share a place and thus the verdict. Empty input: no rows. Extra columns are
    ignored. The target of a source is size * times at most; whole rounds are taken by all, the rest below a cut.
    """
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(source_col)).cast("string").alias("source"), n_words(quoted(text_col)).alias("size"), key(id_col, text_col).alias("place"))
    with scope(docs.sparkSession) as keep:
        slim = keep(written(slim, "sizes"))
        sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
        goals = written(targets(sums, weights, share, most), "targets")
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
        goals = goals.withColumn("whole", F.least(whole, F.lit(most))).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
        cuts = thresholds(slim, goals).select(F.col("source").alias("s"), "cut")
        goals = goals.join(cuts, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", "whole", "cut")
        return slim, keep(written(goals, "goals"))


def key(id_col: str, text_col: str) -> Column:
    return place(id_col, F.md5(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("\u0001"))))


def mix(docs: DataFrame, most: int = MOST, **kw) -> DataFrame:
    """doc_id, source, size, source_size, target, times (how often the mix takes the document), taken; a row per row."""
    slim, goals = plan(docs, most=most, **kw)
    times = F.least(F.col("whole") + (F.col("place") < F.col("cut")).cast("long"), F.lit(most))
    rows = slim.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return rows.select("doc_id", "source", "size", "place", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, most: int = MOST, **kw) -> DataFrame:
    """The documents of the mix, with the columns of docs, a row taken twice standing twice.

    Only the small table of cuts is joined, by source: documents aren't shuffled as long as that table is under
    Spark's broadcast threshold, which Spark checks. Nulls, ties and repeated rows are as in plan(); other columns may
    have any names.
    """
    _, goals = plan(docs, most=most, **kw)
    of, whole, cut, copy = free(docs, "_of", "_whole", "_cut", "_copy")
    goals = goals.select(F.col("source").alias(of), F.col("whole").alias(whole), F.col("cut").alias(cut))
    times = F.least(F.col(whole) + (key(kw.get("id_col", "doc_id"), kw.get("text_col", "text")) < F.col(cut)).cast("long"), F.lit(most))
    rows = docs.join(goals, F.col(quoted(kw.get("source_col", "source"))).cast("string").eqNullSafe(F.col(of))).where(times > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*[quoted(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "times")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix-1' || chr(2) || coalesce(doc_id::VARCHAR, chr(1)) || chr(2) || md5(coalesce(text, chr(1)))), 1, 12))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
    ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER r, 0)) AS rate
  FROM s WINDOW r AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(rate, cap / w) FROM f WHERE cap > rate * w) * w, cap)) AS target
  FROM f),
h AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM g),
p AS (
  SELECT d.*, h.source_size, h.target, h.whole, h.target - h.whole * h.source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.source, place) AS own
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
q AS (
  SELECT *, CASE WHEN upto <= budget THEN 1 WHEN upto - own <= budget AND upto - budget < budget - (upto - own)
      AND upto = min(CASE WHEN upto > budget THEN upto END) OVER (PARTITION BY source) THEN 1 ELSE 0 END AS more
  FROM p)
SELECT doc_id, size, source_size, target, least(whole + more, 2)::BIGINT * size AS taken, least(whole + more, 2)::BIGINT AS times FROM q
"""
