"""Keeping the first spelling of each canonical URL, with the lineage of what went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.functions import text


def ranked(rows: DataFrame, order: list[str], url: str = "url", source: str = "source", ordinal: str = "ordinal") -> DataFrame:
    """rows with url_canonical and first, the best row of its canonical URL: by the sources' order, then the ordinal.

    The first row is an aggregate with map-side combining, so that no key's rows are sorted; unknown sources come last.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), F.col(source)), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    rows = rows.withColumn("url_canonical", text.canonical(F.col(url))).withColumn("_at", F.struct(rank.alias("r"), F.col(ordinal).alias("o")))
    best = rows.groupBy("url_canonical").agg(F.min_by(F.struct(F.col(url).alias("url"), F.col(source).alias("source"), F.col("_at")), "_at").alias("first"))
    return rows.join(best, "url_canonical")


def keep_first(rows: DataFrame, order: list[str], **kw) -> DataFrame:
    return ranked(rows, order, **kw).where(F.col("_at") == F.col("first._at")).drop("_at", "first")


def lineage(rows: DataFrame, order: list[str], url: str = "url", source: str = "source", label: str = "label", **kw) -> DataFrame:
    """dropped_url, dropped_source, kept_url, kept_source, url_canonical and the dropped row's label."""
    gone = ranked(rows, order, url=url, source=source, **kw).where(F.col("_at") != F.col("first._at"))
    return gone.select(F.col(url).alias("dropped_url"), F.col(source).alias("dropped_source"), F.col("first.url").alias("kept_url"), F.col("first.source").alias("kept_source"), "url_canonical", F.col(label).alias("label"))
