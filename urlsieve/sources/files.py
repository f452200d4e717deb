"""Readers and writers of the interchange files, always with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlsieve.functions import text

URL_SCHEMA = "url string, label int"
RANKING_SCHEMA = "rank int, domain string"
STATS_SCHEMA = "source string, rows long, phishing_share double, ip_host struct<rows:long,phishing_share:double>, punycode_host struct<rows:long,phishing_share:double>, long_url struct<legit_quantile:double,max_typical_length:int,rows:long,phishing_share:double>, tld struct<min_rows:long,min_phishing_share:double,suffixes:map<string,struct<rows:long,phishing_share:double>>>, brand_lookalike struct<min_label_length:int,rows:long,phishing_share:double>"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType = URL_SCHEMA, header: bool = True) -> DataFrame:
    """Quoted fields may hold commas, doubled quotes and line ends; empty, NA and null are null."""
    rows = spark.read.schema(schema).option("header", header).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    names = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType)]
    return rows.withColumns({n: F.when(~F.col(n).isin("", "NA", "NaN", "null", "NULL", "None"), F.col(n)) for n in names})


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RANKING_SCHEMA).csv(path, header=False).where("domain != ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(url): one URL per line, without byte-order mark, outer space and blank lines."""
    line = text.strip(F.regexp_replace("value", "^﻿", ""))
    return spark.read.text(path).select(line.alias("url")).where("url != ''")


def read_json(spark: SparkSession, path: str, schema: str = STATS_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def normalized(rows: DataFrame, source: str, url: str = "url", label: str = "label", inverted: bool = False) -> DataFrame:
    """(url, label, source) of a file with its own names and perhaps an inverted label."""
    y = (1 - F.col(label)) if inverted else F.col(label)
    return rows.select(F.col(url).alias("url"), y.cast("int").alias("label"), F.lit(source).alias("source"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quote", '"').option("escape", '"').csv(path)


def write_parquet(rows: DataFrame, path: str, *partition: str) -> None:
    rows.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def numbered(rows: DataFrame, column: str = "_ordinal") -> DataFrame:
    """rows, as a reader gives them, with their numbers from 0 in order of file name and place in the file.

    Each stretch of a file that is read at once keeps its order; its first number is the count of the rows before it, and
    within it Spark's own increasing numbers give the places, so nothing is sorted.
    """
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    parts = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(parts, ["_file", "_start"]).withColumn(column, F.col("_id") - F.col("_least") + F.col("_before")).drop("_file", "_start", "_id", "_least", "_before")


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of two readers' rows side by side, by place alone: files without a key. Other numbers of rows are an error.

    Columns of one name would be ambiguous and are an error, too.
    """
    if same := {c.lower() for c in left.columns} & {c.lower() for c in right.columns}:
        raise ValueError(f"both sides have columns {', '.join(sorted(same))}")
    sizes = left.count(), right.count()
    if sizes[0] != sizes[1]:
        raise ValueError(f"the sides have {sizes[0]} and {sizes[1]} rows")
    return numbered(left).join(numbered(right), "_ordinal").drop("_ordinal")


def manifest(rows: DataFrame, key: str) -> DataFrame:
    """(n, digest): a table's row count and a digest that no order or partitioning changes, to check a stored model."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("digest"))


def verified(rows: DataFrame, key: str, n: int, digest: str) -> DataFrame:
    """rows, if they are those of the manifest; else an error."""
    found = manifest(rows, key).first()
    if (found.n, found.digest) != (n, digest):
        raise ValueError("the stored model differs from its manifest")
    return rows
