"""Public suffixes of hosts: as columns by a short rule list, or by a join with a list of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.functions import text
from urlsieve.functions import values as V


def clean(host: Column) -> Column:
    """Ideographic dots as dots, no last dots."""
    return F.regexp_replace(F.regexp_replace(host, "[。．｡]", "."), r"\.+$", "")


def _named(host: Column, labels: Column, at: Column) -> tuple[Column, Column, Column, Column]:
    """(suffix, label, subdomain, domain), at being the suffix's first label counted from 1, null without a suffix."""
    ip, n = host.rlike(text.IP), F.size(labels)
    spot = F.coalesce(at - 1, n)
    suffix = F.when(at.isNull() | ip, "").otherwise(F.array_join(F.slice(labels, at, F.greatest(n, F.lit(1))), "."))
    label = F.when(ip, host).when(spot < 1, "").otherwise(F.get(labels, spot - 1))
    subdomain = F.when(ip | (spot < 2), "").otherwise(F.array_join(F.slice(labels, 1, F.greatest(spot - 1, F.lit(0))), "."))
    domain = F.when((suffix != "") & (label != ""), F.concat(label, F.lit("."), suffix)).otherwise(host)
    return suffix, label, subdomain, domain


NAMES = ("suffix", "label_name", "subdomain", "domain")


def attach(rows: DataFrame, host: Column, rules: tuple[str, ...] = V.SUFFIX_RULES, names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """rows with the suffix, label, subdomain and domain of a host, by a short list of rules, * and ! as in suffix lists.

    A host without a known suffix has an empty one and its last label as its name; domain is then the host itself. The
    steps are columns of their own, so that Spark works each out once.
    """
    free, below = ([r[len(sign) :] for r in rules if r.startswith(sign)] for sign in ("!", "*."))
    plain = [r for r in rules if r[:1] not in "!*"]
    rows = rows.withColumn("_h", clean(host)).withColumn("_labels", F.split("_h", r"\."))
    labels, n = F.col("_labels"), F.size("_labels")
    rows = rows.withColumn("_tails", F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")))
    # lists of literals are hash sets to Spark
    last = F.array_position(F.transform("_tails", lambda t: t.isin(plain) | t.isin(free) | F.when(t.contains("."), F.regexp_replace(t, r"^[^.]*\.", "").isin(below)).otherwise(False)), True)
    rows = rows.withColumn("_k", F.when(F.col("_h") != "", F.nullif(last, F.lit(0).cast("long")).cast("int")))
    rows = rows.withColumn("_at", F.when(F.get("_tails", F.col("_k") - 1).isin(free), F.col("_k") + 1).otherwise(F.col("_k")))
    found = _named(F.col("_h"), labels, F.col("_at"))
    return rows.withColumns(dict(zip(names, found, strict=True))).drop("_h", "_labels", "_tails", "_k", "_at")


def rules_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(rule): the built-in rules, or the ICANN part of a public suffix list file."""
    if path is None:
        return spark.createDataFrame([(r,) for r in V.SUFFIX_RULES], "rule string")
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.regexp_extract("value", r"(?s)===BEGIN ICANN DOMAINS===(.*?)// ===END ICANN DOMAINS", 1), "\n")).alias("rule"))
    return lines.select(F.lower(F.trim("rule")).alias("rule")).where("rule != '' AND NOT startswith(rule, '//')")


def split_by(hosts: DataFrame, rules: DataFrame, host_col: str = "host") -> DataFrame:
    """A row per distinct host: host_col, suffix, label_name, subdomain, domain.

    Each host's ends and their wildcard and exception forms meet the rules in one equi-join; the longest wins and an
    exception beats its wildcard. Spark broadcasts the rules if they are under its threshold.
    """
    distinct = hosts.select(F.col(host_col).alias("_h")).where(F.col("_h").isNotNull()).distinct()
    labels = F.split(clean(F.col("_h")), r"\.")
    ends = distinct.select("_h", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("i", "end"))
    forms = ends.select("_h", (F.col("i") + 1).alias("i"), F.explode(F.array(F.col("end"), F.concat(F.lit("!"), "end"), F.concat(F.lit("*."), F.when(F.instr("end", ".") > 0, F.regexp_replace("end", r"^[^.]*\.", "")).otherwise("")))).alias("rule"))
    best = forms.join(rules.select("rule").distinct(), "rule").groupBy("_h").agg(F.min(F.struct("i", (~F.col("rule").startswith("!")).alias("plain"))).alias("b"))
    found = distinct.join(best, "_h", "left").withColumn("_at", F.when(F.col("b.plain"), F.col("b.i")).otherwise(F.col("b.i") + 1))
    names = dict(zip(("suffix", "label_name", "subdomain", "domain"), _named(clean(F.col("_h")), labels, F.when(clean(F.col("_h")) == "", F.lit(None)).otherwise(F.col("_at"))), strict=True))
    return found.select(F.col("_h").alias(host_col), *[c.alias(n) for n, c in names.items()])
