"""Removing passages that stand elsewhere, by overlapping three-line windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm.common import WORD, free, quoted, scope, written

SPAN = 3


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(h1, h2, id, th, pos): a row per window of `span` lines that holds a word; a shorter text is one window.

    h1 and h2 are 128 bits of hash of the lines; id and th (the text's hash) name the document, pos the first line.
    """
    text = F.col(quoted(text_col))
    lines = F.split(text, "\n", -1)
    rows = docs.where(text.isNotNull()).select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("th"), lines.alias("lines"))
    rows = rows.select("id", "th", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), x.rlike(WORD).alias("w"))).alias("l"))

    def window(i):
        part = [F.get("l", i + k) for k in range(span)]
        return F.struct(i.alias("pos"), F.xxhash64(*[p["a"] for p in part]).alias("h1"), F.xxhash64(*[p["b"] for p in part]).alias("h2"), F.exists(F.slice("l", i + 1, span), lambda p: p["w"]).alias("w"))

    starts = F.sequence(F.lit(0), F.greatest(F.size("l") - span, F.lit(0)))
    return rows.select("id", "th", F.inline(F.transform(starts, window))).where("w").select("h1", "h2", "id", "th", "pos")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(id, th, gone): the sorted line positions of each document that later occurrences of a repeated window cover.

    Occurrences are ordered by id (null first), text hash and position. A later one that overlaps the first in the same
    document covers only what lies beyond it. First occurrences are aggregated on the map side; the join that finds the
    others has one row per window on one side, so that AQE splits a window that very many documents share.
    """
    with scope(docs.sparkSession) as keep:
        found = written(windows(docs, id_col, text_col, span), "windows")
        at = F.struct("id", "th", "pos")
        first = found.groupBy("h1", "h2").agg(F.min(at).alias("f"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "f")
        later = found.join(first, ["h1", "h2"]).where(at > F.col("f"))
        own = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("th") == F.col("f.th"))
        start = F.when(own, F.greatest("pos", F.col("f.pos") + span)).otherwise(F.col("pos"))
        spot = later.select("id", "th", F.explode(F.sequence(start, F.col("pos") + span - 1)).alias("at"))
        return keep(written(spot.groupBy("id", "th").agg(F.sort_array(F.collect_set("at")).alias("gone")), "covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, names: tuple[str, str, str] = ("n_lines", "n_removed", "removed")) -> DataFrame:
    """docs with text cleaned, and n_lines, n_removed, removed (the line positions, sorted), or under other names; a row per row.

    A null text stays null with 0 lines; an empty text is one line without a word and is kept. Windows without a word
    never count. A text that is wholly covered becomes empty. Rows equal in id and text count as one document and keep
    the same lines. Columns of docs of the same names as the three new ones are replaced; others may have any names. An
    empty table gives no rows.
    """
    base = docs.drop(*names)
    one, th, lost, n = free(base, "_id", "_th", "_gone", "_n")
    # texts are shuffled once, whatever the size: a broadcast of what is gone would work only while little is
    gone = covered(docs, id_col, text_col, span).select(F.col("id").alias(one), F.col("th").alias(th), F.col("gone").alias(lost)).hint("merge")
    text = F.col(quoted(text_col))
    both = base.join(gone, base[quoted(id_col)].eqNullSafe(F.col(one)) & (F.xxhash64(base[quoted(text_col)]) == F.col(th)), "left")
    lines = F.split(text, "\n", -1)
    both = both.withColumn(n, F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
    both = both.withColumn(lost, F.filter(lost, lambda x: x < F.col(n)))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")), F.col(lost)), lambda i: F.get(lines, i)), "\n")
    clean = F.when(F.col(lost).isNull() | (F.size(lost) == 0), text).otherwise(kept)
    new = F.col(n), F.coalesce(F.size(lost), F.lit(0)).cast("long"), F.coalesce(F.col(lost), F.array().cast("array<int>"))
    return both.select(*[clean.alias(c) if c == text_col else F.col(quoted(c)) for c in base.columns], *[x.alias(name) for x, name in zip(new, names, strict=True)])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), "text")


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, text, i AS pos, l[i + 1 : i + 3] AS win
  FROM (SELECT *, unnest(range(greatest(len(l) - 3, 0)::BIGINT + 1)) AS i FROM d WHERE text IS NOT NULL)
  WHERE regexp_matches(array_to_string(l[i + 1 : i + 3], ' '), '[^\x20\x09-\x0D]')),
f AS (SELECT win, min((doc_id, pos)) AS first FROM w GROUP BY win HAVING count(*) > 1),
g AS (
  SELECT doc_id, list_sort(list(DISTINCT p)) AS gone FROM (
    SELECT w.doc_id, unnest(range(CASE WHEN w.doc_id = f.first[1] THEN greatest(w.pos, f.first[2] + 3) ELSE w.pos END, w.pos + 3)) AS p
    FROM w JOIN f USING (win) WHERE (w.doc_id, w.pos) > f.first) GROUP BY doc_id),
j AS (SELECT d.*, list_filter(coalesce(gone, []), lambda p: p < len(l)) AS gone FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(l) END::BIGINT AS n_lines, len(gone)::BIGINT AS n_removed,
  array_to_string(gone, ',') AS removed,
  CASE WHEN len(gone) = 0 THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i + 1]), chr(10)), '') END AS text
FROM j
"""
