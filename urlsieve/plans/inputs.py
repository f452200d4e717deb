"""The tables that the catalog's queries share, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.functions import suffix, text
from urlsieve.functions import values as V

#: URLs for branches that no page reaches: id, url, label, source.
EDGES = (
    (900001, "example.com/path", 0, "p0"),
    (900002, "HTTPS://Example.COM/Path/", 0, "p1"),
    (900003, "https://example.com/path///", 1, "p2"),
    (900004, "http://user@paypal.com/login", 1, "p0"),
    (900005, "http://host.example.org:8080/a-b_c", 0, "p3"),
    (900006, "http://1.2.3.4:80/x", 1, "p0"),
    (900007, "192.168.0.1/login.php?x=1&y=2", 1, "p1"),
    (900008, "http://xn--pypal-4ve.com/signin", 1, "p2"),
    (900009, "http://site.org/a#b?c=d", 0, "p3"),
    (900010, "", 0, "p0"),
    (900011, "   ", 0, "p1"),
    (900012, None, 1, "p2"),
    (900013, "localhost/admin", 0, "p3"),
    (900014, "https://shop.brand.co.uk/item?id=7", 0, "p0"),
    (900015, "https://docs.google.com/forms", 0, "p1"),
    (900016, "evil-site.top/paypal/login", 1, "p2"),
    (900017, "http://paypa1.com/verify", 1, "p3"),
    (900018, "secure.wellsfarg0.com/login", 1, "p0"),
    (900019, "http://arnazon.com/account", 1, "p1"),
    (900020, "http://example.com/path", 1, "p3"),
    (900021, "https://long.example.net/" + "a1-" * 45, 1, "p2"),
    (900022, "http://verify-secure-login.xyz/confirm?next=account", 1, "p0"),
    (900023, "ftp://files.example.com/pub", 0, "p1"),
    (900024, "http://a b.com/", 1, "p2"),
    (900025, "https://amaz0n.com.example.ck/q%20r@s", 1, "p3"),
    (900026, "http://www.ck/", 0, "p0"),
    (900027, "www.paypal.com", 0, "p1"),
    (900028, "http://１.２.３.４:８０/x", 1, "p2"),
    (900029, "\t http://ｅxample.org/tab\u00a0", 0, "p3"),
    (900030, "https://shop.example.co.nz/a?b=http://c", 0, "p0"),
    (900031, "http://stats.gov.br:99/", 1, "p1"),
    (900032, "http://user:pw@paypa1.com.au./login", 1, "p2"),
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGES), "id long, url string, label int, source string")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, url, label, source): the pages, labelled and dealt to four sources by id, and the edge cases."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    pages = pages.select(F.col("page_id").alias("id"), "url", (F.col("page_id") % 2).cast("int").alias("label"), F.concat(F.lit("p"), (F.col("page_id") % 4).cast("string")).alias("source"))
    return pages.unionByName(edges(spark))


def parts(rows: DataFrame) -> DataFrame:
    """rows with u (url, null as empty), rest, host_raw, host, after, path and query."""
    rows = rows.withColumn("u", F.coalesce("url", F.lit("")))
    rows = rows.withColumn("rest", text.without_scheme(F.col("u")))
    rows = rows.withColumn("host_raw", text.host_for_features(F.col("rest")))
    rows = rows.withColumn("host", text.without_port(F.lower("host_raw")))
    rows = rows.withColumn("after", text.after_host(F.col("rest"), F.col("host_raw")))
    return rows.withColumn("path", text.path_of(F.col("after"))).withColumn("query", text.query_of(F.col("after")))


def domains(rows: DataFrame, host: str = "host") -> DataFrame:
    """rows with suffix, label, subdomain and domain of the host, by the built-in suffix rules."""
    return suffix.attach(rows, F.col(host))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score, fine, source): score has many ties, fine has few."""
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_discount", "l_linestatus", "l_extendedprice")
    fine = F.round(F.col("l_extendedprice") % 1000 / 1000, 6)
    return rows.select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.round(F.col("l_discount") * 10, 6).alias("score"), fine.alias("fine"), F.col("l_linestatus").alias("source"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, source, lang, quality, toxic) of all documents; labels of some are null."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return docs.join(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), "doc_id", "left")


def sql_string(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(map(sql_string, values)) + "]"


_EDGES_SQL = ", ".join(f"({i}, {sql_string(u)}, {label}, '{s}')" for i, u, label, s in EDGES)

#: CTEs: urls; p adds u, rest, host_raw, host, after, path and query.
URLS = f"""urls AS (SELECT page_id AS id, url, (page_id % 2)::INT AS label, 'p' || (page_id % 4)::VARCHAR AS source FROM pages
  UNION ALL SELECT * FROM (VALUES {_EDGES_SQL}) AS e(id, url, label, source))"""
_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://"
PARTS = rf"""{URLS},
p0 AS (SELECT *, coalesce(url, '') AS u, regexp_replace(coalesce(url, ''), '{_SCHEME}', '') AS rest FROM urls),
p1 AS (SELECT *, regexp_replace(regexp_extract(rest, '^[^/?#]*'), '(?s)^.*@', '') AS host_raw FROM p0),
p2 AS (SELECT *, regexp_replace(lower(host_raw), ':\p{{Nd}}+$', '') AS host, CASE WHEN starts_with(rest, host_raw) THEN substr(rest, length(host_raw) + 1) ELSE rest END AS after FROM p1),
p AS (SELECT *, regexp_extract(after, '^[^?#]*') AS path, regexp_extract(after, '(?s)^[^?]*\?([^#]*)', 1) AS query FROM p2)"""
#: d adds suffix, label_name, subdomain and domain to p.
DOMAINS = f"""{PARTS}, rules AS (SELECT {sql_list(V.SUFFIX_RULES)} AS r),
s0 AS (SELECT p.*, rtrim(host, '.') AS h, string_split(rtrim(host, '.'), '.') AS l FROM p),
s1 AS (SELECT s0.*, list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.')) AS c FROM s0),
s2 AS (SELECT s1.*, list_filter(range(1, len(l) + 1), lambda i: list_contains(r, c[i]) OR list_contains(r, '!' || c[i]) OR list_contains(r, '*.' || array_to_string(l[i + 1:], '.')))[1] AS k, r FROM s1, rules),
s3 AS (SELECT *, CASE WHEN h = '' OR regexp_matches(h, '^(?:\\p{{Nd}}{{1,3}}\\.){{3}}\\p{{Nd}}{{1,3}}$') THEN NULL WHEN k IS NOT NULL AND list_contains(r, '!' || c[k]) THEN k + 1 ELSE k END AS pos FROM s2),
s4 AS (SELECT *, CASE WHEN pos IS NULL THEN '' ELSE c[pos] END AS suffix,
  CASE WHEN regexp_matches(h, '^(?:\\p{{Nd}}{{1,3}}\\.){{3}}\\p{{Nd}}{{1,3}}$') THEN h WHEN pos = 1 THEN '' ELSE l[coalesce(pos - 1, len(l))] END AS label_name,
  CASE WHEN regexp_matches(h, '^(?:\\p{{Nd}}{{1,3}}\\.){{3}}\\p{{Nd}}{{1,3}}$') THEN '' ELSE array_to_string(l[1 : greatest(coalesce(pos - 1, len(l)) - 1, 0)], '.') END AS subdomain FROM s3),
d AS (SELECT *, CASE WHEN suffix <> '' AND label_name <> '' THEN label_name || '.' || suffix ELSE h END AS domain FROM s4)""".replace("\\\\.", "\\.")
SCORED = """scored AS (SELECT (l_returnflag = 'R')::INT AS label, round(l_discount * 10, 6) AS score, round(l_extendedprice % 1000 / 1000, 6) AS fine, l_linestatus AS source FROM lineitem)"""
LABELLED = "labelled AS (SELECT d.doc_id, d.text, d.source, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def literal_list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])
