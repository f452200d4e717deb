"""Set tests, samples, checks of a service's responses, and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve.operators import clusters, reports, splits
from urlsieve.plans.inputs import DOMAINS, domains, parts, table, urls
from urlsieve.plans.table_queries import CL, HASH, SQD, clustered
from urlsieve.sources import files, folders

QUERIES: dict = {}
SQL: dict = {}
c = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_BY_DOMAIN, _BY_ID = (HASH.format(f"'42:' || {x}") + " % 100 < 20" for x in ("domain", "id::VARCHAR"))


@query("assert_disjoint", f"WITH {DOMAINS}, a AS (SELECT domain, {_BY_DOMAIN} AS by_domain, {_BY_ID} AS by_id FROM d) SELECT 'domain' AS split, count(*) AS shared FROM (SELECT domain FROM a WHERE by_domain INTERSECT SELECT domain FROM a WHERE NOT by_domain) UNION ALL SELECT 'id', count(*) FROM (SELECT domain FROM a WHERE by_id INTERSECT SELECT domain FROM a WHERE NOT by_id)")
def assert_disjoint(s, d):
    """How many domains two parts share: none if domains are dealt out, some if rows are."""
    rows = domains(parts(urls(s, d))).withColumn("key", c("id").cast("string"))
    n = lambda by: splits.overlap(splits.by_group(rows, by), "domain").agg(F.count("*").alias("shared"))
    return n("domain").select(F.lit("domain").alias("split"), "shared").union(n("key").select(F.lit("id"), "shared"))


@query("subset_test", "SELECT 'orders' AS side, count(DISTINCT o_custkey) AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customer', count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def subset_test(s, d):
    """How many keys each of two tables has that the other lacks: none if it is a subset."""
    o, k = table(s, d, "orders").select(c("o_custkey").alias("key")), table(s, d, "customer").select(c("c_custkey").alias("key"))
    one = lambda name, a, b: splits.outside(a, b, "key").agg(F.count("*").alias("missing")).select(F.lit(name).alias("side"), "missing")
    return one("orders", o, k).union(one("customer", k, o))


@query("even_subsample", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), k AS (SELECT unnest(range(700)) AS k) SELECT o_orderkey FROM r JOIN k ON (k.k * r.n) // 700 = r.i WHERE r.n > 700 UNION SELECT o_orderkey FROM r WHERE n <= 700")
def even_subsample(s, d):
    return splits.even_sample(table(s, d, "orders", "o_orderkey"), 700, "o_orderkey")


@query("beside_columns", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def beside_columns(s, d):
    """Features and targets that came apart, side by side again by their row key."""
    return reports.beside(table(s, d, "orders", "o_orderkey", "o_totalprice"), table(s, d, "orders", "o_orderkey", "o_orderstatus"), "o_orderkey")


@query("beside_places", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def beside_places(s, d):
    """Features and targets in files of their own, without a key and cut in other places, side by side again by place."""
    rows, paths = table(s, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus"), []
    for parts_, names in ((3, ("o_orderkey", "o_totalprice")), (5, ("o_orderstatus",))):
        paths.append(folders.fresh(s, "beside"))
        rows.repartitionByRange(parts_, "o_orderkey").sortWithinPartitions("o_orderkey").select(*names).write.csv(paths[-1])
    price = rows.schema["o_totalprice"].dataType.simpleString()
    key = rows.schema["o_orderkey"].dataType.simpleString()
    left, right = s.read.schema(f"o_orderkey {key}, o_totalprice {price}").csv(paths[0]), s.read.schema("o_orderstatus string").csv(paths[1])
    return files.beside(left, right)


RESPONSES = """r AS (SELECT event_id, 'r' || event_id AS request_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '007' ELSE (event_id % 60 + 1)::VARCHAR END AS retry_after,
  CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '{"error":{"code":"busy","message":"m","details":null,"request_id":"r' || event_id || '"}}' WHEN 2 THEN '{"error":{"code":"rate_limited","message":"m","request_id":"r' || event_id || '"}}'
  WHEN 3 THEN '{"error":{"code":"rate_limited","message":"m","details":null,"request_id":"x"}}' ELSE '{"error":{"request_id":"r' || event_id || '","details":[],"code":"rate_limited","message":"m"}}' END AS body FROM events)"""


@query("error_shape", f"WITH {RESPONSES} SELECT event_id, coalesce(list_sort(json_keys(body, '$.error')) = ['code', 'details', 'message', 'request_id'] AND json_extract_string(body, '$.error.code') = 'rate_limited' AND json_extract_string(body, '$.error.request_id') = request_id AND regexp_matches(retry_after, '^[0-9]+$') AND TRY_CAST(retry_after AS INT) >= 1, false) AS ok FROM r")
def error_shape(s, d):
    k = c("event_id")
    rid = F.concat(F.lit("r"), k.cast("string"))
    body = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    one = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, body('{"error":{"code":"busy","message":"m","details":null,"request_id":"', rid, '"}}')).when(k % 7 == 2, body('{"error":{"code":"rate_limited","message":"m","request_id":"', rid, '"}}'))
    one = one.when(k % 7 == 3, F.lit('{"error":{"code":"rate_limited","message":"m","details":null,"request_id":"x"}}')).otherwise(body('{"error":{"request_id":"', rid, '","details":[],"code":"rate_limited","message":"m"}}'))
    retry = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "0").when(k % 5 == 2, "007").otherwise((k % 60 + 1).cast("string"))
    return table(s, d, "events", "event_id").select("event_id", reports.well_formed_error(one, "rate_limited", rid, retry).alias("ok"))


#: Of made-up responses, by event_id modulo the number of values' own base: the last value is all other remainders'.
HEADERS = {
    "path": (4, "/docs", "/schema", "/health"), "origin": (5, None, "https://stranger.test", "https://good.test"), "allow": (7, "*", None, "https://good.test"),
    "kind": (8, "text/html", None, "application/json; charset=utf-8"), "options": (9, None, "NoSniff", "other"),
}


def _picked(n: int, *values):
    out = F.when(c("event_id") % n == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:-1], 1):
        out = out.when(c("event_id") % n == i, F.lit(v))
    return out.otherwise(F.lit(values[-1]))


def _picked_sql(n: int, *values) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return f"CASE event_id % {n} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values[:-1])) + f" ELSE {text(values[-1])} END"


#: Answers: what a table's rows say of a service, beside headers dealt out by row.
ANSWERS = f"""h AS (SELECT event_id, {', '.join(f'{_picked_sql(*x)} AS {n}' for n, x in HEADERS.items())},
    event_type || CASE WHEN value >= 50 THEN '/1.2' ELSE '' END AS server, CASE WHEN value >= 20 THEN 200 ELSE 404 END AS status FROM events),
x AS (SELECT event_id, unnest([
    CASE WHEN path IN ('/docs', '/schema') AND status = 200 THEN {{'n': 'docs-open', 'v': path}} END,
    CASE WHEN starts_with(kind, 'application/json') AND lower(options) IS DISTINCT FROM 'nosniff' THEN {{'n': 'json-sniffable', 'v': kind}} END,
    CASE WHEN allow = '*' OR origin = 'https://stranger.test' AND allow IS NOT NULL THEN {{'n': 'origin-open', 'v': allow}} END,
    CASE WHEN regexp_matches(server, '[0-9]') THEN {{'n': 'server-version', 'v': server}} END]) AS f FROM h)"""


@query("header_findings", f"WITH {ANSWERS} SELECT event_id, f.n AS check, f.v AS seen FROM x WHERE f IS NOT NULL")
def header_findings(s, d):
    """What the answers of a service give away."""
    h = {n: _picked(*x) for n, x in HEADERS.items()}
    server = F.concat("event_type", F.when(c("value") >= 50, F.lit("/1.2")).otherwise(F.lit("")))
    status = F.when(c("value") >= 20, 200).otherwise(404)
    rows = table(s, d, "events", "event_id", "event_type", "value")
    rows = rows.select("event_id", h["path"].alias("path"), status.alias("status"), h["origin"].alias("origin"), server.alias("server"), h["allow"].alias("allow_origin"), h["kind"].alias("content_type"), h["options"].alias("content_options"))
    return reports.header_findings(rows, "https://stranger.test", ("/docs", "/schema"), "event_id")


@query("report_markdown", "SELECT '| event_type | n | mean |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL SELECT '# Events' UNION ALL SELECT '| ' || event_type || ' | ' || count(*) || ' | ' || printf('%.3f', round(avg(value), 3)) || ' |' FROM events GROUP BY event_type")
def report_markdown(s, d):
    """A report file's lines, read back."""
    rows = table(s, d, "events", "event_type", "value").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean")).orderBy("event_type")
    path = folders.fresh(s, "report")
    reports.write_report(rows, "Events", path, digits={"mean": 3})
    return s.read.text(path).select(c("value").alias("line")).where("line != ''")


@query("knn1_points", f"WITH {CL}, n AS (SELECT a.vec_id, b.cluster, b.vec_id AS k, round({SQD.format(a='a.embedding', b='b.embedding')}, 9) AS q FROM e a, (SELECT * FROM e WHERE vec_id % 5 = 0) b WHERE a.vec_id % 5 <> 0) SELECT vec_id, arg_min(cluster, (q, k)) AS cluster, round(sqrt(min(q)), 5) AS distance FROM n GROUP BY vec_id")
def knn1_points(s, d):
    """The cluster of the nearest labelled point, for all points without a label."""
    rows = clustered(s, d)
    found = clusters.nearest_labelled(rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0"))
    return found.select("vec_id", c("cluster"), F.round("distance", 5).alias("distance"))
