"""Dedup, splits, aggregates, rankings, set operations, decisions, metrics and cluster tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from urlsieve.functions import text
from urlsieve.functions import values as V
from urlsieve.operators import clusters, dedup, metrics, quantiles, splits
from urlsieve.plans.inputs import DOMAINS, LABELLED, PARTS, SCORED, URLS, domains, labelled, parts, scored, sql_list, table, urls
from urlsieve.plans.text_queries import CANON

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


# --- sources with a plain equivalent, projections, dedup ---


@query("src_parquet", "SELECT * FROM orders")
def src_parquet(s, d):
    return table(s, d, "orders")


@query("src_pruned", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_quantity >= 30")
def src_pruned(s, d):
    return table(s, d, "lineitem").where(c("l_quantity") >= 30).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("project_normalize", f"WITH {URLS} SELECT url, 1 - label AS label, 'inverted' AS source FROM urls")
def project_normalize(s, d):
    return urls(s, d).select("url", (1 - c("label")).alias("label"), F.lit("inverted").alias("source"))


ORDER = ["p2", "p0", "p3", "p1"]
RANKED = f"{URLS}, k AS (SELECT *, {CANON} AS url_canonical, coalesce(list_position({sql_list(ORDER)}, source), 5) AS r FROM urls), w AS (SELECT *, row_number() OVER (PARTITION BY url_canonical ORDER BY r, id) AS n, first_value(url) OVER (PARTITION BY url_canonical ORDER BY r, id) AS kept_url, first_value(source) OVER (PARTITION BY url_canonical ORDER BY r, id) AS kept_source FROM k)"


def ordered_urls(s, d):
    return urls(s, d).withColumn("ordinal", c("id"))


@query("dedup_keep_first", f"WITH {RANKED} SELECT id, url, label, source FROM w WHERE n = 1")
def dedup_keep_first(s, d):
    return dedup.keep_first(ordered_urls(s, d), ORDER).select("id", "url", "label", "source")


@query("dedup_lineage", f"WITH {RANKED} SELECT url AS dropped_url, source AS dropped_source, kept_url, kept_source, url_canonical, label FROM w WHERE n > 1")
def dedup_lineage(s, d):
    return dedup.lineage(ordered_urls(s, d), ORDER)


DOC_RANKED = "k AS (SELECT doc_id, text, source, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS n, first_value(source) OVER (PARTITION BY text ORDER BY source, doc_id) AS kept FROM documents)"


@query("dedup_documents", f"WITH {DOC_RANKED} SELECT doc_id, source FROM k WHERE n = 1")
def dedup_documents(s, d):
    docs = table(s, d, "documents", "doc_id", "text", "source")
    first = docs.groupBy("text").agg(F.min(F.struct("source", "doc_id")).alias("f"))
    return first.select("f.doc_id", "f.source")


@query("dup_pairs", f"WITH {DOC_RANKED} SELECT source AS dropped_source, kept AS kept_source, count(*) AS n FROM k WHERE n > 1 GROUP BY ALL")
def dup_pairs(s, d):
    docs = table(s, d, "documents", "doc_id", "text", "source").withColumn("h", F.md5("text"))
    first = docs.groupBy("h").agg(F.min(F.struct("source", "doc_id")).alias("f"))
    gone = docs.select("doc_id", "source", "h").join(first, "h").where(c("doc_id") != c("f.doc_id"))
    return gone.groupBy(c("source").alias("dropped_source"), c("f.source").alias("kept_source")).agg(F.count("*").alias("n"))


# --- aggregates ---


@query("counts_by_source", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source")
def counts_by_source(s, d):
    return table(s, d, "documents", "source").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("pivot_source_label", f"WITH {LABELLED} SELECT source, count_if(quality = 0)::BIGINT AS label_0, count_if(quality = 1)::BIGINT AS label_1 FROM labelled WHERE quality IS NOT NULL GROUP BY source")
def pivot_source_label(s, d):
    out = labelled(s, d).where("quality IS NOT NULL").groupBy("source").pivot("quality", [0, 1]).count()
    return out.fillna(0).select("source", c("0").alias("label_0"), c("1").alias("label_1"))


@query("class_balance", f"WITH {LABELLED} SELECT quality, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM labelled WHERE quality IS NOT NULL GROUP BY quality")
def class_balance(s, d):
    n = labelled(s, d).where("quality IS NOT NULL").groupBy("quality").agg(F.count("*").alias("n"))
    return n.select("quality", "n", F.round(100.0 * c("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2).alias("pct"))


def linear(*shares):
    return {f"p{round(q * 100)}": (q, "linear") for q in shares}


def described(x, by, rows):
    ps = quantiles.exact(rows, [by], x, linear(0.25, 0.5, 0.75))
    plain = rows.groupBy(by).agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))
    return plain.join(ps, by).select(by, "n", "mean", "std", "least", *[F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")], "most")


@query("length_describe", f"WITH {PARTS} SELECT label, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS least, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, max(x) AS most FROM (SELECT label, length(rest)::INT AS x FROM p) GROUP BY label")
def length_describe(s, d):
    rows = parts(urls(s, d)).select("label", F.length("rest").alias("x"))
    found = quantiles.described(rows, ["label"], "x", linear(0.25, 0.5, 0.75))
    return found.select("label", "n", *[F.round(x, 6).alias(x) for x in ("mean", "std")], "least", *[F.round(p, 6).alias(p) for p in ("p25", "p50", "p75")], "most")


@query("error_describe", "SELECT count(*) AS n, round(avg(e), 6) AS mean, " + ", ".join(f"round(quantile_cont(e, {q}), 6) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.95)) + " FROM (SELECT round(abs(l_discount * 10 - (l_returnflag = 'R')::INT), 6) AS e FROM lineitem)")
def error_describe(s, d):
    e = scored(s, d).select(F.round(F.abs(c("score") - c("label")), 6).alias("e"))
    ps = quantiles.exact(e, [], "e", linear(0.25, 0.5, 0.75, 0.95))
    return e.agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("mean")).crossJoin(ps).select("n", "mean", *[F.round(p, 6).alias(p) for p in ps.columns])


@query("mean_by_label", f"WITH {PARTS} SELECT label, round(avg(length(rest)), 6) AS mean_length, round(avg((path <> '')::INT), 6) AS has_path, round(avg(contains(u, 'www')::INT), 6) AS has_www FROM p GROUP BY label")
def mean_by_label(s, d):
    return parts(urls(s, d)).groupBy("label").agg(F.round(F.avg(F.length("rest")), 6).alias("mean_length"), F.round(F.avg((c("path") != "").cast("int")), 6).alias("has_path"), F.round(F.avg(c("u").contains("www").cast("int")), 6).alias("has_www"))


@query("tld_risk", f"WITH {DOMAINS} SELECT suffix, count(*) AS n, round(avg(label), 4) AS share FROM d WHERE suffix <> '' GROUP BY suffix HAVING count(*) >= 1 AND avg(label) >= 0.4")
def tld_risk(s, d, rows: int = 1, least: float = 0.4):
    out = domains(parts(urls(s, d))).where("suffix != ''").groupBy("suffix").agg(F.count("*").alias("n"), F.avg("label").alias("m"))
    return out.where((c("n") >= rows) & (c("m") >= least)).select("suffix", "n", F.round("m", 4).alias("share"))


@query("long_cutoff", f"WITH {PARTS} SELECT quantile_cont(length(rest), 0.99)::DOUBLE::INT AS cutoff FROM (SELECT * FROM p WHERE label = 0)".replace("quantile_cont(length(rest), 0.99)::DOUBLE::INT", "floor(quantile_cont(length(rest), 0.99))::INT"))
def long_cutoff(s, d):
    return parts(urls(s, d)).where("label = 0").agg(F.floor(F.percentile(F.length("rest"), F.lit(0.99))).cast("int").alias("cutoff"))


@query("rule_stats", f"WITH {DOMAINS} SELECT count(*) AS n, round(avg(label), 4) AS share, " + ", ".join(f"count_if({p})::BIGINT AS {n}_rows, round(avg(CASE WHEN {p} THEN label END), 4) AS {n}_share" for n, p in (("ip", r"regexp_matches(host, '^(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}$')"), ("puny", "contains(host, 'xn--')"), ("long", "length(rest) > 136"))) + " FROM d")
def rule_stats(s, d):
    rules = {"ip": c("host").rlike(text.IP), "puny": c("host").contains("xn--"), "long": F.length("rest") > V.LONG_URL}
    aggs = [x for n, p in rules.items() for x in (F.count_if(p).alias(f"{n}_rows"), F.round(F.avg(F.when(p, c("label"))), 4).alias(f"{n}_share"))]
    return domains(parts(urls(s, d))).agg(F.count("*").alias("n"), F.round(F.avg("label"), 4).alias("share"), *aggs)


@query("distinct_domains", f"WITH {DOMAINS} SELECT count(DISTINCT domain) AS n_domains, count(DISTINCT CASE WHEN label = 1 THEN domain END) AS n_bad, count(DISTINCT suffix) AS n_suffixes FROM d")
def distinct_domains(s, d):
    return domains(parts(urls(s, d))).agg(F.countDistinct("domain").alias("n_domains"), F.countDistinct(F.when(c("label") == 1, c("domain"))).alias("n_bad"), F.countDistinct("suffix").alias("n_suffixes"))


@query("top_tld", f"WITH {DOMAINS}, n AS (SELECT label, suffix, count(*) AS n FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, suffix) AS rank, round(n::DOUBLE / sum(n) OVER (PARTITION BY label), 4) AS share FROM n) SELECT label, rank::INT AS rank, suffix, n, share FROM r WHERE rank <= 8")
def top_tld(s, d):
    n = domains(parts(urls(s, d))).groupBy("label", "suffix").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label")
    n = n.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "suffix"))).withColumn("share", F.round(c("n") / F.sum("n").over(w), 4))
    return n.where("rank <= 8").select("label", "rank", "suffix", "n", "share")


@query("proba_quantiles", f"WITH {SCORED} SELECT label, " + ", ".join(f"round(quantile_cont(fine, {q}), 3) AS q{int(q * 10)}" for q in (0.1, 0.5, 0.9)) + " FROM scored GROUP BY label")
def proba_quantiles(s, d):
    ps = quantiles.exact(scored(s, d), ["label"], "fine", {f"q{int(q * 10)}": (q, "linear") for q in (0.1, 0.5, 0.9)})
    return ps.select("label", *[F.round(q, 3).alias(q) for q in ps.columns[1:]])


@query("error_by_source", f"WITH {SCORED} SELECT source, round(avg(CASE WHEN label = 1 THEN (score < 0.5)::INT END), 6) AS miss_rate, round(avg(CASE WHEN label = 0 THEN (score >= 0.5)::INT END), 6) AS alarm_rate FROM scored GROUP BY source")
def error_by_source(s, d):
    rate = lambda y, hit: F.round(F.avg(F.when(c("label") == y, hit.cast("int"))), 6)
    return scored(s, d).groupBy("source").agg(rate(1, c("score") < 0.5).alias("miss_rate"), rate(0, c("score") >= 0.5).alias("alarm_rate"))


CUTS = (0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


@query("threshold_sweep", f"WITH {SCORED}, t AS (SELECT unnest({list(CUTS)})::DOUBLE AS t) SELECT t, count_if(fine >= t)::BIGINT AS n, round(avg(CASE WHEN fine >= t THEN label END), 6) AS share FROM scored, t GROUP BY t")
def threshold_sweep(s, d):
    aggs = [x for i, t in enumerate(CUTS) for x in (F.count_if(c("fine") >= t).alias(f"n{i}"), F.round(F.avg(F.when(c("fine") >= t, c("label"))), 6).alias(f"s{i}"))]
    row = scored(s, d).agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(F.lit(t).alias("t"), c(f"n{i}").alias("n"), c(f"s{i}").alias("share")) for i, t in enumerate(CUTS)])))


@query("source_lift", f"WITH {SCORED} SELECT source, count(*) AS base_n, round(avg(label), 6) AS base, count_if(fine >= 0.85)::BIGINT AS flagged_n, round(avg(CASE WHEN fine >= 0.85 THEN label END), 6) AS flagged, round(avg(CASE WHEN fine >= 0.85 THEN label END) / avg(label), 6) AS lift FROM scored GROUP BY source")
def source_lift(s, d):
    hit = F.avg(F.when(c("fine") >= 0.85, c("label")))
    return scored(s, d).groupBy("source").agg(F.count("*").alias("base_n"), F.round(F.avg("label"), 6).alias("base"), F.count_if(c("fine") >= 0.85).alias("flagged_n"), F.round(hit, 6).alias("flagged"), F.round(F.try_divide(hit, F.avg("label")), 6).alias("lift"))


@query("rate_dist", "SELECT event_type, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most, round(median(value), 4) AS median FROM events GROUP BY event_type")
def rate_dist(s, d):
    rows = table(s, d, "events", "event_type", "value")
    plain = rows.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"))
    middle = quantiles.exact(rows, ["event_type"], "value", {"median": (0.5, "linear")})
    both = plain.alias("p").join(middle.alias("m"), c("p.event_type").eqNullSafe(c("m.event_type")), "left")
    return both.select("p.event_type", "mean", "least", "most", F.round("median", 4).alias("median"))


@query("latency_p95", "SELECT event_type, quantile_disc(value, 0.95) AS nearest_rank, round(quantile_cont(value, 0.95), 6) AS linear FROM events GROUP BY event_type")
def latency_p95(s, d):
    ps = quantiles.exact(table(s, d, "events", "event_type", "value"), ["event_type"], "value", {"nearest_rank": (0.95, "nearest"), "linear": (0.95, "linear")})
    return ps.select("event_type", "nearest_rank", F.round("linear", 6).alias("linear"))


@query("status_stats", "SELECT event_type AS status, count(*) AS n, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type")
def status_stats(s, d):
    rows = table(s, d, "events", c("event_type").alias("status"), "value")
    ps = quantiles.exact(rows, ["status"], "value", {"median": (0.5, "linear"), "p95": (0.95, "nearest")})
    plain = rows.groupBy("status").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    both = plain.alias("p").join(ps.alias("q"), c("p.status").eqNullSafe(c("q.status")), "left")
    return both.select("p.status", "n", F.round("median", 6).alias("median"), "p95", "most")


@query("latency_ratio", "SELECT round(CASE WHEN b <> 0 THEN a / b END, 6) AS median_ratio FROM (SELECT median(CASE WHEN event_type = 'click' THEN value END) AS a, median(CASE WHEN event_type <> 'click' THEN value END) AS b FROM events)")
def latency_ratio(s, d):
    rows = table(s, d, "events", "event_type", "value").select((c("event_type") == "click").alias("click"), "value")
    e = quantiles.exact(rows, ["click"], "value", {"m": (0.5, "linear")})
    return e.agg(F.max(F.when(c("click"), c("m"))).alias("a"), F.max(F.when(~c("click"), c("m"))).alias("b")).select(F.round(F.try_divide("a", "b"), 6).alias("median_ratio"))


@query("first_denied", "SELECT user_id, min(CASE WHEN value > 90 THEN n END) AS first_high FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) GROUP BY user_id")
def first_denied(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(s, d, "events", "user_id", "ts", "event_id", "value").withColumn("n", F.row_number().over(w).cast("long") - 1)
    return rows.groupBy("user_id").agg(F.min(F.when(c("value") > 90, c("n"))).alias("first_high"))


@query("retry_after_values", "SELECT event_type, list_sort(list(DISTINCT floor(value)::INT)) AS seconds FROM events WHERE value < 20 GROUP BY event_type")
def retry_after_values(s, d):
    return table(s, d, "events", "event_type", "value").where("value < 20").groupBy("event_type").agg(F.sort_array(F.collect_set(F.floor("value").cast("int"))).alias("seconds"))


@query("adaptive_rate", "SELECT o_orderstatus AS strategy, round(avg(hit::INT), 6) AS rate, count(*) AS n FROM (SELECT o_orderstatus, o_custkey, bool_or(o_totalprice > 300000) AS hit FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def adaptive_rate(s, d):
    base = table(s, d, "orders", "o_orderstatus", "o_custkey", "o_totalprice").groupBy("o_orderstatus", "o_custkey").agg(F.bool_or(c("o_totalprice") > 300000).alias("hit"))
    return base.groupBy(c("o_orderstatus").alias("strategy")).agg(F.round(F.avg(c("hit").cast("int")), 6).alias("rate"), F.count("*").alias("n"))


@query("evasion_rate", "SELECT count_if(l_returnflag = 'R' AND l_discount < 0.05)::BIGINT AS n, count_if(l_returnflag = 'R')::BIGINT AS of, round(count_if(l_returnflag = 'R' AND l_discount < 0.05)::DOUBLE / nullif(count_if(l_returnflag = 'R'), 0), 6) AS rate FROM lineitem")
def evasion_rate(s, d):
    a, b = F.count_if((c("label") == 1) & (c("score") < 0.5)), F.count_if(c("label") == 1)
    return scored(s, d).agg(a.alias("n"), b.alias("of"), F.round(F.try_divide(a, b), 6).alias("rate"))


@query("evasion_by_strategy", f"WITH {SCORED} SELECT source AS strategy, label, count(*) AS n, round(avg((fine < 0.5)::INT), 6) AS rate FROM scored GROUP BY GROUPING SETS ((source, label), (source), ())")
def evasion_by_strategy(s, d):
    rows = scored(s, d)
    return rows.groupingSets([[c("source"), c("label")], [c("source")], []], "source", "label").agg(F.count("*").alias("n"), F.round(F.avg((c("fine") < 0.5).cast("int")), 6).alias("rate")).withColumnRenamed("source", "strategy")


@query("accuracy_rollup", f"WITH {SCORED} SELECT source AS category, label AS expected, count(*) AS n, round(avg(((score >= 0.5)::INT = label)::INT), 6) AS accuracy FROM scored GROUP BY GROUPING SETS ((source, label), (label), ())")
def accuracy_rollup(s, d):
    right = ((c("score") >= 0.5).cast("int") == c("label")).cast("int")
    out = scored(s, d).groupingSets([[c("source"), c("label")], [c("label")], []], "source", "label").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"))
    return out.select(c("source").alias("category"), c("label").alias("expected"), "n", "accuracy")


@query("accuracy_by_category", f"WITH {LABELLED}, w AS (SELECT lang, (quality = (length(text) > 500)::INT)::INT AS a, (quality = (length(text) > 2000)::INT)::INT AS b FROM labelled) SELECT lang, model, round(avg(CASE model WHEN 'short' THEN a ELSE b END), 6) AS accuracy, count(CASE model WHEN 'short' THEN a ELSE b END) AS n FROM w, (VALUES ('short'), ('long')) m(model) GROUP BY lang, model")
def accuracy_by_category(s, d):
    right = lambda n: (c("quality") == (F.length("text") > n).cast("int")).cast("int")
    rows = labelled(s, d).select("lang", F.stack(F.lit(2), F.lit("short"), right(500), F.lit("long"), right(2000)).alias("model", "ok"))
    return rows.groupBy("lang", "model").agg(F.round(F.avg("ok"), 6).alias("accuracy"), F.count("ok").alias("n"))


@query("paired_change", "SELECT count_if(a AND NOT b)::BIGINT AS lost, count_if(b AND NOT a)::BIGINT AS gained, count_if(a AND b)::BIGINT AS both_hit, count(*) AS n FROM (SELECT bool_or(l_discount > 0.05) AS a, bool_or(l_tax > 0.04) AS b FROM lineitem GROUP BY l_orderkey)")
def paired_change(s, d):
    x = table(s, d, "lineitem", "l_orderkey", "l_discount", "l_tax")
    a = x.groupBy("l_orderkey").agg(F.bool_or(c("l_discount") > 0.05).alias("a"))
    b = x.groupBy("l_orderkey").agg(F.bool_or(c("l_tax") > 0.04).alias("b"))
    return a.join(b, "l_orderkey").agg(F.count_if(c("a") & ~c("b")).alias("lost"), F.count_if(c("b") & ~c("a")).alias("gained"), F.count_if(c("a") & c("b")).alias("both_hit"), F.count("*").alias("n"))


@query("paired_diff", "SELECT round(avg(x), 4) AS mean, round(min(x), 4) AS least, round(max(x), 4) AS most, round(median(x), 4) AS median, count_if(x > 0)::BIGINT AS helped, count_if(x = 0)::BIGINT AS equal, count_if(x < 0)::BIGINT AS hurt FROM (SELECT round(avg(CASE WHEN event_type = 'click' THEN value END) - avg(CASE WHEN event_type = 'view' THEN value END), 9) AS x FROM events GROUP BY user_id) WHERE x IS NOT NULL")
def paired_diff(s, d):
    e = table(s, d, "events", "user_id", "event_type", "value")
    mean = lambda kind, name: e.where(c("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias(name))
    x = mean("click", "a").join(mean("view", "b"), "user_id").select(F.round(c("a") - c("b"), 9).alias("x"))
    middle = quantiles.exact(x, [], "x", {"median": (0.5, "linear")}).select(F.round("median", 4).alias("median"))
    return middle.crossJoin(x.agg(F.round(F.avg("x"), 4).alias("mean"), F.round(F.min("x"), 4).alias("least"), F.round(F.max("x"), 4).alias("most"), F.count_if(c("x") > 0).alias("helped"), F.count_if(c("x") == 0).alias("equal"), F.count_if(c("x") < 0).alias("hurt")))


@query("variants_by_base", "SELECT o_custkey AS base, list_sort(list(o_orderkey)) AS keys FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def variants_by_base(s, d):
    return table(s, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("base")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))


@query("fingerprint", "SELECT sha256(string_agg(h, chr(10) ORDER BY b)) AS digest FROM (SELECT page_id // 65536 AS b, sha256(string_agg(url, chr(10) ORDER BY page_id)) AS h FROM pages GROUP BY b)")
def fingerprint(s, d, block: int = 65536):
    """Order-sensitive digest of all URLs: of the digests of blocks of ids, so that no task holds all URLs."""

    def digest(key, value):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), "\n"), 256)

    blocks = table(s, d, "pages", "page_id", "url").groupBy(F.floor(c("page_id") / block).alias("b")).agg(digest("page_id", "url").alias("h"))
    return blocks.agg(digest("b", "h").alias("digest"))


@query("argmax_metric", "SELECT arg_max(p_brand, (p_retailprice, p_partkey)) AS dearest, arg_min(p_brand, (p_retailprice, p_partkey)) AS cheapest FROM part")
def argmax_metric(s, d):
    at = F.struct("p_retailprice", "p_partkey")
    return table(s, d, "part", "p_brand", "p_retailprice", "p_partkey").agg(F.max_by("p_brand", at).alias("dearest"), F.min_by("p_brand", at).alias("cheapest"))


@query("best_per_family", "SELECT p_brand, arg_max(p_name, (p_retailprice, -p_partkey)) AS best, max(p_retailprice) AS price FROM part GROUP BY p_brand")
def best_per_family(s, d):
    return table(s, d, "part", "p_brand", "p_name", "p_retailprice", "p_partkey").groupBy("p_brand").agg(F.max_by("p_name", F.struct(c("p_retailprice"), -c("p_partkey"))).alias("best"), F.max("p_retailprice").alias("price"))


# --- bins, rankings, samples, sets ---


@query("bin_label_length", f"WITH {DOMAINS}, b AS (SELECT * FROM (VALUES (0, 3, '1-3'), (3, 5, '4-5'), (5, 8, '6-8'), (8, 12, '9-12'), (12, 100, '13+')) t(lo, hi, bin)) SELECT bin, count(d.id) AS n, round(avg(d.label), 6) AS share FROM b LEFT JOIN d ON length(label_name) > lo AND length(label_name) <= hi GROUP BY bin")
def bin_label_length(s, d):
    bins = ((0, 3, "1-3"), (3, 5, "4-5"), (5, 8, "6-8"), (8, 12, "9-12"), (12, 100, "13+"))
    n = F.length("label_name")
    name = F.coalesce(*[F.when((n > lo) & (n <= hi), b) for lo, hi, b in bins])
    found = domains(parts(urls(s, d))).groupBy(name.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("share"))
    all_ = s.createDataFrame([(b,) for _, _, b in bins], "bin string")
    return all_.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "share")


@query("hist_length", f"WITH {PARTS} SELECT label, least(floor(length(rest) / 4.0), 49)::INT AS bin, count(*) AS n FROM p WHERE length(rest) BETWEEN 0 AND 200 GROUP BY ALL")
def hist_length(s, d):
    n = F.length("rest")
    return parts(urls(s, d)).where(n <= 200).groupBy("label", F.least(F.floor(n / 4), F.lit(49)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("shape_share", f"WITH {PARTS} SELECT label, " + ", ".join(f"round(avg(({p})::INT), 6) AS {n}" for n, p in (("has_path", "length(path) > 1"), ("has_query", "query <> ''"), ("starts_www", "starts_with(host, 'www.')"), ("short_host", "length(host) <= 12"), ("ip_host", r"regexp_matches(host, '^(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}$')"), ("has_digits", "regexp_matches(host, '[0-9]')"), ("long_url", "length(rest) > 75"), ("com_tld", "ends_with(host, '.com')"))) + " FROM p GROUP BY label")
def shape_share(s, d):
    flags = {"has_path": F.length("path") > 1, "has_query": c("query") != "", "starts_www": c("host").startswith("www."), "short_host": F.length("host") <= 12, "ip_host": c("host").rlike(text.IP), "has_digits": c("host").rlike("[0-9]"), "long_url": F.length("rest") > 75, "com_tld": c("host").endswith(".com")}
    return parts(urls(s, d)).groupBy("label").agg(*[F.round(F.avg(f.cast("int")), 6).alias(n) for n, f in flags.items()])


@query("check_signal", f"WITH {URLS} SELECT id FROM (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE 1 END AS s, CASE WHEN id % 3 = 0 THEN NULL ELSE 2 END AS e, CASE WHEN id % 7 = 0 THEN NULL ELSE url END AS t FROM urls) WHERE (s IS NULL) <> (e IS NULL) OR (s IS NULL) <> (t IS NULL)")
def check_signal(s, d):
    nul = lambda k, x: F.when(c("id") % k == 0, None).otherwise(x)
    rows = urls(s, d).select("id", nul(3, F.lit(1)).alias("s"), nul(3, F.lit(2)).alias("e"), nul(7, c("url")).alias("t"))
    return rows.where((c("s").isNull() != c("e").isNull()) | (c("s").isNull() != c("t").isNull())).select("id")


@query("tld_encode", f"WITH {DOMAINS}, k AS (SELECT suffix FROM d GROUP BY suffix HAVING count(*) >= 5) SELECT id, CASE WHEN d.suffix = '' THEN '(none)' WHEN k.suffix IS NULL THEN '(other)' ELSE d.suffix END AS tld FROM d LEFT JOIN k ON d.suffix = k.suffix")
def tld_encode(s, d, least: int = 5):
    rows = domains(parts(urls(s, d)))
    kept = rows.groupBy("suffix").agg(F.count("*").alias("n")).where(c("n") >= least).select("suffix", F.lit(True).alias("k"))
    return rows.join(kept, "suffix", "left").select("id", F.when(c("suffix") == "", "(none)").when(c("k").isNull(), "(other)").otherwise(c("suffix")).alias("tld"))


@query("semi_join", f"WITH {DOMAINS} SELECT id, url FROM d WHERE domain IN (SELECT unnest({sql_list(V.OFFICIAL_DOMAINS)}))")
def semi_join(s, d):
    official = s.createDataFrame([(x,) for x in V.OFFICIAL_DOMAINS], "domain string")
    return domains(parts(urls(s, d))).join(official, "domain", "left_semi").select("id", "url")


@query("loso_split", f"WITH {DOMAINS}, h AS (SELECT DISTINCT domain FROM d WHERE source = 'p1') SELECT id, source FROM d WHERE source <> 'p1' AND domain NOT IN (SELECT domain FROM h)")
def loso_split(s, d):
    return splits.leave_out(domains(parts(urls(s, d))), "p1").select("id", "source")


HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query("group_split", f"WITH {DOMAINS} SELECT id, domain, CASE WHEN {HASH.format(chr(39) + '42:' + chr(39) + ' || domain')} % 100 < 20 THEN 'test' ELSE 'train' END AS part FROM d")
def group_split(s, d):
    return splits.by_group(domains(parts(urls(s, d))), "domain").select("id", "domain", "part")


@query("group_split_val", f"WITH {DOMAINS} SELECT id, domain, CASE WHEN {HASH.format(chr(39) + '42:' + chr(39) + ' || domain')} % 100 < 20 THEN 'test' WHEN {HASH.format(chr(39) + 'val:' + chr(39) + ' || domain')} % 100 < 10 THEN 'val' ELSE 'fit' END AS part FROM d")
def group_split_val(s, d):
    rows = splits.by_group(splits.by_group(domains(parts(urls(s, d))), "domain"), "domain", 10, "val:", "inner_part")
    return rows.select("id", "domain", F.when(c("part") == "test", "test").when(c("inner_part") == "test", "val").otherwise("fit").alias("part"))


@query("group_kfold", f"WITH {DOMAINS} SELECT id, ({HASH.format(chr(39) + '42:' + chr(39) + ' || domain')} % 3)::INT AS fold FROM d")
def group_kfold(s, d):
    return splits.folds(domains(parts(urls(s, d))), "domain").select("id", "fold")


BALANCED = f"""WITH RECURSIVE {DOMAINS},
g AS (SELECT domain, count(*) AS n FROM d GROUP BY domain),
o AS (SELECT domain, n, row_number() OVER (ORDER BY n DESC, domain) AS i FROM g),
r AS (SELECT 0::BIGINT AS i, 0::BIGINT AS n, 0 AS f, [0, 0, 0]::BIGINT[] AS loads
  UNION ALL SELECT o.i, o.n, list_position(loads, list_min(loads)),
    list_transform([1, 2, 3], lambda j: loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END)
  FROM r JOIN o ON o.i = r.i + 1),
b AS (SELECT n, f, sum(count(*)) OVER (PARTITION BY n ORDER BY f) AS upto FROM r WHERE i > 0 GROUP BY n, f),
s AS (SELECT domain, n, row_number() OVER (PARTITION BY n ORDER BY {HASH.format('domain')} % 4096, domain) AS spot FROM g),
x AS (SELECT s.domain, min(b.f) - 1 AS fold FROM s JOIN b ON s.n = b.n AND s.spot <= b.upto GROUP BY s.domain)
SELECT id, fold::INT AS fold FROM d JOIN x USING (domain)"""


@query("group_kfold_balanced", BALANCED)
def group_kfold_balanced(s, d):
    """Folds of about as many rows each, whatever the sizes of domains."""
    return splits.balanced_folds(domains(parts(urls(s, d))), "domain").select("id", "fold")


@query("sample_n", "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def sample_n(s, d):
    return splits.sample(table(s, d, "orders", "o_orderkey"), 500, "o_orderkey")


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(s, d):
    return table(s, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("stratified_sample", f"WITH {URLS}, u AS (SELECT url, min(id) AS id FROM urls WHERE url IS NOT NULL GROUP BY url), a AS (SELECT id, url FROM u WHERE regexp_matches(url, '[^\x00-\x7F]')), b AS (SELECT id, url FROM u WHERE NOT regexp_matches(url, '[^\x00-\x7F]') ORDER BY md5('42:' || id::VARCHAR), id LIMIT 40) SELECT * FROM a UNION ALL SELECT * FROM b")
def stratified_sample(s, d):
    first = urls(s, d).where("url IS NOT NULL").groupBy("url").agg(F.min("id").alias("id")).select("id", "url")
    odd = ~text.is_ascii(c("url"))
    return first.where(odd).unionByName(splits.sample(first.where(~odd), 40, "id"))


@query("union_sources", "SELECT source, count(*) AS n FROM (SELECT 'orders' AS source FROM orders UNION ALL SELECT 'events' FROM events UNION ALL SELECT 'pages' FROM pages) GROUP BY source")
def union_sources(s, d):
    one = lambda t: table(s, d, t).select(F.lit(t).alias("source"))
    return one("orders").unionByName(one("events")).unionByName(one("pages")).groupBy("source").agg(F.count("*").alias("n"))


@query("union_distinct", f"SELECT DISTINCT x AS brand FROM (SELECT unnest({sql_list(V.CURATED_BRANDS)}) AS x UNION SELECT lower(p_brand) FROM part)")
def union_distinct(s, d):
    curated = s.createDataFrame([(b,) for b in V.CURATED_BRANDS], "brand string")
    return curated.union(table(s, d, "part", "p_brand").select(F.lower("p_brand"))).distinct().orderBy("brand")


@query("unexpected_status", "SELECT event_type AS status FROM events EXCEPT SELECT unnest(['click', 'view'])")
def unexpected_status(s, d):
    return table(s, d, "events", "event_type").select(c("event_type").alias("status")).subtract(s.createDataFrame([("click",), ("view",)], "status string"))


@query("mean_rank", "WITH m AS (SELECT event_type AS model, avg(value) AS a, count(*)::DOUBLE AS b, stddev_samp(value) AS e FROM events GROUP BY event_type), r AS (SELECT model, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS re FROM m) SELECT model, round(((ra + rb + re) / 3.0)::DOUBLE, 6) AS mean_rank FROM r")
def mean_rank(s, d):
    m = table(s, d, "events", "event_type", "value").groupBy(c("event_type").alias("model")).agg(F.avg("value").alias("a"), F.count("*").cast("double").alias("b"), F.stddev_samp("value").alias("e"))
    tie = lambda x: (F.count("*").over(Window.partitionBy(x)) - 1) / 2.0
    ranks = [F.rank().over(Window.orderBy(F.desc(x) if down else F.asc(x))) + tie(x) for x, down in (("a", True), ("b", True), ("e", False))]
    return m.select("model", F.round(sum(ranks[1:], ranks[0]) / 3.0, 6).alias("mean_rank"))


@query("curve_thin", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE i % greatest(1, n // 2000) = 0")
def curve_thin(s, d):
    # ordinals from the sizes of key ranges, so that no task numbers all rows
    rows = table(s, d, "orders", "o_orderkey").withColumn("part", F.floor(c("o_orderkey") / 4096))
    sizes = rows.groupBy("part").agg(F.count("*").alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy(F.lit(1))).alias("n"))
    rows = rows.join(sizes, "part").withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("o_orderkey")) - 1 + c("before"))
    return rows.where(c("i") % F.greatest(F.lit(1), F.floor(c("n") / 2000)) == 0).select("o_orderkey")


# --- decisions and scores ---


@query("decide", f"WITH {SCORED} SELECT fine, CASE WHEN fine >= 0.5 THEN 'phishing' ELSE 'legitimate' END AS verdict, CASE WHEN fine >= 0.5 THEN fine ELSE 1 - fine END AS confidence, round_even(100 * (1 - fine), 0)::INT AS trust, count(*) AS n FROM scored GROUP BY ALL")
def decide(s, d):
    x = text.decide(c("fine"))
    return scored(s, d).groupBy("fine").agg(F.count("*").alias("n")).select("fine", x["label"].alias("verdict"), x["confidence"].alias("confidence"), x["trust"].alias("trust"), "n")


@query("log1p_scale", "WITH x AS (SELECT l_orderkey, l_linenumber, ln(1 + l_quantity) AS x FROM lineitem), m AS (SELECT avg(x) AS mean, stddev_pop(x) AS sd FROM x) SELECT l_orderkey, l_linenumber, round((x - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS z FROM x, m")
def log1p_scale(s, d):
    x = table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").withColumn("x", F.log1p("l_quantity"))
    m = x.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return x.crossJoin(F.broadcast(m)).select("l_orderkey", "l_linenumber", F.round((c("x") - c("mean")) / F.when(c("sd") == 0, 1.0).otherwise(c("sd")), 6).alias("z"))


def _pairs(s, d):
    e = table(s, d, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", clusters.squared(c("embedding"), F.transform("embedding", lambda x: F.round(x.cast("double"), 1))).alias("q"))


MSE = "SELECT vec_id, list_sum(list_transform(embedding, lambda x: (x::DOUBLE - round(x::DOUBLE, 1)) * (x::DOUBLE - round(x::DOUBLE, 1)))) / 64 AS mse FROM embeddings"


@query("row_mse", f"SELECT vec_id, round(mse, 9) AS mse FROM ({MSE})")
def row_mse(s, d):
    return _pairs(s, d).select("vec_id", F.round(c("q") / 64, 9).alias("mse"))


@query("error_feature", f"SELECT vec_id, round(ln(mse + 1e-12), 6) AS feature FROM ({MSE})")
def error_feature(s, d):
    return _pairs(s, d).select("vec_id", F.round(F.ln(c("q") / 64 + 1e-12), 6).alias("feature"))


@query("error_cutoff", f"WITH {SCORED}, t AS (SELECT DISTINCT score AS t FROM scored WHERE score > 0 AND score < 1) SELECT t, round(exp((ln(t / (1 - t)) - 0.25) / 1.5), 9) AS cutoff FROM t")
def error_cutoff(s, d):
    t = scored(s, d).select(c("score").alias("t")).where("t > 0 AND t < 1").distinct()
    return t.select("t", F.round(F.exp((F.ln(c("t") / (1 - c("t"))) - 0.25) / 1.5), 9).alias("cutoff"))


# --- metrics ---

CONF = "sum((label = 1 AND score >= 0.5)::INT)::BIGINT AS tp, sum((label = 0 AND score >= 0.5)::INT)::BIGINT AS fp, sum((label = 1 AND score < 0.5)::INT)::BIGINT AS fn, sum((label = 0 AND score < 0.5)::INT)::BIGINT AS tn"


@query("confusion", f"WITH {SCORED} SELECT {CONF} FROM scored")
def confusion(s, d):
    return metrics.confusion(scored(s, d))


@query("confusion_shares", f"WITH {SCORED} SELECT label, predicted, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY label), 6) AS share FROM (SELECT label, (score >= 0.5)::INT AS predicted, count(*) AS n FROM scored GROUP BY ALL)")
def confusion_shares(s, d):
    n = scored(s, d).groupBy("label", (c("score") >= 0.5).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return n.select("label", "predicted", "n", F.round(c("n") / F.sum("n").over(Window.partitionBy("label")), 6).alias("share"))


RATES = """SELECT {by} round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
 round(CASE WHEN tp + fn > 0 THEN tn / nullif(tn + fp, 0) END, 9) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 9) AS balanced_accuracy, round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) END, 9) AS mcc FROM {of}"""
DCONF = CONF.replace("::BIGINT", "::DOUBLE")


def rounded(df, *keep):
    return df.select(*[c(x) if x in keep else F.round(x, 9).alias(x) for x in df.columns])


@query("binary_metrics", f"WITH {SCORED}, k AS (SELECT {DCONF} FROM scored) " + RATES.format(by="", of="k"))
def binary_metrics(s, d):
    return rounded(metrics.rates(metrics.confusion(scored(s, d))))


@query("prob_error", f"WITH {SCORED} SELECT round(avg(abs(score - label)), 6) AS mae, round(avg((score - label) * (score - label)), 6) AS mse, round(sqrt(avg((score - label) * (score - label))), 6) AS rmse, round(avg(-CASE WHEN label = 1 THEN ln(greatest(least(score, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(score, 1 - 1e-15), 1e-15)) END), 6) AS log_loss FROM scored")
def prob_error(s, d):
    e = metrics.probability_errors(scored(s, d))
    return e.select(*[F.round(x, 6).alias(x) for x in e.columns])


CURVE = "{s}, t AS (SELECT {by} {x} AS score, count_if(label = 1)::DOUBLE AS pos, count_if(label = 0)::DOUBLE AS neg FROM scored GROUP BY {by} {x}), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER ({pb}) AS p, sum(neg) OVER ({pb}) AS n FROM t WINDOW w AS ({pb} ORDER BY score DESC))"


def curve(x: str = "fine", by: str = "") -> str:
    return CURVE.format(s=SCORED, x=x, by=by + "," if by else "", pb=f"PARTITION BY {by}" if by else "")


AUC, AP = "round(sum(neg * (tp - pos + pos / 2)) / nullif(max(p) * max(n), 0), 9)", "round(sum(pos * tp / (tp + fp)) / nullif(max(p), 0), 9)"


@query("roc_auc", f"WITH {curve()} SELECT {AUC} AS roc_auc FROM r")
def roc_auc(s, d):
    return rounded(metrics.roc_auc(metrics.tally(scored(s, d), "fine")))


@query("roc_auc_ties", f"WITH {curve('score')} SELECT {AUC} AS roc_auc FROM r")
def roc_auc_ties(s, d):
    return rounded(metrics.roc_auc(metrics.tally(scored(s, d), "score")))


@query("pr_auc", f"WITH {curve()} SELECT {AP} AS pr_auc FROM r")
def pr_auc(s, d):
    return rounded(metrics.average_precision(metrics.tally(scored(s, d), "fine")))


@query("recall_at_fpr", f"WITH {curve()}, q AS (SELECT fp / n AS x, tp / p AS y FROM r), a AS (SELECT coalesce(max((x, y))[1], 0) AS x, coalesce(max((x, y))[2], 0) AS y FROM q WHERE x <= 0.01), b AS (SELECT min((x, y))[1] AS x, min((x, y))[2] AS y FROM q WHERE x > 0.01) SELECT round(CASE WHEN b.x IS NULL OR a.x = 0.01 THEN a.y ELSE a.y + (b.y - a.y) * (0.01 - a.x) / (b.x - a.x) END, 9) AS recall_at_fpr FROM a, b")
def recall_at_fpr(s, d):
    return rounded(metrics.recall_at_fpr(metrics.tally(scored(s, d), "fine")))


@query("roc_points", f"WITH {curve()}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC) - 1 AS ordinal, count(*) OVER () AS m FROM r) SELECT ordinal, score, round(tp / p, 9) AS tpr, round(fp / n, 9) AS fpr, round(tp / (tp + fp), 9) AS precision FROM o WHERE ordinal % greatest(1, m // 2000) = 0")
def roc_points(s, d):
    return rounded(metrics.roc_points(metrics.tally(scored(s, d), "fine")), "ordinal", "score")


@query("per_class", f"""WITH {SCORED}, k AS (SELECT {DCONF} FROM scored), t AS (SELECT '0' AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support FROM k UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM k)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM (SELECT * FROM t UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM t UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM t)""")
def per_class(s, d):
    return rounded(metrics.per_class(metrics.confusion(scored(s, d))), "class", "support")


@query("per_source", f"WITH {curve('fine', 'source')}, a AS (SELECT source, {AUC} AS roc_auc, {AP} AS pr_auc FROM r GROUP BY source), k AS (SELECT source, count(*) AS n, {DCONF} FROM scored GROUP BY source), m AS ({RATES.format(by='source,', of='k')}) SELECT m.*, k.n, round(k.n::DOUBLE / sum(k.n) OVER (), 6) AS share, a.roc_auc, a.pr_auc FROM m JOIN a USING (source) JOIN k USING (source)")
def per_source(s, d):
    rows, by = scored(s, d), ["source"]
    t = metrics.tally(rows, "fine", by=by)
    m = rounded(metrics.rates(metrics.confusion(rows, by=by), by), "source")
    n = rows.groupBy("source").agg(F.count("*").alias("n"))
    n = n.withColumn("share", F.round(c("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))
    return m.join(n, "source").join(rounded(metrics.roc_auc(t, by), "source"), "source").join(rounded(metrics.average_precision(t, by), "source"), "source")


# --- clusters ---


def clustered(s, d):
    return table(s, d, "embeddings").select("vec_id", "embedding", "label", (c("label") % 4).alias("cluster"), (c("vec_id") % 5 == 0).cast("int").alias("bad"))


CL = "e AS (SELECT vec_id, embedding, label, label % 4 AS cluster, (vec_id % 5 = 0)::INT AS bad FROM embeddings)"
CELLS = f"{CL}, k AS (SELECT cluster, (label // 2)::INT AS g, count(*)::DOUBLE AS n FROM e GROUP BY ALL), ka AS (SELECT cluster, sum(n) AS n, max(n) AS top FROM k GROUP BY cluster), kb AS (SELECT g, sum(n) AS n FROM k GROUP BY g)"


@query("purity", f"WITH {CELLS} SELECT round(sum(top) / sum(n), 9) AS purity FROM ka")
def purity(s, d):
    return rounded(clusters.external(clusters.contingency(clustered(s, d).withColumn("g", F.floor(c("label") / 2).cast("int")), label="g")).select("purity"))


@query("cluster_external", f"""WITH {CELLS}, q AS (SELECT (SELECT sum(n) FROM k) AS t, (SELECT sum(n * (n - 1) / 2) FROM k) AS ij, (SELECT sum(n * ln(n)) FROM k) AS hij, (SELECT sum(n * (n - 1) / 2) FROM ka) AS ai, (SELECT sum(n * ln(n)) FROM ka) AS ha, (SELECT sum(n * (n - 1) / 2) FROM kb) AS bj, (SELECT sum(n * ln(n)) FROM kb) AS hb),
h AS (SELECT *, t * ln(t) - hb AS hl, t * ln(t) - ha AS hc, ai * bj / (t * (t - 1) / 2) AS ex, 1 - (ha - hij) / (t * ln(t) - hb) AS hom, 1 - (hb - hij) / (t * ln(t) - ha) AS com FROM q)
SELECT round((ij - ex) / ((ai + bj) / 2 - ex), 9) AS ari, round(hom, 9) AS homogeneity, round(com, 9) AS completeness, round(2 * hom * com / (hom + com), 9) AS v_measure, round((hl - (ha - hij)) / ((hl + hc) / 2), 9) AS nmi FROM h""")
def cluster_external(s, d):
    return rounded(clusters.external(clusters.contingency(clustered(s, d).withColumn("g", F.floor(c("label") / 2).cast("int")), label="g")).drop("purity"))


@query("cluster_jaccard", f"WITH {CELLS} SELECT k.cluster, round(max(k.n / (ka.n + kb.n - k.n)), 9) AS best FROM k JOIN ka USING (cluster) JOIN kb USING (g) GROUP BY k.cluster")
def cluster_jaccard(s, d):
    return rounded(clusters.jaccard(clusters.contingency(clustered(s, d).withColumn("g", F.floor(c("label") / 2).cast("int")), label="g")), "cluster")


SQD = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
CENTRES = f"{CL}, l AS (SELECT cluster, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM e), c AS (SELECT cluster, list(x ORDER BY i) AS centre FROM (SELECT cluster, i, avg(x) AS x FROM l GROUP BY cluster, i) GROUP BY cluster), m AS (SELECT list(x ORDER BY i) AS mid FROM (SELECT i, avg(x) AS x FROM l GROUP BY i))"


@query("cluster_internal", f"""WITH {CENTRES}, z AS (SELECT e.cluster, count(*) AS n, sum({SQD.format(a='embedding', b='centre')}) AS w, avg(sqrt({SQD.format(a='embedding', b='centre')})) AS s, any_value(centre) AS centre FROM e JOIN c USING (cluster) GROUP BY e.cluster),
db AS (SELECT a.cluster, max((a.s + b.s) / sqrt({SQD.format(a='a.centre', b='b.centre')})) AS r FROM z a JOIN z b ON a.cluster <> b.cluster GROUP BY a.cluster)
SELECT round((SELECT avg(r) FROM db), 6) AS davies_bouldin, round((SELECT sum(n * {SQD.format(a='centre', b='mid')}) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))) FROM z, m), 6) AS calinski_harabasz""")
def cluster_internal(s, d):
    x = clusters.internal(clustered(s, d))
    return x.select(*[F.round(n, 6).alias(n) for n in x.columns])


@query("silhouette", f"""WITH {CL}, p AS (SELECT a.vec_id AS i, a.cluster AS c, b.cluster AS o, avg(sqrt({SQD.format(a='a.embedding', b='b.embedding')})) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
q AS (SELECT i, max(CASE WHEN c = o THEN d END) AS own, min(CASE WHEN c <> o THEN d END) AS other FROM p GROUP BY i) SELECT round(avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END), 6) AS silhouette FROM q""")
def silhouette(s, d):
    return clusters.silhouette(clustered(s, d)).select(F.round("silhouette", 6).alias("silhouette"))


@query("knn1_assign", f"WITH {CENTRES}, n AS (SELECT vec_id, c.cluster AS k, {SQD.format(a='embedding', b='centre')} AS q FROM e, c) SELECT vec_id, arg_min(k, (q, k)) AS cluster, round(sqrt(min(q)), 6) AS distance FROM n GROUP BY vec_id")
def knn1_assign(s, d):
    rows = clustered(s, d)
    return clusters.nearest(rows.select("vec_id", "embedding"), clusters.centres(rows, "cluster", "embedding")).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query("cluster_proba", f"WITH {CL}, k AS (SELECT cluster, sum(bad) AS s, count(*) AS m FROM e WHERE cluster < 3 GROUP BY cluster), q AS (SELECT cluster, (s + 10 * (sum(s) OVER () / sum(m) OVER ())) / (m + 10) AS proba, sum(s) OVER () / sum(m) OVER () AS prior FROM k) SELECT vec_id, round(coalesce(q.proba, (SELECT max(prior) FROM q)), 9) AS proba FROM e LEFT JOIN q USING (cluster)")
def cluster_proba(s, d):
    rows = clustered(s, d)
    known = clusters.probabilities(rows.where("cluster < 3"), label="bad")
    prior = known.agg(F.max("prior").alias("p"))
    return rows.join(known.select("cluster", "proba"), "cluster", "left").crossJoin(F.broadcast(prior)).select("vec_id", F.round(F.coalesce("proba", "p"), 9).alias("proba"))


@query("cluster_profile", "SELECT p_brand AS cluster, count(*) AS size, round(avg((p_size > 25)::INT), 6) AS share, median(p_size)::DOUBLE AS median_p_size, round(median(p_retailprice), 6) AS median_p_retailprice FROM part GROUP BY p_brand ORDER BY size DESC, cluster LIMIT 15")
def cluster_profile(s, d):
    rows = table(s, d, "part").withColumn("big", (c("p_size") > 25).cast("int"))
    out = clusters.profile(rows, ["p_size", "p_retailprice"], "p_brand", "big")
    return out.select("cluster", "size", F.round("share", 6).alias("share"), "median_p_size", F.round("median_p_retailprice", 6).alias("median_p_retailprice"))


FEATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("cluster_zscore", "WITH x AS (" + " UNION ALL ".join(f"SELECT l_returnflag AS cluster, '{f}' AS feature, {f} AS x FROM lineitem" for f in FEATS) + "), a AS (SELECT feature, avg(x) AS overall, stddev_pop(x) AS sd FROM x GROUP BY feature), z AS (SELECT cluster, feature, avg(x) AS mean FROM x GROUP BY ALL), r AS (SELECT cluster, feature, (mean - overall) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z, mean, overall FROM z JOIN a USING (feature)) SELECT cluster, rank::INT AS rank, feature, round(z, 6) AS z, round(mean, 4) AS mean, round(overall, 4) AS overall FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(abs(z), 9) DESC, feature) AS rank FROM r) WHERE rank <= 3")
def cluster_zscore(s, d):
    out = clusters.z_scores(table(s, d, "lineitem", "l_returnflag", *FEATS), list(FEATS), "l_returnflag")
    return out.select("cluster", "rank", "feature", F.round("z", 6).alias("z"), F.round("mean", 4).alias("mean"), F.round("overall", 4).alias("overall"))


@query("cluster_counts", "SELECT count(DISTINCT CASE WHEN k <> -1 THEN k END) AS n_clusters, round(avg((k = -1)::INT), 6) AS noise FROM (SELECT CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS k FROM embeddings)")
def cluster_counts(s, d):
    rows = table(s, d, "embeddings", "vec_id", "label").select(F.when(c("vec_id") % 7 == 0, -1).otherwise(c("label")).alias("k"))
    return rows.agg(F.countDistinct(F.when(c("k") != -1, c("k"))).alias("n_clusters"), F.round(F.avg((c("k") == -1).cast("int")), 6).alias("noise"))
