"""URL parsing, predicates and string functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve.functions import suffix, text
from urlsieve.functions import values as V
from urlsieve.operators import brands
from urlsieve.plans.inputs import DOMAINS, PARTS, URLS, domains, parts, sql_list, sql_string, table, urls
from urlsieve.sources import folders

QUERIES: dict = {}
SQL: dict = {}
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def simple(name: str, columns, sql_columns: str, cte: str = URLS, of: str = "urls", prepare=None):
    """A projection of the URL table: id and these columns."""

    def run(spark, d):
        rows = urls(spark, d)
        rows = prepare(rows) if prepare else rows
        return rows.select("id", *columns())

    QUERIES[name] = run
    SQL[name] = f"WITH {cte} SELECT id, {sql_columns} FROM {of}"


def c(name: str):
    return F.col(name)


simple("str_strip", lambda: [text.strip(c("url")).alias("s")], f"regexp_replace(url, '^{WS}+|{WS}+$', '', 'g') AS s")
simple("str_lower", lambda: [F.lower("url").alias("s")], "lower(url) AS s")
simple("preprocess_url", lambda: [text.preprocess(c("url")).alias("s")], f"lower(regexp_replace(regexp_replace(url, '^{WS}+|{WS}+$', '', 'g'), '^([a-zA-Z][a-zA-Z0-9+.\\-]*)://', '')) AS s")
simple("split_scheme", lambda: [text.scheme(c("url")).alias("protocol"), text.without_scheme(c("url")).alias("rest")], "lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*)://', 1)) AS protocol, regexp_replace(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*)://', '') AS rest")
CANON = f"regexp_replace(regexp_replace(lower(regexp_replace(coalesce(url, ''), '^{WS}+|{WS}+$', '', 'g')), '^([a-zA-Z][a-zA-Z0-9+.\\-]*)://', ''), '/+$', '')"
simple("canonicalize", lambda: [text.canonical(c("url")).alias("url_canonical")], f"{CANON} AS url_canonical")
simple(
    "lexical_counts",
    lambda: [
        F.length("rest").alias("url_length"), F.length("host").alias("hostname_length"), F.length("path").alias("path_length"), F.length("query").alias("query_length"),
        *[text.count(c("u"), p).alias(n) for n, p in (("dot_count", r"\."), ("hyphen_count", "-"), ("digit_count", r"\p{Nd}"), ("at_count", "@"), ("underscore_count", "_"), ("percent_count", "%"), ("equals_count", "="), ("ampersand_count", "&"))],
        F.round(F.coalesce(F.try_divide(text.count(c("u"), r"\p{Nd}"), F.length("rest")), F.lit(0.0)), 6).alias("digit_ratio"),
    ],
    "length(rest)::INT AS url_length, length(host)::INT AS hostname_length, length(path)::INT AS path_length, length(query)::INT AS query_length, "
    + ", ".join(f"len(regexp_extract_all(u, '{p}'))::INT AS {n}" for n, p in (("dot_count", r"\."), ("hyphen_count", "-"), ("digit_count", r"\p{Nd}"), ("at_count", "@"), ("underscore_count", "_"), ("percent_count", "%"), ("equals_count", "="), ("ampersand_count", "&")))
    + ", round(CASE WHEN length(rest) = 0 THEN 0.0 ELSE len(regexp_extract_all(u, '\\p{Nd}'))::DOUBLE / length(rest) END, 6) AS digit_ratio",
    PARTS, "p", parts,
)
simple("url_parts", lambda: [F.col("host_raw"), F.col("host"), F.col("path"), F.col("query"), text.count(c("path"), "[^/]+").alias("path_depth")], "host_raw, host, path, query, len(regexp_extract_all(path, '[^/]+'))::INT AS path_depth", PARTS, "p", parts)
simple(
    "url_flags",
    lambda: [c("host").rlike(text.IP).cast("int").alias("is_ip_hostname"), c("host_raw").rlike(text.PORT).cast("int").alias("has_port"), (text.scheme(c("u")) == "https").cast("int").alias("uses_https"), (text.scheme(c("u")) != "").cast("int").alias("has_protocol"), c("host").contains("xn--").cast("int").alias("has_punycode")],
    r"regexp_matches(host, '^(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}$')::INT AS is_ip_hostname, regexp_matches(host_raw, ':\p{Nd}+$')::INT AS has_port, (lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://', 1)) = 'https')::INT AS uses_https, (regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.\-]*)://', 1) <> '')::INT AS has_protocol, contains(host, 'xn--')::INT AS has_punycode",
    PARTS, "p", parts,
)
simple("keyword_count", lambda: [text.keyword_count(c("u")).alias("n")], f"len(regexp_extract_all(lower(u), '{'|'.join(V.KEYWORDS)}'))::INT AS n", PARTS, "p", parts)
simple("psl_columns", lambda: [F.col("suffix"), F.col("label_name"), F.col("subdomain"), F.col("domain"), F.when(c("subdomain") != "", text.count(c("subdomain"), r"\.") + 1).otherwise(0).alias("subdomain_count")], r"suffix, label_name, subdomain, domain, CASE WHEN subdomain <> '' THEN len(regexp_extract_all(subdomain, '\.')) + 1 ELSE 0 END::INT AS subdomain_count", DOMAINS, "d", lambda r: domains(parts(r)))
simple("tld_last_label", lambda: [text.last_label(c("host")).alias("tld")], r"regexp_extract(host, '\.([^.]*)$', 1) AS tld", PARTS, "p", parts)
STRIPPED = f"regexp_replace(regexp_replace(url, '^{WS}+|{WS}+$', '', 'g'), '^([a-zA-Z][a-zA-Z0-9+.\\-]*)://', '')"
simple("host_dedup", lambda: [text.host_for_dedup(c("url")).alias("host")], f"regexp_extract(regexp_replace(regexp_extract(lower({STRIPPED}), '^[^/?]*'), '(?s)^.*@', ''), '^[^:]*') AS host")
simple("host_eda", lambda: [text.host_for_reports(c("url")).alias("host")], f"regexp_extract(regexp_replace(regexp_extract({STRIPPED}, '^[^/?]*'), '(?s)^.*@', ''), '^[^:]*') AS host")
simple("host_features", lambda: [F.col("host_raw").alias("host")], "host_raw AS host", PARTS, "p", parts)
simple(
    "host_rules",
    lambda: [text.host_for_rules(text.preprocess(c("u"))).alias("h")],
    f"CASE WHEN regexp_replace(regexp_replace(au, '(?s)^.*@', ''), ':\\p{{Nd}}+$', '') <> '' THEN struct_pack(\"start\" := (length(au) - length(regexp_replace(au, '(?s)^.*@', '')))::INT, \"end\" := (length(au) - length(regexp_replace(au, '(?s)^.*@', '')) + length(regexp_replace(regexp_replace(au, '(?s)^.*@', ''), ':\\p{{Nd}}+$', '')))::INT, \"text\" := regexp_replace(regexp_replace(au, '(?s)^.*@', ''), ':\\p{{Nd}}+$', '')) END AS h",
    f"{PARTS}, q AS (SELECT *, regexp_extract(lower(regexp_replace(regexp_replace(u, '^{WS}+|{WS}+$', '', 'g'), '^([a-zA-Z][a-zA-Z0-9+.\\-]*)://', '')), '^[^/?#]*') AS au FROM p)", "q", parts,
)
_host_rules = QUERIES["host_rules"]
QUERIES["host_rules"] = lambda s, d: _host_rules(s, d).select("id", F.col("h.start").alias("h_start"), F.col("h.end").alias("h_end"), F.col("h.text").alias("h_text"))
SQL["host_rules"] = f"SELECT id, h.\"start\" AS h_start, h.\"end\" AS h_end, h.\"text\" AS h_text FROM ({SQL['host_rules']})"
simple("host_span", lambda: [text.host_span(c("u"))["start"].alias("h_start"), text.host_span(c("u"))["end"].alias("h_end")], "length(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.\\-]*)://'))::INT AS h_start, (length(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.\\-]*)://')) + length(regexp_extract(rest, '^[^/?#]*')))::INT AS h_end", PARTS, "p", parts)
QUERIES["host_urlparse"] = lambda s, d: urls(s, d).select("id", text.host_for_sanity(text.strip(F.coalesce("url", F.lit("")))).alias("host"))
SQL["host_urlparse"] = f"""WITH {URLS}, a AS (SELECT id, regexp_replace(regexp_replace(coalesce(url, ''), '^{WS}+|{WS}+$', '', 'g'), '[\\t\\r\\n]', '', 'g') AS x FROM urls),
b AS (SELECT id, regexp_extract(CASE WHEN contains(x, '://') THEN x ELSE 'http://' || x END, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1) AS n FROM a), h AS (SELECT id, n, regexp_replace(n, '(?s)^.*@', '') AS h FROM b)
SELECT id, lower(CASE WHEN contains(n, '[') <> contains(n, ']') THEN '' WHEN starts_with(h, '[') THEN regexp_extract(h, '^\\[([^\\]]*)\\]', 1) ELSE regexp_extract(h, '^[^:]*') END) AS host FROM h"""
simple("is_ascii", lambda: [text.is_ascii(c("u")).alias("ascii")], r"NOT regexp_matches(u, '[^\x00-\x7F]') AS ascii", PARTS, "p", parts)
simple("filter_blank", lambda: [(c("url").isNull() | (text.strip(c("url")) == "")).alias("blank")], f"(url IS NULL OR regexp_replace(url, '^{WS}+|{WS}+$', '', 'g') = '') AS blank")
HOSTA = f"regexp_extract(regexp_replace(regexp_extract(lower({STRIPPED}), '^[^/?]*'), '(?s)^.*@', ''), '^[^:]*')"


@query("filter_malformed", f"WITH {URLS} SELECT id, url FROM urls WHERE url IS NOT NULL AND regexp_replace(url, '^{WS}+|{WS}+$', '', 'g') <> '' AND contains({HOSTA}, '.')")
def filter_malformed(spark, d):
    return urls(spark, d).where(F.col("url").isNotNull() & (text.strip(c("url")) != "") & text.host_for_dedup(c("url")).contains(".")).select("id", "url")


@query("malformed_counts", f"WITH {URLS}, f AS (SELECT (url IS NULL OR regexp_replace(url, '^{WS}+|{WS}+$', '', 'g') = '') AS blank, NOT contains(coalesce({HOSTA}, ''), '.') AS nodot FROM urls) SELECT count_if(blank)::BIGINT AS n_blank, count_if(nodot)::BIGINT AS n_nodot, count_if(blank OR nodot)::BIGINT AS n_dropped FROM f")
def malformed_counts(spark, d):
    blank = c("url").isNull() | (text.strip(c("url")) == "")
    nodot = ~F.coalesce(text.host_for_dedup(c("url")), F.lit("")).contains(".")
    return urls(spark, d).agg(F.count_if(blank).alias("n_blank"), F.count_if(nodot).alias("n_nodot"), F.count_if(blank | nodot).alias("n_dropped"))


simple("validate_url", lambda: [text.check_url(c("url")).alias("code")], f"""CASE WHEN v IS NULL OR length(v) < 1 OR length(v) > 2048 THEN 'url_length' WHEN regexp_matches(v, '{WS}|[\\p{{Cc}}\\p{{Cf}}\\p{{Z}}]') THEN 'url_characters'
  WHEN has AND (lower(name) NOT IN ('http', 'https') OR NOT starts_with(r, '//')) THEN 'url_scheme' WHEN has AND r = '//' THEN 'url_empty' END AS code""",
  f"{URLS}, v0 AS (SELECT *, regexp_replace(url, '^{WS}+|{WS}+$', '', 'g') AS v FROM urls), v1 AS (SELECT *, regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1) AS name, substr(v, length(regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.\\-]*):')) + 1) AS r FROM v0), v2 AS (SELECT *, name <> '' AND NOT regexp_matches(r, '^\\p{{Nd}}') AND NOT contains(name, '.') AS has FROM v1)", "v2")
simple("validate_client", lambda: [text.check_in_client(c("url")).alias("code")], f"""CASE WHEN v = '' THEN 'empty' WHEN length(v) > 2048 THEN 'too_long' WHEN regexp_matches(v, '{WS}') THEN 'spaces' WHEN regexp_matches(v, '\\p{{Cc}}') THEN 'characters' WHEN regexp_matches(v, '[\\p{{Cf}}\\p{{Z}}]') THEN 'hidden'
  WHEN has AND NOT (lower(name) IN ('http', 'https') AND starts_with(r, '//')) THEN 'scheme' WHEN NOT regexp_matches(host, '[^.]\\.[^.]') AND NOT regexp_matches(host, '(?i)^(\\[[0-9a-f.]*:[0-9a-f:.]*\\]|localhost)(:[0-9]+)?$') THEN 'host' END AS code""",
  f"{URLS}, v0 AS (SELECT *, regexp_replace(coalesce(url, ''), '^{WS}+|{WS}+$', '', 'g') AS v FROM urls), v1 AS (SELECT *, regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1) AS name, substr(v, length(regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.\\-]*):')) + 1) AS r, regexp_extract(regexp_replace(v, '^([a-zA-Z][a-zA-Z0-9+.\\-]*)://', ''), '^[^/?#]*') AS host FROM v0), v2 AS (SELECT *, name <> '' AND NOT regexp_matches(r, '^[0-9]') AND NOT contains(name, '.') AS has FROM v1)", "v2")


def _tr(x: str, t: dict) -> str:
    return f"translate({x}, '{''.join(t)}', '{''.join(t.values())}')"


#: Labels with look-alikes, for folding: id and name.
NAMES = ((1, "pаypal"), (2, "gοοgle"), (3, "paypa1"), (4, "arnazon"), (5, "wellsfarg0"), (6, "ⅰcloud"), (7, "plain"), (8, ""), (9, "micr0s0ft"), (10, "раураl"), (11, "chase"), (12, "0range"))
NAMES_SQL = "names AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in NAMES) + ") t(id, name))"


def names(spark):
    return spark.createDataFrame(list(NAMES), "id int, name string")


#: The names, and all documents' texts after them.
SPELLED = f"{NAMES_SQL}, spelled AS (SELECT id, name FROM names UNION ALL SELECT 1000 + doc_id, text FROM documents)"


def spelled(spark, d):
    texts = table(spark, d, "documents", "doc_id", "text").select((c("doc_id") + 1000).alias("id"), c("text").alias("name"))
    return names(spark).select(c("id").cast("long").alias("id"), "name").union(texts)


@query("fold_homoglyph", f"WITH {SPELLED} SELECT id, {_tr('name', V.HOMOGLYPHS)} AS folded FROM spelled")
def fold_homoglyph(spark, d):
    return spelled(spark, d).select("id", text.without_homoglyphs(c("name")).alias("folded"))


@query("fold_leet", f"WITH {SPELLED} SELECT id, replace({_tr('name', V.LEETSPEAK)}, 'rn', 'm') AS folded FROM spelled")
def fold_leet(spark, d):
    return spelled(spark, d).select("id", text.without_leetspeak(c("name")).alias("folded"))


simple("host_entropy", lambda: [F.round(text.entropy(c("host")), 6).alias("h")], "round(CASE WHEN host = '' THEN 0.0 ELSE -list_sum(list_transform(list_distinct(string_split(host, '')), lambda x: (len(list_filter(string_split(host, ''), lambda y: y = x))::DOUBLE / length(host)) * log2(len(list_filter(string_split(host, ''), lambda y: y = x))::DOUBLE / length(host)))) END, 6) AS h", PARTS, "p", parts)
LOOK = f"replace({_tr(_tr('x', V.HOMOGLYPHS), V.LEETSPEAK)}, 'rn', 'm')"


@query("brand_lookalike", f"WITH {DOMAINS}, a AS (SELECT id, label_name AS x FROM d UNION ALL SELECT id, name FROM (VALUES {', '.join(f'({i}, {sql_string(n)})' for i, n in NAMES)}) t(id, name)) SELECT id, x AS label_name, CASE WHEN length(x) >= 5 AND NOT list_contains({sql_list(V.CURATED_BRANDS)}, x) AND {LOOK} <> x AND list_contains({sql_list(V.CURATED_BRANDS)}, {LOOK}) THEN {LOOK} END AS brand FROM a")
def brand_lookalike(spark, d):
    rows = domains(parts(urls(spark, d))).select("id", "label_name").union(names(spark).select(F.col("id").cast("long"), "name"))
    return rows.select("id", "label_name", brands.lookalike(c("label_name")).alias("brand"))


simple("domain_label", lambda: [F.when((c("suffix") != "") & c("domain").endswith(F.concat(F.lit("."), "suffix")), F.expr("left(domain, length(domain) - length(suffix) - 1)")).otherwise(c("domain")).alias("name")], "CASE WHEN suffix <> '' AND ends_with(domain, '.' || suffix) THEN left(domain, length(domain) - length(suffix) - 1) ELSE domain END AS name", DOMAINS, "d", lambda r: domains(parts(r)))
QUERIES["char_ngrams"] = lambda s, d: parts(urls(s, d)).select("id", F.inline(text.ngrams(c("rest"))))
SQL["char_ngrams"] = f"WITH {PARTS}, q AS (SELECT id, rest, unnest([3, 4, 5]) AS n FROM p) SELECT id, i::INT AS start, substr(rest, i + 1, n) AS gram FROM (SELECT *, unnest(range(greatest(length(rest) - n + 1, 0))) AS i FROM q)"
GRAMS = f"{PARTS}, g0 AS (SELECT id, rest, unnest([3, 4, 5]) AS n FROM p), g AS (SELECT id, i::INT AS start, (i + n)::INT AS stop, substr(rest, i + 1, n) AS gram, ('0x' || substr(md5(substr(rest, i + 1, n)), 1, 8))::BIGINT % 1048576 AS bucket FROM (SELECT *, unnest(range(greatest(length(rest) - n + 1, 0))) AS i FROM g0))"


@query("ngram_hash", f"WITH {GRAMS} SELECT id, bucket, count(*) AS tf FROM g GROUP BY ALL")
def ngram_hash(spark, d):
    rows = parts(urls(spark, d)).select("id", F.inline(text.ngrams(c("rest"))))
    return rows.groupBy("id", text.bucket(c("gram")).alias("bucket")).agg(F.count("*").alias("tf"))


@query("fmt_pct", "SELECT o_orderkey, CASE WHEN s < 1 AND printf('%.1f%%', s * 100) = '100.0%' THEN printf('%.2f%%', s * 100) ELSE printf('%.1f%%', s * 100) END AS pct FROM (SELECT o_orderkey, least(1.0, 0.99 + (o_orderkey % 1009) / 99991.0) AS s FROM orders)")
def fmt_pct(spark, d):
    rows = table(spark, d, "orders", "o_orderkey").withColumn("s", F.least(F.lit(1.0), 0.99 + F.col("o_orderkey") % 1009 / 99991.0))
    return rows.select("o_orderkey", text.percent(c("s")).alias("pct"))


@query("fmt_confidence", "SELECT l_orderkey, l_linenumber, CASE WHEN s IS NULL OR s < 0 OR s > 1 THEN '0%' WHEN s * 100 >= 99.5 THEN 'Over 99%' ELSE floor(s * 100 + 0.5)::INT || '%' END AS pct FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 2 THEN NULL ELSE round(l_quantity / 49, 4) END AS s FROM lineitem)")
def fmt_confidence(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").withColumn("s", F.when(F.col("l_quantity") < 2, None).otherwise(F.round(F.col("l_quantity") / 49, 4)))
    return rows.select("l_orderkey", "l_linenumber", text.confidence_text(c("s")).alias("pct"))


simple("trunc_label", lambda: [text.shortened(c("u"), 14).alias("short"), text.shortened(c("host"), 20).alias("host_label")], "CASE WHEN length(u) > 14 THEN left(u, 14) || '...' ELSE u END AS short, CASE WHEN length(host) > 20 THEN left(host, 20) || '...' ELSE host END AS host_label", PARTS, "p", parts)
BRANDS_IN_HOST = ("paypal", "apple", "amazon", "microsoft", "netflix", "google", "facebook", "instagram", "chase", "wellsfargo", "coinbase", "docusign", "outlook", "office", "yahoo", "dropbox", "linkedin", "binance", "steam", "ebay")  # fixed values
_longest = sorted(BRANDS_IN_HOST, key=len, reverse=True)
simple("brand_in_host", lambda: [F.get(F.filter(F.array(*[F.lit(b) for b in _longest]), lambda b: F.contains(F.col("host"), b)), F.lit(0)).alias("brand")], f"list_filter({sql_list(_longest)}, lambda b: contains(host, b))[1] AS brand", PARTS, "p", parts)


@query("psl_split", f"WITH {DOMAINS} SELECT DISTINCT host, suffix, label_name, subdomain, domain FROM d")
def psl_split(spark, d):
    return suffix.split_by(parts(urls(spark, d)), suffix.rules_table(spark))


#: Rules that the hosts themselves give: their last labels, and by length their last two, with wildcards and exceptions.
OWN_RULES = """own AS (SELECT DISTINCT unnest([t1,
    CASE WHEN n % 2 = 0 THEN t2 END, CASE WHEN n % 5 = 0 THEN '*.' || t1 END, CASE WHEN n % 7 = 0 THEN '!' || t2 END]) AS rule
  FROM (SELECT length(host) AS n, regexp_extract(host, '[^.]+$') AS t1, regexp_extract(host, '[^.]+[.][^.]+$') AS t2
    FROM p WHERE regexp_matches(host, '^[a-z0-9-]+([.][a-z0-9-]+)+$')))"""
LISTED = DOMAINS.replace(f"rules AS (SELECT {sql_list(V.SUFFIX_RULES)} AS r)", f"{OWN_RULES}, rules AS (SELECT list(rule) AS r FROM own WHERE rule IS NOT NULL)")


@query("psl_file", f"WITH {LISTED} SELECT DISTINCT host, suffix, label_name, subdomain, domain FROM d")
def psl_file(spark, d):
    """Hosts by the rules of a suffix list file, of any length, in the usual form."""
    hosts = parts(urls(spark, d))
    path = folders.fresh(spark, "suffixes")
    t1, t2, n = F.regexp_extract("host", "[^.]+$", 0), F.regexp_extract("host", "[^.]+[.][^.]+$", 0), F.length("host")
    rules = F.array(t1, F.when(n % 2 == 0, t2), F.when(n % 5 == 0, F.concat(F.lit("*."), t1)), F.when(n % 7 == 0, F.concat(F.lit("!"), t2)))
    lines = hosts.where(c("host").rlike(r"^[a-z0-9-]+([.][a-z0-9-]+)+$")).select(F.explode(rules).alias("rule")).where("rule IS NOT NULL").distinct()
    body = F.array_join(F.sort_array(F.collect_set("rule")), "\n")
    marks = "// ===BEGIN ICANN DOMAINS===\n// rules\n", "\n\n// ===END ICANN DOMAINS===\n// ===BEGIN PRIVATE DOMAINS===\nexample.com\n"
    lines.agg(F.concat(F.lit(marks[0]), body, F.lit(marks[1])).alias("value")).write.text(path)
    return suffix.split_by(hosts, suffix.rules_table(spark, path))


MASKED = f"""{DOMAINS}, k AS (SELECT *, regexp_extract(t, '^[^/?#]*') AS au FROM (SELECT *, lower(regexp_replace(regexp_replace(u, '^{WS}+|{WS}+$', '', 'g'), '^([a-zA-Z][a-zA-Z0-9+.\\-]*)://', '')) AS t FROM d)),
k1 AS (SELECT *, regexp_replace(au, '(?s)^.*@', '') AS hh FROM k),
m AS (SELECT *, CASE WHEN list_contains({sql_list(V.OFFICIAL_DOMAINS)}, domain) THEN left(t, length(au) - length(hh)) || CASE WHEN subdomain <> '' THEN subdomain || '.' ELSE '' END || '§.' || suffix || substr(hh, length(regexp_replace(hh, ':\\p{{Nd}}+$', '')) + 1) || substr(t, length(au) + 1) ELSE t END AS masked FROM k1)"""


def masked(rows):
    """rows with t, the preprocessed URL, and masked, in which an official domain's label is the mask."""
    rows = domains(parts(rows)).withColumn("t", text.preprocess(c("u")))
    rows = rows.withColumn("au", text.until(c("t"), "/?#")).withColumn("hh", text.after_at(c("au")))
    port = F.substr(c("hh"), F.length(text.without_port(c("hh"))) + 1)
    host = F.concat(F.when(c("subdomain") != "", F.concat("subdomain", F.lit("."))).otherwise(""), F.lit(V.BRAND_MASK + "."), "suffix", port)
    text_ = F.concat(F.expr("left(t, length(au) - length(hh))"), host, F.expr("substr(t, length(au) + 1)"))
    return rows.withColumn("masked", F.when(c("domain").isin(*V.OFFICIAL_DOMAINS), text_).otherwise(c("t")))


@query("brand_mask", f"WITH {MASKED} SELECT id, masked FROM m")
def brand_mask(spark, d):
    return masked(urls(spark, d)).select("id", "masked")


def _alike(a: str, b: str) -> str:
    return f"coalesce(list_filter(range(least(length({a}), length({b}))), lambda i: substr({a}, i + 1, 1) <> substr({b}, i + 1, 1))[1], least(length({a}), length({b})))"


#: al: each URL's prefix and suffix that t and masked share, the masked middle's end, and by how much the texts' lengths differ.
ALIGNED = f"""{MASKED}, al0 AS (SELECT id, t, masked, {_alike('t', 'masked')} AS pre FROM m WHERE masked <> ''), al1 AS (SELECT *, least({_alike('reverse(t)', 'reverse(masked)')}, least(length(t), length(masked)) - pre) AS suf FROM al0),
al AS (SELECT *, length(masked) - suf AS fin, length(t) - length(masked) AS shift FROM al1)"""


def aligned_sql(start: str, stop: str) -> tuple[str, str]:
    """Start and end in t of [start, stop) of masked, in a query over al."""
    ok = f"{stop} > {start} AND {start} >= 0 AND {stop} <= length(masked)"
    lost = f"{start} < fin AND {stop} > pre AND NOT (substr(masked, pre + 1, greatest(fin - pre, 0)) = '{V.BRAND_MASK}' AND length(t) - suf > pre)"
    one = lambda same, moved: f"CASE WHEN NOT ({ok}) THEN NULL WHEN t = masked THEN {same} WHEN {lost} THEN NULL ELSE {moved} END"
    return one(start, f"CASE WHEN {start} < pre THEN {start} WHEN {start} >= fin THEN {start} + shift ELSE pre END"), one(stop, f"CASE WHEN {stop} <= pre THEN {stop} WHEN {stop} > fin THEN {stop} + shift ELSE length(t) - suf END")


_whole = aligned_sql("0", "length(masked)")


@query("align_spans", f'WITH {ALIGNED} SELECT id, t, masked, ({_whole[0]})::INT AS "from", ({_whole[1]})::INT AS "to" FROM al')
def align_spans(spark, d):
    rows = masked(urls(spark, d)).where("masked != ''")
    whole = text.aligned_span(c("t"), c("masked"), F.lit(0), F.length("masked"))
    return rows.select("id", "t", "masked", whole["start"].alias("from"), whole["end"].alias("to"))


#: Spans of every third character and five long, most of them aligned through the shared prefix or suffix.
_piece = aligned_sql("s", "e")


@query("align_pieces", f"WITH {ALIGNED}, pc AS (SELECT *, unnest(range(0, length(masked), 3)) AS s FROM al), pd AS (SELECT *, s + 5 AS e FROM pc) SELECT id, s::INT AS s, ({_piece[0]})::INT AS a, ({_piece[1]})::INT AS z FROM pd")
def align_pieces(spark, d):
    rows = masked(urls(spark, d)).where("masked != ''").select("id", "t", "masked", F.explode(F.sequence(F.lit(0), F.length("masked") - 1, F.lit(3))).alias("s"))
    at = text.aligned_span(c("t"), c("masked"), c("s"), c("s") + 5)
    return rows.select("id", "s", at["start"].alias("a"), at["end"].alias("z"))
