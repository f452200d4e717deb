"""Block and allow rules for URLs, carried to aliases by redirect and canonical-link edges; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm.common import components, free, quoted

#: (host, path prefix, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Query parameters that don't change what a URL shows.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref)=[^&#]*"
#: What is no markup; whole tags that may name another URL of a page; their attributes, in turn, with values as written.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script[\s>].*?</script[\s>]|<style[\s>].*?</style[\s>]"
TAG = r"""(?i)<(?:link|meta)[ \t\n\f\r/](?:[^>"']|"[^"]*"|'[^']*')*>"""
ATTRIBUTE = r"""[ \t\n\f\r/]([^ \t\n\f\r"'>/=]+)(?:[ \t\n\f\r]*=[ \t\n\f\r]*("[^"]*"|'[^']*'|[^ \t\n\f\r"'>]+))?"""
CANONICAL = r"(?i)(?:^|[ \t\n\f\r])canonical(?:[ \t\n\f\r]|$)"
TARGET = r"""(?i)\burl\s*=\s*["']?([^"']+)"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as a struct (rule, verdict), or null: its host or a subdomain, and its path's start."""
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        hit = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        fit = F.when(hit, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def spelling(url: Column) -> Column:
    """The spelling that a site's own redirects lead to: https, lower-case host, no fragment, tracking or last slashes."""
    rest = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), rf"(?<=[?&]){TRACKING}(?:&|$)", "")
    return F.when(url.contains("://"), F.concat(F.lit("https://"), host_of(url), F.regexp_replace(rest, r"/*[?&]*$", "")))


def _without_dots(path: Column) -> Column:
    """A path from / on, without . and .. segments."""
    parts = F.split(path, "/", -1)

    def step(before: Column, part: Column) -> Column:
        up = F.when(F.size(before) > 1, F.slice(before, 1, F.size(before) - 1)).otherwise(before)
        return F.when(part == "..", up).when(part == ".", before).otherwise(F.concat(before, F.array(part)))

    left = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.array_join(left, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))


def resolved(url: Column, link: Column) -> Column:
    """A link of the page at url as an absolute URL; null for an empty one, a mere fragment and schemes without ://."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme, path = F.regexp_extract(url, r"(?s)^(.*?)://", 1), path_of(url)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    body, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    inside = F.when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(site, _without_dots(body), rest))
    inside = inside.when(link.startswith("?"), F.concat(site, path, link)).when((link != "") & ~link.startswith("#"), F.concat(site, _without_dots(F.concat(folder, body)), rest))
    return F.when(link.rlike(SCHEME), F.when(link.contains("://"), link)).when(url.contains("://"), inside)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name without its quotes, empty if it has none; null without the attribute."""
    every = F.zip_with(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)), F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)), lambda n, v: F.struct(n.alias("n"), v.alias("v")))
    value = F.get(F.filter(every, lambda x: F.lower(x["n"]) == name), 0)["v"]
    return F.when(value.rlike("(?s)^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): each URL and its canonical spelling, its canonical links and the targets of its refreshes, as spelled there.

    Tags in comments, scripts and styles don't count; an attribute stands behind white space, and a quoted value is one unit.
    """
    url, html = F.col(quoted(url_col)), F.col(quoted(html_col))

    tags = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, " "), F.lit(TAG), F.lit(0))
    links = F.transform(F.filter(tags, lambda t: attribute(t, "rel").rlike(CANONICAL)), lambda t: resolved(url, attribute(t, "href")))
    moves = F.filter(tags, lambda t: F.lower(F.trim(attribute(t, "http-equiv"))) == "refresh")
    moves = F.transform(moves, lambda t: resolved(url, F.regexp_extract(attribute(t, "content"), TARGET, 1)))
    both = F.concat(F.coalesce(links, F.array().cast("array<string>")), F.coalesce(moves, F.array().cast("array<string>")))
    rows = pages.where(url.isNotNull()).select(url.alias("a"), F.explode(F.array_distinct(F.concat(F.array(spelling(url)), both, F.transform(both, spelling)))).alias("b"))
    return rows.where("b IS NOT NULL AND a != b")


def judge(pages: DataFrame, rules=RULES, more_edges: DataFrame | None = None, default: str = "allow", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with host, path, rule, verdict and alias (the smallest URL of its component, or its own); a row per row.

    A page that a rule fits has the rule's verdict. Another has that of its component of URLs that redirects and
    canonical links join: allow if a rule allows any of them, else block if a rule blocks any, else default. More edges
    (a, b) may be given, such as a crawler's redirects. Null URLs or URLs without :// have empty host and path, no rule
    and no alias but themselves. Repeated pages each get a row, an empty table none. Columns of pages of the same names
    as the new ones are replaced; others may have any names.
    """
    new = ["host", "path", "rule", "verdict", "alias"]
    pages = pages.drop(*new)
    found = edges(pages, url_col, html_col)
    if more_edges is not None:
        found = found.union(more_edges.select("a", "b"))
    parts = components(found)
    fit = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    decided = parts.select("component", fit["verdict"].alias("v")).where("v IS NOT NULL").groupBy("component").agg(F.min("v").alias("from_alias"))  # allow sorts before block
    node, group, carried = free(pages, "_node", "_component", "_carried")
    alias = parts.join(decided, "component", "left").select(F.col("node").alias(node), F.col("component").alias(group), F.col("from_alias").alias(carried))
    url = F.col(quoted(url_col))
    rows = pages.join(alias, url == F.col(node), "left")
    own = rule_of(host_of(url), path_of(url), rules)
    found = host_of(url), path_of(url), own["rule"], F.coalesce(own["verdict"], F.col(carried), F.lit(default)), F.coalesce(F.col(group), url)
    return rows.select(*[quoted(c) for c in pages.columns], *[x.alias(name) for x, name in zip(found, new, strict=True)])


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "alias")


_HOST = r"lower(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1))"
_PATH = r"regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _sql() -> str:
    def fit(host: str, path: str, k: int) -> str:
        cases = [f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '{p}') THEN '{(h + p, v)[k]}'" for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
        return f"CASE {' '.join(cases)} END"

    def spelled(u: str) -> str:
        # RE2 has no look-behind: doubled separators let neighbouring parameters match one by one
        rest = f"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
        query = f"array_to_string(list_filter(string_split(split_part({rest}, '?', 2), '&'), lambda q: NOT regexp_full_match(q, '(utm_[a-z]+|gclid|fbclid|ref)=[^&#]*')), '&')"
        return f"CASE WHEN contains({u}, '://') THEN 'https://' || {_HOST.format(u)} || regexp_replace(split_part({rest}, '?', 1) || '?' || {query}, '/*[?&]*$', '') END"

    def dotless(p: str) -> str:
        fold = f"list_reduce(list_transform(string_split({p}, '/'), lambda s: [s]), lambda q, s: CASE WHEN s[1] = '..' THEN CASE WHEN len(q) > 1 THEN q[:-2] ELSE q END WHEN s[1] = '.' THEN q ELSE q || s END)"
        return f"array_to_string({fold}, '/') || CASE WHEN regexp_matches({p}, '(^|/)[.][.]?$') THEN '/' ELSE '' END"

    def absolute(u: str, x: str) -> str:
        site, path = f"split_part({u}, '://', 1) || '://' || {_HOST.format(u)}", _PATH.format(u)
        body, rest = f"regexp_extract({x}, '(?s)^([^?#]*)', 1)", f"regexp_extract({x}, '(?s)^[^?#]*(.*)$', 1)"
        folder = f"CASE WHEN {path} = '' THEN '/' ELSE regexp_replace({path}, '[^/]*$', '') END"
        return (
            f"CASE WHEN regexp_matches({x}, '{SCHEME}') THEN CASE WHEN contains({x}, '://') THEN {x} END WHEN NOT contains({u}, '://') THEN NULL"
            f" WHEN starts_with({x}, '//') THEN split_part({u}, '://', 1) || ':' || {x} WHEN starts_with({x}, '/') THEN {site} || {dotless(body)} || {rest}"
            f" WHEN starts_with({x}, '?') THEN {site} || {path} || {x} WHEN {x} != '' AND NOT starts_with({x}, '#') THEN {site} || {dotless(f'(({folder}) || {body})')} || {rest} END"
        )

    def text(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def value(name: str) -> str:
        both = f"list_zip(regexp_extract_all(t, {text(ATTRIBUTE)}, 1), regexp_extract_all(t, {text(ATTRIBUTE)}, 2))"
        v = f"list_filter({both}, lambda x: lower(x[1]) = '{name}')[1][2]"
        return f"(CASE WHEN regexp_matches({v}, '(?s)^[\"'']') THEN substr({v}, 2, length({v}) - 2) ELSE {v} END)"

    tags = f"regexp_extract_all(regexp_replace(coalesce(html, ''), {text(HIDDEN)}, ' ', 'g'), {text(TAG)}, 0)"
    links = f"list_transform(list_filter(tags, lambda t: regexp_matches({value('rel')}, {text(CANONICAL)})), lambda t: {value('href')})"
    target = f"regexp_extract({value('content')}, {text(TARGET)}, 1)"
    moves = f"list_transform(list_filter(tags, lambda t: lower(trim({value('http-equiv')})) = 'refresh'), lambda t: {target})"
    return f"""
WITH RECURSIVE g AS (SELECT url, {tags} AS tags FROM pages WHERE url IS NOT NULL),
l0 AS (SELECT url, unnest({links} || {moves}) AS x FROM g),
l AS (SELECT url, replace(trim(x), '&amp;', '&') AS x FROM l0),
r AS (SELECT url, {absolute('url', 'x')} AS x FROM l),
e0 AS (SELECT url AS a, x AS b FROM r UNION SELECT url, {spelled('x')} FROM r UNION SELECT url, {spelled('url')} FROM pages WHERE url IS NOT NULL),
e AS (SELECT a, b FROM e0 WHERE b IS NOT NULL AND a != b UNION SELECT b, a FROM e0 WHERE b IS NOT NULL AND a != b),
c AS (SELECT DISTINCT a AS node, a AS far FROM e UNION SELECT c.node, e.b FROM c JOIN e ON c.far = e.a),
v AS (SELECT node, min(far) AS alias, min({fit(_HOST.format('far'), _PATH.format('far'), 1)}) AS verdict FROM c GROUP BY node),
p AS (SELECT page_id, url, coalesce({_HOST.format('url')}, '') AS host, coalesce({_PATH.format('url')}, '') AS path FROM pages)
SELECT page_id, host, path, {fit('host', 'path', 0)} AS rule, coalesce({fit('host', 'path', 1)}, v.verdict, 'allow') AS verdict, coalesce(v.alias, url) AS alias
FROM p LEFT JOIN v ON p.url = v.node
"""


SQL = _sql()
