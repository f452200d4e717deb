"""Columns over URL text. Offsets and lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urlsieve.functions import values as V

#: White space as Python's str.strip knows it.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://"
IP = r"^(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}$"
PORT = r":\p{Nd}+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def scheme(x: Column) -> Column:
    """The scheme in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(x, SCHEME, 1))


def without_scheme(x: Column) -> Column:
    return F.regexp_replace(x, SCHEME, "")


def preprocess(x: Column) -> Column:
    return F.lower(without_scheme(strip(x)))


def canonical(x: Column) -> Column:
    """What two spellings of one URL share: no outer space, scheme, case or last slashes; null is empty."""
    return F.regexp_replace(without_scheme(F.lower(strip(F.coalesce(x, F.lit(""))))), "/+$", "")


def until(x: Column, signs: str) -> Column:
    """x up to the first of these characters."""
    return F.regexp_extract(x, f"^[^{signs}]*", 0)


def after_at(x: Column) -> Column:
    return F.regexp_replace(x, "(?s)^.*@", "")


def host_for_features(rest: Column) -> Column:
    """Host of a URL without scheme, with its port and case."""
    return after_at(until(rest, "/?#"))


def host_for_dedup(url: Column) -> Column:
    """Lower case, ends at / or ? but not at #, cut at its first colon."""
    return until(after_at(until(without_scheme(F.lower(strip(url))), "/?")), ":")


def host_for_reports(url: Column) -> Column:
    """As host_for_dedup, in the URL's own case."""
    return until(after_at(until(without_scheme(strip(url)), "/?")), ":")


def host_for_rules(text: Column) -> Column:
    """(start, end, text) of the host without user and port, null if there is none."""
    authority = until(text, "/?#")
    host = after_at(authority)
    bare = without_port(host)
    start = F.length(authority) - F.length(host)
    return F.when(bare != "", F.struct(start.alias("start"), (start + F.length(bare)).alias("end"), bare.alias("text")))


def host_span(url: Column) -> Column:
    """(start, end) of everything between the scheme and the first of /, ? and #."""
    start = F.length(F.regexp_extract(url, SCHEME, 0))
    return F.struct(start.alias("start"), (start + F.length(until(without_scheme(url), "/?#"))).alias("end"))


def host_for_sanity(url: Column) -> Column:
    """The host as a URL parser sees it, http:// assumed, without user, port and brackets; empty where there is none or brackets don't pair."""
    clean = F.regexp_replace(url, "[\\t\\r\\n]", "")
    full = F.when(clean.contains("://"), clean).otherwise(F.concat(F.lit("http://"), clean))
    place = F.regexp_extract(full, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    host = after_at(place)
    inside = F.regexp_extract(host, r"^\[([^\]]*)\]", 1)
    odd = place.contains("[") != place.contains("]")
    return F.lower(F.when(odd, F.lit("")).when(host.startswith("["), inside).otherwise(until(host, ":")))


def without_port(host: Column) -> Column:
    return F.regexp_replace(host, PORT, "")


def after_host(rest: Column, host: Column) -> Column:
    """What follows the host, or all of it if it doesn't begin with the host (as with user@host)."""
    return F.when(rest.startswith(host), F.substring(rest, F.length(host) + 1, F.length(rest))).otherwise(rest)


def path_of(after: Column) -> Column:
    return until(after, "?#")


def query_of(after: Column) -> Column:
    """After the first ?, even one inside a fragment, up to #."""
    return F.regexp_extract(after, r"(?s)^[^?]*\?([^#]*)", 1)


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def keyword_count(url: Column) -> Column:
    return count(F.lower(url), "|".join(V.KEYWORDS))


def last_label(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([^.]*)$", 1)


def translated(x: Column, table: dict[str, str]) -> Column:
    return F.translate(x, "".join(table), "".join(table.values()))


def without_homoglyphs(x: Column) -> Column:
    return translated(x, V.HOMOGLYPHS)


def without_leetspeak(x: Column) -> Column:
    return F.replace(translated(x, V.LEETSPEAK), F.lit("rn"), F.lit("m"))


def is_ascii(x: Column) -> Column:
    return ~x.rlike(r"[^\x00-\x7F]")


def entropy(x: Column) -> Column:
    """Shannon entropy of the characters in bits, 0 for an empty string; by run lengths of the sorted characters."""
    chars = F.split(x, "")
    n = F.length(x).cast("double")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(x == "", F.lit(0.0)).otherwise(-F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * longest common subsequence / total length; 1 for two empty strings."""
    row0 = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))
    chars_a, chars_b = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")

    def next_row(row: Column, c: Column) -> Column:
        pairs = F.zip_with(chars_b, F.sequence(F.lit(1), F.greatest(F.size(chars_b), F.lit(1))), lambda d, j: F.struct(d.alias("d"), j.alias("j")))
        pairs = F.filter(pairs, lambda p: p["d"].isNotNull())
        return F.aggregate(pairs, F.array(F.lit(0)), lambda new, p: F.concat(new, F.array(F.when(p["d"] == c, F.get(row, p["j"] - 1) + 1).otherwise(F.greatest(F.get(row, p["j"]), F.get(new, p["j"] - 1))))))

    last = F.aggregate(chars_a, row0, next_row)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.element_at(last, -1) / total)


def ngrams(x: Column, low: int = 3, high: int = 5) -> Column:
    """(start, gram) of all character n-grams, by size and then position."""
    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.length(x) - n), lambda i: F.struct(i.alias("start"), F.substring(x, i + 1, F.lit(n)).alias("gram")))
        return F.when(F.length(x) >= n, grams).otherwise(F.array().cast("array<struct<start:int,gram:string>>"))

    parts = [of(n) for n in range(low, high + 1)]
    return F.concat(*parts)


def hash_prefix(x: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(F.md5(x), 1, digits), 16, 10).cast("long")


#: Buckets that n-grams are hashed into.
BUCKETS = 1 << 20


def bucket(gram: Column, size: int = BUCKETS) -> Column:
    return hash_prefix(gram) % size


def gram_buckets(x: Column) -> Column:
    """The buckets of all n-grams, in order of the grams."""
    return F.transform(ngrams(x), lambda g: bucket(g["gram"]))


def bucket_counts(x: Column) -> Column:
    """An array of (bucket, tf): how often each bucket of n-grams occurs in the text, by runs of its sorted buckets."""
    let = lambda value, make: F.get(F.transform(F.array(value), make), F.lit(0))  # noqa: E731  evaluated once, not in each step of make
    first = lambda b: F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: (i == 0) | (F.get(b, i) != F.get(b, i - 1)))

    def runs(b: Column) -> Column:
        return let(first(b), lambda at: F.transform(at, lambda i, k: F.struct(F.get(b, i).alias("bucket"), (F.coalesce(F.get(at, k + 1), F.size(b)) - i).cast("long").alias("tf"))))

    return F.when(F.length(x) >= 3, let(F.sort_array(gram_buckets(x)), runs)).otherwise(F.array().cast("array<struct<bucket:bigint,tf:bigint>>"))


def percent(share: Column) -> Column:
    """One decimal; two where a share below 1 would read 100.0%."""
    one = F.format_string("%.1f%%", share * 100)
    return F.when((share < 1) & (one == "100.0%"), F.format_string("%.2f%%", share * 100)).otherwise(one)


def confidence_text(x: Column) -> Column:
    """0% for what isn't a number from 0 to 1, Over 99% from 99.5% on, else whole percents."""
    bad = x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
    return F.when(bad, "0%").when(x * 100 >= 99.5, "Over 99%").otherwise(F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%")))


def shortened(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def check_url(raw: Column) -> Column:
    """Error code of the first check that fails, null if all hold."""
    url = strip(raw)
    prefix = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 0)
    name = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    rest = F.substring(url, F.length(prefix) + 1, F.length(url))
    has = (prefix != "") & ~rest.rlike(r"^\p{Nd}") & ~name.contains(".")
    return (
        F.when(raw.isNull() | (F.length(url) < 1) | (F.length(url) > V.MAX_URL_LENGTH), "url_length")
        .when(url.rlike(rf"{SPACE}|[\p{{Cc}}\p{{Cf}}\p{{Cs}}\p{{Zl}}\p{{Zp}}\p{{Zs}}]"), "url_characters")
        .when(has & (~F.lower(name).isin("http", "https") | ~rest.startswith("//")), "url_scheme")
        .when(has & (rest == "//"), "url_empty")
    )


def check_in_client(raw: Column) -> Column:
    """As check_url with the codes of the form's own checks, and a check that the host looks like one."""
    url = strip(F.coalesce(raw, F.lit("")))
    prefix = F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.\-]*):", 0)
    name = F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.\-]*):", 1)
    rest = F.substring(url, F.length(prefix) + 1, F.length(url))
    has = (prefix != "") & ~rest.rlike("^[0-9]") & ~name.contains(".")
    host = until(without_scheme(url), "/?#")
    return (
        F.when(url == "", "empty")
        .when(F.length(url) > V.MAX_URL_LENGTH, "too_long")
        .when(url.rlike(SPACE), "spaces")
        .when(url.rlike(r"\p{Cc}"), "characters")
        .when(url.rlike(r"[\p{Cf}\p{Cs}\p{Zl}\p{Zp}\p{Zs}]"), "hidden")
        .when(has & ~(F.lower(name).isin("http", "https") & rest.startswith("//")), "scheme")
        .when(~host.rlike(r"[^.]\.[^.]") & ~host.rlike(r"(?i)^(\[[0-9a-f.]*:[0-9a-f:.]*\]|localhost)(:[0-9]+)?$"), "host")
    )


def decide(p: Column, threshold: float | Column = 0.5) -> Column:
    """(label, confidence, trust): phishing from the threshold on; trust rounds half to even."""
    t = F.lit(threshold) if isinstance(threshold, float) else threshold
    return F.struct(
        F.when(p >= t, "phishing").otherwise("legitimate").alias("label"),
        F.when(p >= t, p).otherwise(1 - p).alias("confidence"),
        F.bround(100 * (1 - p), 0).cast("int").alias("trust"),
    )


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters the two texts begin with alike."""
    chars = [F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)) for x in (a, b)]
    first = F.array_position(F.zip_with(*chars, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first == 0, F.length(a)).otherwise(first - 1).cast("int")


def aligned_span(analysed: Column, model_input: Column, start: Column, end: Column) -> Column:
    """(start, end) in analysed of [start, end) of model_input, null if any of it has no place there.

    The two texts share a prefix and a suffix; a middle that is just the brand mask stands for what it replaced.
    """
    a, m = analysed, model_input
    prefix = common_prefix(a, m)
    suffix = F.least(common_prefix(F.reverse(a), F.reverse(m)), F.least(F.length(a), F.length(m)) - prefix)
    middle_end, shift = F.length(m) - suffix, F.length(a) - F.length(m)
    masked = (F.substring(m, prefix + 1, F.greatest(middle_end - prefix, F.lit(0))) == V.BRAND_MASK) & (F.length(a) - suffix > prefix)
    from_ = F.when(start < prefix, start).when(start >= middle_end, start + shift).otherwise(prefix)
    to = F.when(end <= prefix, end).when(end > middle_end, end + shift).otherwise(F.length(a) - suffix)
    inside = (start < middle_end) & (end > prefix)
    same = F.struct(start.alias("start"), end.alias("end"))
    return F.when((end <= start) | (start < 0) | (end > F.length(m)), F.lit(None)).when(a == m, same).when(inside & ~masked, F.lit(None)).otherwise(F.struct(from_.alias("start"), to.alias("end")))
