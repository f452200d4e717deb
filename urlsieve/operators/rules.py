"""Rule checks on a preprocessed URL: they explain, and never change a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlsieve.functions import suffix, text
from urlsieve.functions import values as V
from urlsieve.operators.brands import lookalike

#: Rule ids in order, and their titles.
TITLES = {"rule-ip-host": "Numeric host", "rule-punycode": "Encoded host name", "rule-unusual-tld": "Ending often seen in phishing", "rule-brand-lookalike": "Imitated brand name", "rule-long-url": "Very long URL"}


def percent(share: float) -> str:
    short = f"{share:.1%}"
    return f"{share:.2%}" if share < 1 and short == "100.0%" else short


def counted(rows: int, share: float) -> str:
    return f"{percent(share)} of {rows:,} such URLs in the statistics were phishing"


SUFFIX_TEXT = {s: counted(*x) for s, x in V.RISKY_SUFFIXES.items()}
RULE_TEXT = {name: counted(*x) for name, x in V.RULE_STATS.items()}


def span_of(whole: Column, start: Column, part: Column) -> Column:
    """(start, end, text) if part stands at start of whole, else three nulls."""
    ok = (part != "") & (F.substring(whole, start + 1, F.length(part)) == part)
    return F.struct(F.when(ok, start).alias("start"), F.when(ok, start + F.length(part)).alias("end"), F.when(ok, part).alias("text"))


def signal_rows(rows: DataFrame, analysed: Column, key: str = "id") -> DataFrame:
    """(key, rule, title, start, end, text, explanation): a row per rule that applies, in the rules' order."""
    rows = rows.select(key, analysed.alias("_t")).withColumn("_host", text.host_for_rules(F.col("_t")))
    rows = rows.select(key, "_t", *[F.col(f"_host.{n}").alias(f"_{n}") for n in ("start", "end", "text")])
    rows = suffix.attach(rows, F.col("_text"), names=("_suffix", "_label", "_sub", "_domain"))
    rows = rows.withColumn("_brand", lookalike(F.col("_label")))
    t, start, end, host = (F.col(n) for n in ("_t", "_start", "_end", "_text"))
    tail, label, sub, brand = (F.col(n) for n in ("_suffix", "_label", "_sub", "_brand"))
    table = F.create_map(*[F.lit(x) for pair in SUFFIX_TEXT.items() for x in pair])
    none = F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("text"))
    label_at = start + F.when(sub != "", F.length(sub) + 1).otherwise(0)
    rules = (
        ("rule-ip-host", host.rlike(text.IP), span_of(t, start, host), F.lit(RULE_TEXT["ip_host"])),
        ("rule-punycode", host.contains("xn--"), span_of(t, start, host), F.lit(RULE_TEXT["punycode_host"])),
        ("rule-unusual-tld", tail.isin(*SUFFIX_TEXT), span_of(t, end - F.length(tail), tail), F.concat(F.lit("."), tail, F.lit(": "), F.try_element_at(table, tail))),
        ("rule-brand-lookalike", brand.isNotNull(), span_of(t, label_at, label), F.concat(F.lit('reads as "'), brand, F.lit(f'"; {RULE_TEXT["brand_lookalike"]}'))),
        ("rule-long-url", F.length(t) > V.LONG_URL, none, F.lit(f"over {V.LONG_URL} characters; {RULE_TEXT['long_url']}")),
    )
    made = [F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(TITLES[n]).alias("title"), sp["start"].alias("start"), sp["end"].alias("end"), sp["text"].alias("text"), why.alias("explanation"))) for n, hit, sp, why in rules]
    return rows.select(key, F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))
