"""Quality rules as a short-circuit cascade, ordered by rejections per cost as estimated on a sample."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm.common import WORD, free, quoted, take_worker

_WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Texts, and characters of all of them, on which costs and rejections are estimated, from so many partitions at most; only
#: the order of the rules, never a verdict, depends on them.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_PARTS = 256, 1 << 22, 32
#: Nanoseconds of the steps that measures are made of, as measured once: per character or word that a step goes through.
SPLIT, COUNT, LINE, MEASURE, LETTERS, GROUP = 25.0, 2.0, 3.0, 30.0, 80.0, 250.0


class Text:
    """Measures of one text, each computed when a rule first asks for it, and the estimated cost of those computed so far."""

    def __init__(self, text: str | None):
        self.text, self.cost = text or "", 0.0

    @cached_property
    def words(self) -> list[str]:
        self.cost += SPLIT * len(self.text)
        return _WORDS.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        self.cost += MEASURE * len(self.words)
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        self.cost += COUNT * len(SYMBOLS) * len(self.text)
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        self.cost += LINE * len(self.text)
        return [x for x in self.text.split("\n") if x.strip(" \t\n\v\f\r")]

    @cached_property
    def n_dup_lines(self) -> int:
        self.cost += LINE * len(self.text)
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_letter_words(self) -> int:
        self.cost += LETTERS * len(self.words)
        return sum(w.isalpha() or any(map(str.isalpha, w)) for w in self.words)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of five words that the text holds more than once, each word counted once."""
        w = self.words
        self.cost += GROUP * len(w)
        found = list(zip(*(w[k:] for k in range(WINDOW)), strict=False))
        if len(set(found)) == len(found):
            return 0
        times, end, n = Counter(found), 0, 0
        for i, x in enumerate(found):
            if times[x] > 1:
                n += i + WINDOW - max(end, i)
                end = i + WINDOW
        return n


@dataclass(frozen=True)
class Rule:
    """rejects(text) is true where the document must go; cost is that of asking, beside the measures that it needs."""

    name: str
    rejects: Callable[[Text], bool]
    cost: float = 100.0


BASE = (
    Rule("too_few_words", lambda t: t.n_words < 10),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda t: t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("duplicate_lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("few_letters", lambda t: 2 * t.n_letter_words < t.n_words),
)


def estimated(texts: list[str | None], rules=RULES) -> list[tuple[str, float, float]]:
    """(rule, share of the texts left that it rejects, cost of a text left) of the rules in the best order.

    The rule that rejects most for its cost comes next, on the texts that those before it leave and with the measures that
    they have already taken; ties go to the cheaper rule, then to the order given.
    """
    left, out, rest = [Text(t) for t in texts], [], list(rules)
    while rest:
        tried = []
        for rule in rest:
            spent, hits = rule.cost * len(left), 0
            for t in left:
                trial = copy(t)
                hits += rule.rejects(trial)
                spent += trial.cost - t.cost
            tried.append((hits / max(1.0, spent), -spent, rule, hits, spent))
        _, _, rule, hits, spent = max(tried, key=lambda x: x[:2])
        out.append((rule.name, hits / max(1, len(left)), spent / max(1, len(left))))
        left = [t for t in left if not rule.rejects(t)]
        rest.remove(rule)
    return out


def sampled(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, parts: int = SAMPLE_PARTS) -> list[str | None]:
    """Texts from partitions spread evenly over the table, the first ones of each; no other partition is read.

    Bounded in texts and, beyond the first one of a partition, in characters. The same table gives the same texts.
    """
    rdd = docs.select(F.col(quoted(text_col)).cast("string")).rdd
    n = rdd.getNumPartitions()
    spots = sorted({k * n // min(parts, n) for k in range(min(parts, n))})
    if not spots:
        return []
    each, room = -(-rows // len(spots)), chars // len(spots)

    def first(found: Iterator) -> Iterator[str | None]:
        used = 0
        for row in islice(found, each):
            if used and used + len(row[0] or "") > room:
                break
            used += len(row[0] or "")
            yield row[0]

    return docs.sparkSession.sparkContext.runJob(rdd, first, spots)


def ordered(docs: DataFrame, rules=RULES, text_col: str = "text", **kw) -> tuple[Rule, ...]:
    """The rules by rejections per cost on a bounded sample, most first."""
    by = {r.name: r for r in rules}
    return tuple(by[name] for name, _, _ in estimated(sampled(docs, text_col, **kw), rules))


def verdict(column: str | Column, rules: tuple[Rule, ...], measures: tuple[str, ...] = ()) -> Column:
    """A struct: kept, rejected_by (the first rule in the order that rejects), and the measures asked for, as longs."""

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        take_worker()
        for texts in batches:
            rows = []
            for x in texts:
                t = Text(x)
                by = next((r.name for r in rules if r.rejects(t)), None)
                rows.append((by is None, by, *(getattr(t, m) for m in measures)))
            yield pd.DataFrame(rows, columns=["kept", "rejected_by", *measures])

    kind = "kept boolean, rejected_by string" + "".join(f", {m} long" for m in measures)
    return F.pandas_udf(judge, kind)(F.col(column) if isinstance(column, str) else column)


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", measures: tuple[str, ...] = (), column: str = "quality") -> DataFrame:
    """docs with a struct column of the verdict: kept, rejected_by and measures. A row per row, no shuffle.

    Rules after the first that rejects are not evaluated. Which rows are kept doesn't depend on the rules' order;
    rejected_by does. Null and empty texts have no word and are rejected by too_few_words. Equal texts have equal verdicts.
    An empty table gives no rows. Column `column` of docs is replaced if it is there.
    """
    return docs.withColumn(column, verdict(F.col(quoted(text_col)).cast("string"), ordered(docs, rules, text_col), measures))


def keep_good(docs: DataFrame, **kw) -> DataFrame:
    """docs without the rows that a rule rejects, with the same columns, whatever their names."""
    (column,) = free(docs, "_quality")
    return cascade(docs, column=column, **kw).where(F.col(column)["kept"]).select(*[quoted(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = cascade(docs, measures=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), column="q").select("doc_id", "q.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (
  SELECT *, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: w[i : i + 4]) AS win FROM d),
k AS (
  SELECT doc_id, unnest(win) AS x, unnest(range(len(win))) AS i FROM g),
c AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM k) WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT g.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words
  FROM g LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 20 * n_words
    AND 100 * n_dup_lines <= 30 * n_lines AND 2 * n_letter_words >= n_words AS kept
FROM b
"""
