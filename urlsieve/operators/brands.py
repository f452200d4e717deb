"""Brand look-alikes: masks of official domains, folding, and the closest brand of a label."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.functions import suffix, text
from urlsieve.functions import values as V


def brand_table(spark: SparkSession, ranking: DataFrame | None = None) -> DataFrame:
    """(brand): the curated labels and, if given, those of a ranking's domains (column domain, or label_name), distinct and lower case."""
    found = spark.createDataFrame([(b,) for b in V.CURATED_BRANDS], "brand string")
    if ranking is not None:
        known = "label_name" in ranking.columns
        found = found.union((ranking if known else suffix.attach(ranking.where("domain != ''").select("domain"), F.lower("domain"))).select("label_name"))
    return found.select(F.lower(text.strip(F.col("brand"))).alias("brand")).where("brand != ''").distinct()


class Matcher:
    """The closest of many brands to a label: longest common subsequences with all brands at once, a bit per character."""

    def __init__(self, brands: Iterable[str]):
        self.brands = sorted(set(brands))
        self.place = {c: k for k, c in enumerate(sorted(set("".join(self.brands))), 1)}
        self.sizes = np.array([len(b) for b in self.brands], np.int64)
        self.steps = np.zeros((max(map(len, self.brands), default=0), len(self.brands)), np.int64)
        for k, b in enumerate(self.brands):
            self.steps[: len(b), k] = [self.place[c] for c in b]
        #: How often each character is in each brand; place 0 is for all others.
        self.letters = np.zeros((len(self.brands), len(self.place) + 1), np.int16)
        for k, b in enumerate(self.brands):
            np.add.at(self.letters[k], self.steps[: len(b), k], 1)

    def common(self, label: str, some: np.ndarray | None = None) -> np.ndarray:
        """The length of the longest common subsequence with each brand, or some of them, 63 characters of the label in a word."""
        steps = self.steps if some is None else self.steps[: self.sizes[some].max(initial=0), some]
        n = steps.shape[1]
        words = -(-len(label) // 63)
        where = np.zeros((max(1, words), len(self.place) + 1), np.uint64)
        for i, c in enumerate(label):
            if c in self.place:
                where[i // 63, self.place[c]] |= np.uint64(1 << i % 63)
        low = np.uint64((1 << 63) - 1)
        rows = [np.full(n, low) for _ in range(words)]
        for step in steps:
            carry = np.zeros(n, np.uint64)
            for w, row in enumerate(rows):
                hit = row & where[w, step]
                total = row + hit + carry
                carry = total >> np.uint64(63)
                rows[w] = (total | (row - hit)) & low
        return sum((63 - np.bitwise_count(row).astype(np.int64) for row in rows), np.zeros(n, np.int64))

    def __call__(self, label: str) -> tuple[float, str]:
        """The best ratio of 2 * common subsequence to total length, and its brand, the first in order among equals.

        Shared characters, however ordered, bound the subsequence: brands are compared in order of that bound, a few at
        once, until it is under the best ratio found.
        """
        if not self.brands:
            return -1.0, ""
        total = self.sizes + len(label)
        own = np.zeros(len(self.place) + 1, np.int16)
        for c in label:
            own[self.place.get(c, 0)] += 1
        shared = np.minimum(self.letters, own).sum(axis=1)
        bound = np.where(total > 0, 2 * shared / np.maximum(total, 1), 1.0)
        order = np.argsort(-bound, kind="stable")
        best, at = (-1.0, len(self.brands)), 0
        while at < len(order) and bound[order[at]] >= best[0]:
            some = order[at : at + 16]
            score = np.where(total[some] > 0, 2 * self.common(label, some) / np.maximum(total[some], 1), 1.0)
            top = score.max()
            k = int(some[score == top].min())
            if top > best[0] or top == best[0] and k < best[1]:
                best = float(top), k
            at += 16
        return best[0], self.brands[best[1]]


def similarity(rows: DataFrame, label: str, brands: list[str]) -> DataFrame:
    """rows with brand_similarity_score, matched_brand and is_exact_brand_match.

    Distinct labels are matched, raw and folded, and joined back; the folded match counts only if it is strictly better.
    brands is a model's fixed list, sent with the code.
    """
    ordered = sorted(set(brands))

    @F.pandas_udf("score double, brand string")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        closest = Matcher(ordered)
        for raw, folded in batches:
            out = []
            for a, b in zip(raw, folded, strict=True):
                x = closest(a)
                y = x if a == b else closest(b)
                out.append(y if y[0] > x[0] else x)
            yield pd.DataFrame(out, columns=["score", "brand"])

    distinct = rows.select(F.col(label).alias("_label")).where(F.col("_label").isNotNull()).distinct()
    found = distinct.withColumn("m", match("_label", text.without_leetspeak(text.without_homoglyphs(F.col("_label")))))
    found = found.select("_label", F.col("m.score").alias("brand_similarity_score"), F.col("m.brand").alias("matched_brand"), F.col("_label").isin(ordered).cast("int").alias("is_exact_brand_match"))
    return rows.join(found, rows[label] == found["_label"], "left").drop("_label")


def fold(x: Column) -> Column:
    """NFKC, lower case, look-alikes as Latin letters. Only texts that aren't ASCII are sent to Python."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = str.maketrans(V.CONFUSABLES)
        for texts in batches:
            yield texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t).lower().translate(table))

    return F.coalesce(run(F.when(~text.is_ascii(x), x)), F.lower(x))


def mask(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with `out`: the preprocessed URL, an official domain's label replaced by the mask."""
    t = text.preprocess(F.col(column))
    rows = rows.withColumn("_t", t)
    rows = rows.withColumn("_au", text.until(F.col("_t"), "/?#"))
    rows = rows.withColumn("_hh", text.after_at(F.col("_au")))
    rows = rows.withColumn("_host", text.without_port(F.col("_hh")))
    rows = suffix.attach(rows, F.col("_host"), names=("_end", "_label", "_sub", "_domain"))
    host = F.concat(F.when(F.col("_sub") != "", F.concat("_sub", F.lit("."))).otherwise(""), F.lit(V.BRAND_MASK + "."), "_end", F.expr("substr(_hh, length(_host) + 1)"))
    spliced = F.concat(F.expr("left(_t, length(_au) - length(_hh))"), host, F.expr("substr(_t, length(_au) + 1)"))
    masked = F.when(F.col("_domain").isin(*V.OFFICIAL_DOMAINS), spliced).otherwise(F.col("_t"))
    return rows.withColumn(out, masked).drop("_t", "_au", "_hh", "_host", "_end", "_label", "_sub", "_domain")


def model_inputs(rows: DataFrame, url: str = "url") -> DataFrame:
    """rows with baseline, naive_fold and defended: three texts of one URL for one scorer.

    The defended text is folded and masked, but not masked where only folding made the domain official.
    """
    rows = rows.withColumn("_folded", fold(text.strip(F.col(url)))).withColumn("_plain", text.preprocess(F.col(url))).withColumn("_flat", text.preprocess(F.col("_folded")))
    rows = mask(mask(rows, url, "baseline"), "_folded", "naive_fold")
    only_folded = (F.col("naive_fold") != F.col("_flat")) & (F.col("baseline") == F.col("_plain"))
    return rows.withColumn("defended", F.when(only_folded, F.col("_flat")).otherwise(F.col("naive_fold"))).drop("_folded", "_plain", "_flat")


def lookalike(label: Column, brands: tuple[str, ...] = V.CURATED_BRANDS) -> Column:
    """The brand that a label becomes once look-alike characters are swapped back, null for brands themselves."""
    known = F.array(*[F.lit(b) for b in brands])
    plain = text.without_leetspeak(text.without_homoglyphs(label))
    return F.when((F.length(label) >= V.LOOKALIKE_LENGTH) & ~F.array_contains(known, label) & (plain != label) & F.array_contains(known, plain), plain)


#: What each attack makes of a token.
def attacks(token: Column) -> dict[str, Column]:
    letters = "".join(V.CYRILLIC)
    at = F.regexp_instr(token, F.lit(f"[{letters}]"))
    first = F.substring(token, at, F.lit(1))
    one = F.when(at == 0, token).otherwise(F.concat(F.substring(token, F.lit(1), at - 1), text.translated(first, V.CYRILLIC), F.substring(token, at + 1, F.length(token))))
    wide = {chr(k): chr(k + 0xFEE0) for k in range(ord("a"), ord("z") + 1)}
    return {"cyrillic_one": one, "cyrillic_all": text.translated(token, V.CYRILLIC), "greek_mixed": text.translated(token, V.GREEK), "fullwidth": text.translated(token, wide), "dot_diacritics": text.translated(token, V.DOTTED)}


def variants(rows: DataFrame, url: str = "url", token: str = "token") -> DataFrame:
    """rows, strategy, variant_url: the token's first place in the host rewritten by each attack; unchanged ones left out."""
    span = text.host_span(F.col(url))
    at = F.instr(F.lower(F.substring(F.col(url), span["start"] + 1, span["end"] - span["start"])), F.col(token))
    start = span["start"] + at
    made = [F.struct(F.lit(n).alias("strategy"), F.concat(F.substring(F.col(url), F.lit(1), start - 1), new, F.substring(F.col(url), start + F.length(token), F.length(url))).alias("variant_url")) for n, new in attacks(F.col(token)).items()]
    return rows.where((F.col(token) != "") & (at > 0)).select(*rows.columns, F.inline(F.array(*made))).where(F.col("variant_url") != F.col(url))
