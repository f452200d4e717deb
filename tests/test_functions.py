"""Literal expectations for text functions, spans, decisions, brands, the limiter and files."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from urlsieve.functions import suffix, text
from urlsieve.operators import brands, explain, metrics
from urlsieve.sources import files
from urlsieve.streaming import limiter


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("url", "code"), [
    ("example.com", None), ("  http://example.com/a ", None), ("example.com:443", None), ("localhost:80/x", None), ("http://", "url_empty"), ("https://x", None),
    ("ftp://example.com", "url_scheme"), ("javascript:alert(1)", "url_scheme"), ("http:/x", "url_scheme"), ("", "url_length"), ("   ", "url_length"), ("a" * 2049, "url_length"), ("a" * 2048, None),
    ("a b.com", "url_characters"), ("a​b.com", "url_characters"), ("mailto:me@x.org", "url_scheme"), ("a.b:c", None),
])
def test_check_url(spark, url, code):
    assert one(spark, text.check_url(F.col("u")), u=url) == code


@pytest.mark.parametrize(("raw", "folded"), [("ｐａｙｐａｌ．ｃｏｍ", "paypal.com"), ("pаypal", "paypal"), ("gοοgle", "google"), ("pạypạl", "pạypạl"), (None, None)])
def test_fold(spark, raw, folded):
    assert one(spark, brands.fold(F.col("u")), u=raw) == folded


@pytest.mark.parametrize(("url", "defended"), [("pаypal.com/signin", "paypal.com/signin"), ("https://www.paypal.com/signin", "www.§.com/signin"), ("docs.google.com/fοrms", "docs.§.com/forms")])
def test_defended_input(spark, url, defended):
    assert brands.model_inputs(spark.createDataFrame([(url,)], "url string")).first().defended == defended


def test_merge_spans(spark):
    rows = spark.createDataFrame([(1, 5, 8), (1, 0, 3), (1, 2, 4), (1, 8, 9)], "id int, start int, end int")
    assert sorted((r.start, r.end) for r in explain.merge_spans(rows, "id").collect()) == [(0, 4), (5, 8), (8, 9)]
    assert explain.merge_spans(rows.limit(0), "id").count() == 0


@pytest.mark.parametrize(("a", "b", "span"), [(5, 6, (5, 11)), (4, 7, (4, 12)), (7, 11, (12, 16)), (0, 4, (0, 4))])
def test_aligned_span(spark, a, b, span):
    x = text.aligned_span(F.col("t"), F.col("m"), F.lit(a), F.lit(b))
    row = one(spark, x, t="docs.google.com/x", m="docs.§.com/x")
    assert (row.start, row.end) == span


@pytest.mark.parametrize(("p", "t", "label", "trust"), [(0.5, 0.5, "phishing", 50), (0.4999999, 0.5, "legitimate", 50), (0.0, 0.5, "legitimate", 100), (1.0, 0.5, "phishing", 0), (0.93, 0.5, "phishing", 7), (0.3, 0.25, "phishing", 70)])
def test_decide(spark, p, t, label, trust):
    x = one(spark, text.decide(F.col("p"), t), p=p)
    assert (x.label, x.trust) == (label, trust)


def subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            row[j], last = (last + 1 if c == d else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_indel_ratio(spark):
    for a, b in (("fida", "fda"), ("", ""), ("", "abc"), ("paypal", "paypa1")):
        n = len(a) + len(b)
        assert one(spark, text.indel_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(2 * subsequence(a, b) / n if n else 1.0)


@pytest.mark.parametrize(("host", "want"), [("www.ck", ("ck", "www", "", "www.ck")), ("a.b.ck", ("b.ck", "a", "", "a.b.ck")), ("x.y.co.uk", ("co.uk", "y", "x", "y.co.uk")), ("localhost", ("", "localhost", "", "localhost")), ("1.2.3.4", ("", "1.2.3.4", "", "1.2.3.4")), ("co.uk", ("co.uk", "", "", "co.uk")), ("", ("", "", "", ""))])
def test_suffix(spark, host, want):
    rows = spark.createDataFrame([(host,)], "host string")
    assert tuple(suffix.attach(rows, F.col("host")).select(*suffix.NAMES).first()) == want
    assert tuple(suffix.split_by(rows, suffix.rules_table(spark)).select(*suffix.NAMES).first()) == want


def test_token_bucket_step():
    tokens, at, out = 3.0, 0.0, []
    for now in (0, 0, 0, 0, 10, 20, 1000):
        tokens, ok, wait = limiter.step(tokens, at, now, 3, 0.05)
        at = now
        out.append((ok, wait))
    assert out == [(True, None)] * 3 + [(False, 20), (False, 10), (True, None), (True, None)]
    assert tokens <= 3


def test_metrics_with_one_class(spark):
    rows = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, score double")
    t = metrics.tally(rows)
    assert metrics.roc_auc(t).first()[0] is None
    assert metrics.average_precision(t).first()[0] == 1.0
    assert metrics.rates(metrics.confusion(rows)).first().mcc is None
    assert metrics.recall_at_fpr(t).first()[0] is None


def test_roc_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), round(rng.random(), 1)) for _ in range(200)]
    pairs = [(a, b) for y, a in rows if y for z, b in rows if not z]
    want = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    assert math.isclose(metrics.roc_auc(metrics.tally(spark.createDataFrame(rows, "label int, score double"))).first()[0], want)


def test_csv_round_trip(spark, tmp_path):
    rows = [('a,"b"\nc', 1), (None, 0), (" x ", 1)]
    files.write_csv(spark.createDataFrame(rows, files.URL_SCHEMA).coalesce(1), str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c")).collect()), key=repr) == sorted(rows, key=repr)


def test_verified_rejects_other_rows(spark):
    rows = spark.range(3).withColumnRenamed("id", "bucket")
    made = files.manifest(rows, "bucket").first()
    assert files.verified(rows, "bucket", made.n, made.digest).count() == 3
    with pytest.raises(ValueError, match="differs"):
        files.verified(spark.range(1, 4).withColumnRenamed("id", "bucket"), "bucket", made.n, made.digest)
