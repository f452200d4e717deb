"""The corpus operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from urlsieve.llm import chat, common, linededup, media, minhash, mixing, passages, pieces, quality, queries, runs, simhash, tokencount, tokenids, urlfilter

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
EDGE = "don't WE'LL \"'s ''t 12ab3 ñ Ünï <|endoftext|>hi<|startoftext|> ﬁ Å ΑΣ ß İ 𝔘𝔫 你好 ๑๒ ² ½ ​\x1c\x85 á"
GOOD = "One plain sentence about rivers that run down to the sea in spring and freeze in winter."


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def corpus(spark):
    """Nulls, empty and very long texts, ties, repeated rows and a null source."""
    rng = random.Random(5)
    words = ["river", "stone", "Weg", "être", "sol", "ñu", "light", "grün", "of", "and"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_ = "\n".join(text(12) for _ in range(400))
    rows = [(1, GOOD, "a"), (2, None, "a"), (3, "", "b"), (4, EDGE, None), (5, long_, "a"), (6, long_ + " end", "a"), (7, text(60), "b"), (8, "x", "c"), (8, "x", "c"), (None, text(40), None), (9, "\n \n\t", "c"), (10, "a" * 5000, "b"), (11, GOOD, "a")]
    return docs(spark, rows + [(100 + i, text(rng.randrange(5, 90)), rng.choice("abc")) for i in range(40)])


def nothing(spark):
    return docs(spark, [(1, "x", "a")]).limit(0)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    other = duck.sql(queries.SQL[name])
    at = [other.columns.index(c) for c in df.columns]
    key = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted((key(r) for r in df.collect()), key=repr) == sorted((key([r[i] for i in at]) for r in other.fetchall()), key=repr)


# --- 1: token ids ---


@pytest.mark.parametrize("ids", [[], [7] * 3000, list(range(2500)), [2**32 - 1 if i % 50 == 0 else i % 9 for i in range(5000)], [0]])
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    blocks = tokenids.pack(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (tokenids.unpack(b"".join(blocks), starts) == ids).all()


def test_token_ids(spark):
    tok, at, want = Tokenizer.from_file(BYTE_BPE), 0, []
    rows = corpus(spark).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = tokenids.read_ids(tokenids.write_ids(corpus(spark), common.scratch(spark, "t"), BYTE_BPE, shards=3))
    assert sorted((tuple(r)[:4] for r in found.collect()), key=lambda r: r[1]) == want
    assert tokenids.read_ids(tokenids.write_ids(nothing(spark), common.scratch(spark, "t"), BYTE_BPE)).count() == 0


# --- 2: URL filters ---


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5), (None, 3)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = common.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {(r.node, r.component) for r in found.collect()} == {(x, find(x)) for x in root}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_all_forms_are_followed(spark):
    here = "http://S.test/a/b.html?q=1"
    links = {"7.html": "http://s.test/a/7.html", "?id=2": "http://s.test/a/b.html?id=2", "../x": "http://s.test/x", "../../../x/./y/..": "http://s.test/x/", "/r/../s?u=http://z": "http://s.test/s?u=http://z", "//t.test/u": "http://t.test/u", "HTTPS://v.test": "HTTPS://v.test", "w/?a=1&amp;b=2#c": "http://s.test/a/w/?a=1&b=2#c", "mailto:a@b": None, "#top": None, "": None, " /t ": "http://s.test/t", ".": "http://s.test/a/"}
    rows = spark.createDataFrame([(here, x) for x in links] + [("no scheme", "x"), ("http://bare.test", "p")], "url string, link string").withColumn("to", urlfilter.resolved(F.col("url"), F.col("link"))).collect()
    assert {r.link: r.to for r in rows if r.url == here} == links
    assert [r.to for r in rows if r.url != here] == [None, "http://bare.test/p"]
    html = """<LINK rel='x canonical' href=one.html><link href="two.html" rel=canonical><link rel=stylesheet href=no.css>
        <meta content="3; URL='three.html'" http-equiv=Refresh><meta http-equiv="refresh" content=0;url=four.html><link rel="canonical"><link href='five.html' rel="canonical">"""
    found = urlfilter.edges(spark.createDataFrame([(here, html), (None, html), ("https://x.test/", None)], "url string, html string")).collect()
    assert {r.b for r in found if r.a == here and r.b.startswith("http:")} == {f"http://s.test/a/{x}.html" for x in ("one", "two", "three", "four", "five")}
    assert {r.b for r in found if r.a == here and r.b.startswith("https:")} == {"https://s.test/a/b.html?q=1"} | {f"https://s.test/a/{x}.html" for x in ("one", "two", "three", "four", "five")}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    pages = [(k, here.replace("b.html", f"{k}.html"), html.replace("five.html", x.replace("'", ""))) for k, x in enumerate(links)] + [(90, "https://e.example.com/en/7", "<link rel=canonical href=../../a/3.html>"), (91, "http://s.test/a/five.html", None), (92, None, html)]
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    frame = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).select("page_id", "host", "path", "rule", "verdict", "alias")
    assert sorted(map(tuple, frame.collect())) == sorted(con.sql(urlfilter.SQL).fetchall())


#: Markup, and where its canonical links and refreshes lead.
MARKUP = {
    '<link rel="canonical" data-href="https://wrong.test/" href="https://right.test/">': ["https://right.test/"],
    '<!-- <link rel=canonical href="https://wrong.test/"> --><link rel=canonical href=https://right.test/>': ["https://right.test/"],
    '<link title="a > b" rel="canonical" href="https://right.test/">': ["https://right.test/"],
    "<link title='x href=\"https://wrong.test/\" ' href='https://right.test/' rel='canonical'>": ["https://right.test/"],
    '<script>var a = "<link rel=canonical href=https://wrong.test/>"</script ><STYLE>/*<link rel=canonical href=https://wrong.test/>*/</style>': [],
    "<!-- open <link rel=canonical href=https://wrong.test/>": [],
    '<link rel="uncanonical" href="https://wrong.test/"><linker rel=canonical href=https://wrong.test/>': [],
    '<link rel="canonical" href="https://right.test/" href="https://wrong.test/">': ["https://right.test/"],
    '<link\nrel = "alternate  CANONICAL"\nhref\n=\n"https://right.test/"/>': ["https://right.test/"],
    '<meta name="a" content="0;url=https://wrong.test/"><meta http-equiv=" refresh" content="0; url=https://right.test/">': ["https://right.test/"],
    '<link rel="canonical" href="">': [],
}


def test_markup_is_read_by_attribute(spark):
    pages = [(k, f"https://p{k}.test/", html) for k, html in enumerate(MARKUP)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found: dict[str, list] = {}
    for r in urlfilter.edges(frame).collect():
        found.setdefault(r.a, []).append(r.b)
    for (_, url, html), want in zip(pages, MARKUP.values(), strict=True):
        assert [x for x in found.get(url, []) if x.rstrip("/") != url.rstrip("/") and x.endswith("/")] == want, html
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    got = urlfilter.judge(frame).select("page_id", "host", "path", "rule", "verdict", "alias")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(urlfilter.SQL).fetchall())


def test_long_chains_and_hubs_of_linked_pages(spark):
    rng = random.Random(8)
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    n, links = 20_000, []
    for k in range(n):
        to = k + 1 if k % 500 else 7 if rng.random() < 0.5 else rng.randrange(n)
        to = min(to, n - 1)
        links.append(to)
        a, b = find(k), find(to)
        root[max(a, b)] = min(a, b)
    host = lambda k: "h%d.%s" % (k, "example.com/en/7" if k % 4001 == 0 else "test.com/en/x" if k % 777 == 0 else "test.edu/")
    pages = spark.createDataFrame([(k, f"https://{host(k)}", f'<link href="https://{host(to)}" rel="canonical">') for k, to in enumerate(links)], "page_id long, url string, html string")
    verdict = {}
    for k in range(n):
        own = "allow" if k % 4001 == 0 else "block" if k % 777 == 0 else None
        if own:
            verdict[find(k)] = min(own, verdict.get(find(k), own))
    for r in urlfilter.judge(pages).select("page_id", "verdict").collect():
        own = "allow" if r.page_id % 4001 == 0 else "block" if r.page_id % 777 == 0 else None
        assert r.verdict == (own or verdict.get(find(r.page_id), "allow"))


def test_verdicts_go_to_aliases(spark):
    link = '<LINK href="{}" rel=canonical>'
    rows = [
        (1, "http://a.example.com/en/3?utm_source=x", ""), (2, "https://mirror.test/p", link.format("https://a.example.com/en/3")), (3, "https://other.test/q", '<meta content="0; url=/r" http-equiv="refresh">'),
        (4, "https://other.test/r", link.format("//b.example.com/en/71")), (5, "https://other.test/s", link.format("http://c.example.com/en/2") + "<p>"), (6, "https://d.test/", link.format("https://other.test/s")),
        (7, None, None), (8, "no scheme", None), (9, "https://X.EXAMPLE.NET/de/8?q#f", ""), (10, "https://e.test/", link.format("https://d.test/")), (10, "https://e.test/", link.format("https://d.test/")),
    ]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, verdict string")
    found = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    verdicts = {k: r.verdict for k, r in found.items()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "block", 10: "block"}
    assert (found[9].host, found[9].path, found[9].rule) == ("x.example.net", "/de/8", "example.net/de/8")
    assert (found[7].host, found[8].path, found[8].rule) == ("", "", None)
    # an allowed alias beats a blocked one
    both = spark.createDataFrame([("https://d.test/", "https://b.example.com/en/7")], "a string, b string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(pages, more_edges=both).collect()}[10] == "allow"
    assert urlfilter.judge(pages).count() == len(rows) and urlfilter.judge(pages.limit(0)).count() == 0


# --- 3: SentencePiece ---


def segmentations(lattice, text):
    """All segmentations of a text and their log-probabilities; a character that is no piece is its bytes' pieces."""
    norm, out = lattice.normal(text), []

    def go(i, ids, lp):
        if i == len(norm):
            out.append((tuple(ids), lp))
        for j in range(i + 1, len(norm) + 1):
            if norm[i:j] in lattice.id_of:
                k = lattice.id_of[norm[i:j]]
                go(j, [*ids, k], lp + lattice.lp[k])
        if i < len(norm) and norm[i] not in lattice.id_of:
            run = [lattice.byte[b] for b in norm[i].encode()]
            go(i + 1, [*ids, *run], lp + len(run) * lattice.fallback)

    go(0, [], 0.0)
    z = math.log(sum(math.exp(lp) for _, lp in out))
    return {ids: lp - z for ids, lp in out}


def test_samples_follow_the_lattice():
    lattice = pieces.Lattices(PIECES)
    want = segmentations(lattice, "to the sea")
    n, k = 3000, 3
    found = lattice.sample(["to the sea"] * n, pieces.row_keys(list(range(n)), 1), k)
    first = Counter(tuple(x[0][0].tolist()) for x in found)
    assert max(abs(first[ids] / n - math.exp(lp)) for ids, lp in want.items()) < 0.04
    hits = Counter()
    for rows in found:
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(set(ids)) == k and all(abs(r[1] - want[i]) < 1e-4 for r, i in zip(rows, ids, strict=True))
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        for r, i in zip(rows, ids, strict=True):
            hits[i] += math.exp(-r[3])
    # weighting by inclusion gives each segmentation a mean of one
    top = [ids for ids, lp in want.items() if lp > math.log(0.03)]
    assert all(abs(hits[ids] / n - 1) < 0.2 for ids in top)


def test_samples_of_edge_cases(spark):
    rows = pieces.sample(corpus(spark), PIECES).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {(r.doc_id, r.text or "") for r in corpus(spark).collect()}
    back = {(r.doc_id, sp.decode(list(r.ids))) for r in rows}
    assert back == {(i, t.replace("▁", " ")) for i, t in texts}
    empty = [r for r in rows if r.doc_id == 3]
    assert len(empty) == 1 and list(empty[0].ids) == [] and empty[0].log_inclusion == 0
    assert sorted(map(str, rows)) == sorted(map(str, pieces.sample(corpus(spark).repartition(7), PIECES).collect()))
    assert pieces.sample(nothing(spark), PIECES).count() == 0
    both = pieces.decode(pieces.encode(docs(spark, [(1, EDGE, "a"), (2, None, "a")]), PIECES), PIECES)
    assert [r.text for r in both.orderBy("doc_id").collect()] == [EDGE, None]
    assert pieces.decode(pieces.encode(nothing(spark), PIECES), PIECES).count() == 0
    again = pieces.encode(docs(spark, [(1, GOOD, "a"), (1, GOOD, "a"), (2, "", "b")]).withColumn("ids", F.lit("old")), PIECES).collect()
    assert [list(r.ids) for r in again] == [sp.encode(GOOD), sp.encode(GOOD), []]


@pytest.mark.parametrize("text", ["a", "", "so\n𝔘, on.", "aᚠb Я", "no no  no"])
def test_samples_are_drawn_without_replacement(text):
    lattice, n, k = pieces.lattices(PIECES), 4000, 3
    want = segmentations(lattice, text)
    found = [[tuple(r[0].tolist()) for r in x] for x in lattice.sample([text] * n, pieces.row_keys(list(range(n)), 2), k)]
    assert all(len(x) == len(set(x)) == min(k, len(want)) and set(x) <= set(want) for x in found)
    pairs, singles = Counter(tuple(x[:2]) for x in found), Counter(x[0] for x in found)
    assert all(abs(singles[a] / n - math.exp(lp)) < 0.04 for a, lp in want.items())
    for a, b in (x for x in pairs if len(x) == 2):
        p = math.exp(want[a]) * math.exp(want[b]) / (1 - math.exp(want[a]))
        assert abs(pairs[a, b] / n - p) < 0.04
    if len(want) <= k:  # all are given, whatever their noise
        assert all(r[3] == 0 for x in lattice.sample([text], pieces.row_keys([1], 2), k) for r in x)


def test_rare_alternatives_are_drawn_too():
    """Where a likely piece leaves the others under 2^-53 of the probability, further samples still come."""
    lattice = pieces.Lattices(PIECES, theta=12.0)
    # no piece holds a rune, so a text of runes alone has one segmentation
    for text, n in (("information", 4), ("the international organisation", 4), ("ᚠ" * 70, 1), ("ᚠ" * 70 + " information", 4), ("x" * 900 + "ᚠy", 4)):
        found = lattice.sample([text], pieces.row_keys([5], 1), 4)[0]
        assert len(found) == len({tuple(r[0].tolist()) for r in found}) == n
        assert all(lattice.sp.decode(r[0].tolist()) == text for r in found)


def test_samples_do_not_depend_on_what_is_remembered(monkeypatch):
    rng, other = random.Random(3), pieces.Lattices(PIECES)
    word = lambda: "".join(rng.choice("abcdé\n.") for _ in range(rng.randrange(1, 9)))
    batches = [[" ".join(word() for _ in range(9)) for _ in range(3)] for _ in range(12)]
    keys = [pieces.row_keys([k, k + 1, None], 1) for k in range(12)]
    want = [other.sample(t, key) for t, key in zip(batches, keys, strict=True)]
    monkeypatch.setattr(pieces, "ARCS", 300)
    monkeypatch.setattr(pieces, "KEEP", 80)
    monkeypatch.setattr(pieces, "SLICE", 20)
    lattice = pieces.Lattices(PIECES)
    found = [lattice.sample(t, key) for t, key in zip(batches, keys, strict=True)]
    assert lattice.kept
    assert [[[(x[0].tolist(), *x[1:]) for x in r] for r in b] for b in found] == [[[(x[0].tolist(), *x[1:]) for x in r] for r in b] for b in want]


def test_runs_of_equal_hashes_get_numbers_of_their_own(monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    found, plain = runs.Runs(), runs.mix
    # hashes of three bits until others are taken
    monkeypatch.setattr(runs, "mix", lambda x: plain(x) if found.salt > 1 else plain(x) & np.uint64(7 << 61))
    numbers: dict[str, int] = {}
    for part in (["b", "a"], words[:150], words, ["ccccc"], words):
        size = np.array([len(w) for w in part])
        got, fresh = found.number(runs.code_points("".join(part)), np.cumsum(size) - size, size)
        assert {part[i] for i in fresh} == set(part) - set(numbers)
        assert all(numbers.setdefault(w, n) == n for w, n in zip(part, got.tolist(), strict=True))
    assert found.salt > 1 and sorted(numbers.values()) == list(range(len(found)))
    found.cut(2)
    assert len(found) == 2 and found.number(runs.code_points("ba"), np.array([0, 1]), np.array([1, 1]))[0].tolist() == [numbers["b"], numbers["a"]]


# --- 4: quality rules ---


def test_verdicts_do_not_depend_on_order(spark):
    rows = corpus(spark)
    order = quality.ordered(rows)
    assert set(order) == set(quality.RULES)
    want = {r.doc_id: not any(rule.rejects(quality.Text(r.text)) for rule in quality.RULES) for r in rows.collect()}
    found = quality.cascade(rows.withColumn("quality", F.lit(1)))
    assert {r.doc_id: r.quality.kept for r in found.collect()} == want
    assert not want[2] and not want[3] and want[1]
    assert quality.keep_good(rows).columns == rows.columns
    assert quality.keep_good(nothing(spark)).count() == 0


def test_rules_that_reject_more_for_their_cost_come_first(spark):
    slow = quality.Rule("slow", lambda t: t.n_repeat_words < 0)
    fast = quality.Rule("fast", lambda t: not t.text)
    dear = quality.Rule("dear", lambda t: not t.text, 1e9)
    assert [r.name for r in quality.ordered(corpus(spark), (slow, dear, fast))] == ["fast", "slow", "dear"]
    # what one rule has measured costs the next one nothing, and it is judged by what is left to it
    a, b, c = (quality.Rule(n, f) for n, f in (("a", lambda t: t.n_words < 5), ("b", lambda t: t.n_words < 4), ("c", lambda t: t.n_symbols > 3)))
    texts = ["x y z " * k + "%" * (k % 5) for k in range(1, 40)]
    found = quality.estimated(texts, (c, b, a))
    assert [x[0] for x in found if x[0] != "c"] == ["a", "b"] and found == quality.estimated(texts, (c, b, a))
    assert {x[0]: x[1] for x in found}["b"] == 0 and {x[0]: x[2] for x in found}["b"] == 100.0


def test_samples_come_from_the_whole_table(spark):
    rows = spark.range(0, 4000, 1, 40).select("id", F.col("id").cast("string").alias("text"))
    found = [int(x) for x in quality.sampled(rows, rows=64)]
    assert len(found) == 64 and {x // 500 for x in found} == set(range(8)) and found == [int(x) for x in quality.sampled(rows, rows=64)]
    assert len(quality.sampled(rows, rows=64, chars=0)) == 32 and quality.sampled(nothing(spark)) == []


@pytest.mark.parametrize("text", ["a b c d e a b c d e", "a b c d e f", "a a a a a a a", "", "x y z a b c d e q a b c d e w a b c d e"])
def test_repeated_windows(text):
    w = text.split()
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    assert quality.Text(text).n_repeat_words == len({p for i, x in enumerate(win) if win.count(x) > 1 for p in range(i, i + 5)})


# --- 5: SimHash ---


def brute_prints(text, size):
    w = re.findall(common.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    rows = corpus(spark).collect()
    fp = [brute_prints(r.text, 4) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(find(i)), r.doc_id) if x is not None]
        least[find(i)] = min(ids) if ids else None
    want = sorted(((r.doc_id, f, least[find(i)]) for i, (r, f) in enumerate(zip(rows, fp, strict=True))), key=repr)
    found = simhash.near_duplicates(corpus(spark))
    assert sorted(((r.doc_id, r.fp & 2**64 - 1, r.component_id) for r in found.collect()), key=repr) == want
    kept = simhash.keep_one(corpus(spark))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(set(least.values()), key=repr)
    assert simhash.near_duplicates(nothing(spark)).count() == 0


def test_links_within_radius_are_found(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), d)) for b in base for d in (1, 2, 3, 4, 5)]
    fps = list(dict.fromkeys([*base, *near]))
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    found = common.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    group = {r.node & 2**64 - 1: r.component for r in found}
    assert all(group[a] == group[b] for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4)
    far = [(a, b) for i, a in enumerate(base) for b in base[:i]]
    assert all(group[a] != group[b] for a, b in far)


def test_null_and_repeated_ids_cost_no_row(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(60)) for _ in range(8)]
    rows = [(None, t, "a") for t in texts[:3]] + [(7, t, "a") for t in texts[3:6]] + [(8, texts[6], "a"), (None, texts[6], "a"), (9, texts[7], "a"), (9, texts[7], "b")]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted({r[:2] for r in rows} - {(None, texts[6])}, key=repr)


def test_near_copies_go(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for base in range(30):
        text = [rng.choice(words) for _ in range(rng.randrange(30, 200))]
        rows.append((base, " ".join(text), "a"))
        for k in range(6):
            near = list(text)
            for _ in range(rng.randrange(1, 5)):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((100 + 10 * base + k, " ".join(near), "a"))
    rows += [(None, None, "a"), (900, "", "a"), (901, "x", "a"), (902, "X", "a"), (None, "alone " * 9, "a")]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t, _ in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    best = {}
    for i, (doc, _, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0)), (doc is None, doc or 0))
    frame = docs(spark, rows)
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()]
    assert len(best) < len(rows) - 60
    assert sorted(kept, key=repr) == sorted((None if none else i for none, i in best.values()), key=repr)
    assert minhash.keep_one(nothing(spark)).count() == 0


def test_simhash_finds_candidates_that_no_band_has(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words), "a"), (2, " ".join([*words, "more"]), "a"), (3, " ".join(reversed(words)), "a")]
    monkeypatch.setattr(minhash, "BANDS", 0)
    fp = [brute_prints(t, 5) for _, t, _ in rows]
    assert (fp[0] ^ fp[1]).bit_count() <= 4 < (fp[0] ^ fp[2]).bit_count()
    assert sorted(r.doc_id for r in minhash.keep_one(docs(spark, rows), 5, 0.8).collect()) == [1, 3]


def test_a_round_of_simhash_links_is_small_beside_the_texts(spark, monkeypatch):
    made, links = [], minhash.links
    monkeypatch.setattr(minhash, "links", lambda fps, **k: made.append(k.get("rounds", simhash.ROUNDS)) or links(fps, **k))
    assert minhash.keep_one(docs(spark, [(1, "a b c d e f", "a"), (2, "A b c d e f", "a"), (3, "g", "a")])).count() == 2
    # bytes that a fingerprint's variants take in two rounds at once, where texts have about 2.5 kB
    assert [2 * 10 * len(simhash.masks(simhash.RADIUS // 2)) / k < 5_000 for k in made] == [True]


def test_unlike_texts_of_one_band_do_not_meet_in_pairs(spark):
    shared, n = [100 * k for k in range(12)], 60
    sets = {i: [*shared[: 6 + i % 6], *range(10_000 * (i + 1), 10_000 * (i + 1) + 8)] for i in range(n)}
    sets[n] = [*sets[5][:-1], 7]
    frame = spark.createDataFrame([(i, x) for i, x in sets.items()], "node long, shingles array<long>")
    named = frame.select("node", F.col("node").alias("group"))
    assert [tuple(r) for r in minhash._across(named, frame, 0.8).collect()] == [(n, 5)]


# --- 6: chat ---


def legal(roles, done=True):
    if done and roles and roles[-1] != "assistant":
        return False
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles))


def cheapest(roles, merge=1.0, insert=1.5, relabel=2.0, unknown=0.25):
    """Least cost over all labels, merges and insertions of up to three empty turns anywhere, by exhaustion; only the rule of legal sequences is known here."""
    every, best = ("system", "user", "assistant"), math.inf

    def go(i, seq, cost, gap):
        nonlocal best
        if cost >= best:
            return
        if i == len(roles) and legal(seq):
            best = cost
        if gap < 3:
            for x in every:
                if legal([*seq, x], False) and not ("system" in seq and x == "system"):
                    go(i, [*seq, x], cost + insert, gap + 1)
        if i < len(roles):
            for x in every:
                price = cost + (0 if roles[i] == x else relabel if roles[i] in every else unknown)
                if legal([*seq, x], False):
                    go(i + 1, [*seq, x], price, 0)
                if i and gap == 0 and seq[-1] == x:
                    go(i + 1, seq, price + merge, 0)

    go(0, [], 0.0, 0)
    return best


def rebuilt(part):
    """The rendering and the cost of a conversation that its rows' actions give, put together anew."""
    turns, cost = [], 0.0
    for r in part:
        empty = r.inserted.split(",") if r.inserted else []
        turns += [[x, ""] for x in empty]
        known = (r.role or "").strip().lower()
        cost += 1.5 * len(empty) + (0.25 if known not in ("system", "user", "assistant") else 0.0 if known == r.new_role else 2.0)
        if "merge" in r.action:
            assert turns[-1][0] == r.new_role and not empty
            turns[-1][1] += "\n" + r.text
            cost += 1.0
        else:
            turns.append([r.new_role, r.text])
        assert ("relabel" in r.action) == (known != r.new_role)
    for x in {"system": ["user", "assistant"], "user": ["assistant"]}.get(turns[-1][0], []):
        turns.append([x, ""])
        cost += 1.5
    assert legal([x for x, _ in turns])
    return "".join(f"<|im_start|>{x}\n{t}<|im_end|>\n" for x, t in turns), cost


def repaired(turns, rows, **kw):
    """The conversations of a repair, rows in order, each with the text it came from."""
    h = {t: n for t, n in ((r.t, r.h) for r in turns.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect())}
    want = sorted({(r[0], r[1], r[2], r[3] or "") for r in rows}, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", h[r[3]]))
    by: dict = {}
    for r in want:
        by.setdefault(r[0], []).append(r)
    found: dict = {}
    for r in chat.repair(turns, **kw).collect():
        found.setdefault(r.conv_id, []).append(r)
    out = {}
    for conv, part in by.items():
        left, line = found.pop(conv), []
        for _, turn, role, text in part:
            k = next(k for k, r in enumerate(left) if (r.turn, r.role) == (turn, role) and "\n" + text in r.rendered)
            r = left.pop(k)
            line.append(Row(**r.asDict(), text=text))
        assert not left
        out[conv] = line
    assert not found
    return out


@pytest.mark.parametrize(("block", "many"), [(1, 4096), (3, 2), (256, 4096), (256, 3)])
def test_repairs_are_cheapest_and_legal(spark, block, many):
    rng = random.Random(11)
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "Tool", " USER", None]), rng.choice(["hi", "", None, "line\nbreak"]), "extra"))
    rows += [(None, 0, "user", "a", "x"), (7, None, "assistant", "first", "x"), rows[0], rows[0]]
    rows += [(50, 3, role, text, "x") for role in ("user", None, "assistant") for text in ("p", "q", "rr")] + [(51, None, "user", t, "x") for t in "abcdefg"]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string")
    for part in repaired(turns, rows, block=block, many=many).values():
        text, cost = rebuilt(part)
        assert "".join(r.rendered for r in part) == text
        assert all(r.cost == pytest.approx(cost) for r in part)
        if len(part) <= 5:
            assert cost == pytest.approx(cheapest([(r.role or "").strip().lower() for r in part]))
    assert chat.repair(turns.limit(0)).count() == 0


def test_a_conversation_of_one_turn_number_is_cut(spark):
    n = 100_000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    copies = turns.where("text = 't5'").crossJoin(spark.range(50_000)).select("conv_id", "turn", "role", "text")
    found = chat.repair(turns.union(copies)).select("action", "new_role", "cost", F.length("rendered").alias("n")).collect()
    # the last turn is relabelled, which costs less than a merge and an empty turn
    assert Counter((r.action, r.new_role) for r in found) == {("keep", "user"): 1, ("merge", "user"): n - 2, ("relabel", "assistant"): 1}
    assert {r.cost for r in found} == {n - 2 + 2.0}
    assert sum(r.n for r in found) == sum(len(f"\nt{k}") for k in range(n)) - 2 + len("<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")


# --- 7: media ---


def test_media_round_trip(spark):
    rng = random.Random(4)
    payloads = [bytes(rng.randrange(256) for _ in range(64 * k)) for k in (1, 2, 15, 16, 17, 100)] + [b"\0" * 64, b"\xff" * 1024, bytes([0, 255]) * 32]
    for p, (movie, frames) in zip(payloads, media.decode_movies(media.encode_payloads(payloads)), strict=True):
        assert b"".join(f.tobytes() for f in frames)[: movie.payload] == p
    assert media.to_media(nothing(spark)).count() == 0 and media.digests(media.to_media(nothing(spark))).count() == 0


def avi_frames(data):
    """Frames of an AVI file as any reader finds them: by walking its chunks, each entry of the index checked on the way."""
    assert data[:4] == b"RIFF" and struct.unpack("<I", data[4:8])[0] == len(data) - 8 and data[8:12] == b"AVI "
    at, top = 12, {}
    while at < len(data):
        n = struct.unpack("<I", data[at + 4 : at + 8])[0]
        top[data[at + 8 : at + 12] if data[at : at + 4] == b"LIST" else data[at : at + 4]] = at, n
        at += 8 + n + n % 2
    start, size = top[b"movi"]
    index, n = top[b"idx1"]
    entries = [struct.unpack("<4sIII", data[index + 8 + k : index + 24 + k]) for k in range(0, n, 16)]
    frames, at = [], start + 12
    while at < start + 8 + size:
        n = struct.unpack("<I", data[at + 4 : at + 8])[0]
        assert entries[len(frames)] == (data[at : at + 4], 0x10, at - start - 8, n) and data[at : at + 4] == b"00dc"
        frames.append(data[at + 8 : at + 8 + n])
        at += 8 + n + n % 2
    assert len(frames) == len(entries)
    return frames


def test_long_texts_are_counted_by_stretches():
    rng = random.Random(7)
    words = ["naïve", "it's", "  two", "12,345", "漢字", "a\n\nb", "<|endoftext|>", "e\u0301", "ΟΔΟΣ", "\u0301x", "İ", "😀"]
    texts = [" ".join(rng.choice(words) for _ in range(3000)), "short", "", "y" * 5000]
    library = Tokenizer.from_file(WORD_BPE)
    # the library puts its own begin and end tokens around a text unless told not to
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    for size in (50, 700):
        assert tokencount.by_stretches(tokencount.counter(WORD_BPE), texts, size).tolist() == want


def test_media_digests_of_files_that_cannot_be_read(spark):
    (good,) = media.encode_payloads([b"x" * 64])
    rows = spark.createDataFrame([(1, 64, good), (2, 64, None), (3, 64, good[:40]), (4, 64, b""), (1, 64, good)], "doc_id long, n_bytes long, media binary").coalesce(1)
    found = [(r.doc_id, r.payload_bytes, r.feature[:6]) for r in media.digests(rows).collect()]
    assert [f for f in found if f[0] == 1] == [(1, 64, "frames")] * 2
    assert [f for f in found if f[0] != 1] == [(k, None, "error:") for k in (2, 3, 4)]


def test_long_texts_are_encoded_by_stretches(monkeypatch):
    rng = random.Random(6)
    words = ["naïve", "it's", "  two", "12,345", "漢字", "a\n\nb", "<|endoftext|>", "e\u0301", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(4000)), "short", "", "y" * 9000]
    encoder = tokenids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = encoder(texts)
    monkeypatch.setattr(tokenids, "STRETCH", 500)
    monkeypatch.setattr(tokenids, "stretches", lambda t: runs.stretches(t, 500))
    cut = encoder(texts)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_media_digests_against_other_readers(spark):
    rows = media.to_media(corpus(spark).where("doc_id IS NULL OR doc_id < 50")).collect()
    texts = {}
    for r in corpus(spark).collect():
        texts.setdefault(r.doc_id, (r.text or "").encode())
    found = {r.doc_id: r for r in media.digests(media.to_media(corpus(spark))).collect()}
    image = spark.sparkContext._jvm.javax.imageio.ImageIO
    for r in rows:
        raw, d = texts[r.doc_id], found[r.doc_id]
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (d.n_bytes, d.payload_bytes, d.payload_sha256, d.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (d.media_bytes, d.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        frames, back = avi_frames(bytes(r.media)), b""
        assert d.feature.startswith(f"frames={len(frames)};")
        if len(frames) > 4:
            continue
        for f in frames:  # Java's decoder: the value of each block's first pixel
            shown = image.read(spark.sparkContext._jvm.java.io.ByteArrayInputStream(f)).getRaster()
            wide, high = shown.getWidth(), shown.getHeight()
            pixels = np.array(list(shown.getSamples(0, 0, wide, high, 0, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.int, wide * high)))).reshape(high, wide)
            assert (pixels == np.repeat(np.repeat(pixels[::8, ::8], 8, 0), 8, 1)).all()
            back += pixels[::8, ::8].astype(np.uint8).tobytes()
        assert back[: len(payload)] == payload and not any(back[len(payload) :])


def test_large_texts_go_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(media, "LARGEST", 10_000)
    with pytest.raises(ValueError, match="too large"):
        media.encode_payloads([b"a" * 64 * 500])


def test_shots_and_damaged_files(spark):
    dark, light = np.full(1024, 10, np.uint8), np.full(1024, 200, np.uint8)
    assert media.shots([dark] * 5 + [light] * 4) == [(0, 4), (5, 8)]
    assert media.shots([]) == []
    file = media.encode_payloads([dark.tobytes() * 5 + light.tobytes() * 4])[0]
    no_index = file[: file.rindex(b"idx1")]
    rows = spark.createDataFrame([(1, bytearray(file)), (2, bytearray(no_index)), (3, bytearray(b"junk")), (4, None), (5, bytearray(file[:3000]))], "doc_id long, media binary")
    found = media.clips(rows).collect()
    times = lambda k: [(r.start_ms, r.end_ms) for r in found if r.doc_id == k]
    assert times(1) == times(2) == [(0, 200), (200, 360)]
    assert all(r.error for r in found if r.doc_id in (3, 4))


def java_jpeg(spark, pixels):
    """A JPEG image of these pixels and what Java's decoder reads from it, as (bytes, RGB or grey)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = jvm.java.awt.image.BufferedImage
    high, wide = pixels.shape[:2]
    image = kind(wide, high, kind.TYPE_BYTE_GRAY if pixels.ndim == 2 else kind.TYPE_INT_RGB)
    flat = gateway.new_array(gateway.jvm.int, pixels.size)
    for k, v in enumerate(pixels.ravel().tolist()):
        flat[k] = v
    image.getRaster().setPixels(0, 0, wide, high, flat)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(out.toByteArray())).getRaster()
    bands = [list(back.getSamples(0, 0, wide, high, b, gateway.new_array(gateway.jvm.int, wide * high))) for b in range(back.getNumBands())]
    return data, np.array(bands).T.reshape(pixels.shape)


def test_frames_with_detail_colour_and_restarts(spark):
    y, x = np.mgrid[0:20, 0:28]
    grey = (128 + 60 * np.sin(x / 3) + 50 * np.cos(y / 2)).astype(int)
    data, want = java_jpeg(spark, grey)
    assert np.abs(media.decode_image(data) - want.astype(int)).max() <= 1
    colour = np.stack([x * 8, y * 10, 200 - x * 4], axis=2).astype(int)
    shown, want = java_jpeg(spark, colour)
    assert np.abs(media.decode_image(shown) - want.astype(int)).mean() < 6 and media.decode_image(shown).shape == (20, 28, 3)
    # two images of one block each as one image with a restart between them
    a, b = (java_jpeg(spark, grey[:8, k : k + 8]) for k in (0, 8))
    spot, size = a[0].index(b"\xff\xda"), a[0].index(b"\xff\xc0") + 5
    body = [d[d.index(b"\xff\xda") + 10 : -2] for d, _ in (a, b)]
    head = a[0][:size] + b"\0\x10\0\x08" + a[0][size + 4 : spot] + b"\xff\xdd\0\x04\0\x01" + a[0][spot : spot + 10]
    both = head + body[0] + b"\xff\xd0" + body[1] + b"\xff\xd9"
    assert np.abs(media.decode_image(both).astype(int) - np.concatenate([a[1], b[1]])).max() <= 1
    dark = java_jpeg(spark, np.stack([x, y, x], axis=2).astype(int))[0]
    film = media.write_avi([shown] * 3 + [dark] * 2, 3, 0)
    flat = media.encode_frames([bytes([200]) * 64])[0]
    mixed = media.write_avi([flat, flat, data, both], 3, 0)
    broken = media.write_avi([shown[: len(shown) * 2 // 3]], 3, 0)
    rows = spark.createDataFrame([(1, bytearray(film)), (2, bytearray(mixed)), (3, bytearray(broken))], "doc_id long, media binary")
    found = media.clips(rows).collect()
    assert [(r.start_ms, r.end_ms, r.error) for r in found if r.doc_id == 1] == [(0, 120, None), (120, 200, None)]
    assert all(r.error is None for r in found if r.doc_id == 2) and all(r.error for r in found if r.doc_id == 3)
    # frames that leave the tables out have the standard's
    assert all(len(t) == 16 + sum(t[:16]) for t in media.STANDARD.values())
    cut, at = b"", 0
    while (k := shown.find(b"\xff\xc4", at)) >= 0:
        cut, at = cut + shown[at:k], k + 2 + int.from_bytes(shown[k + 2 : k + 4], "big")
    assert (media.decode_image(cut + shown[at:]) == media.decode_image(shown)).all()


# --- 8: mixing ---


def test_mix_meets_targets(spark):
    rows = mixing.mix(corpus(spark)).collect()
    assert len(rows) == corpus(spark).count()
    by: dict = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    assert sum(p[0].target for p in by.values()) == pytest.approx(1.5 * total)
    for part in by.values():
        assert part[0].target <= 2 * part[0].source_size + 1e-6
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(r.size for r in part)
    again = mixing.mix(corpus(spark).repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    docs_ = mixing.mixed(corpus(spark))
    assert docs_.columns == corpus(spark).columns and docs_.count() == sum(r.times for r in rows)
    assert mixing.mix(nothing(spark)).count() == 0


# --- 9: line dedup ---


def test_line_dedup(spark):
    passage = "first line of it\nsecond line of it\nthird line of it"
    rows = [(1, f"own a\n{passage}\nown b", "a"), (2, f"own c\n{passage}", "a"), (3, None, "a"), (4, "", "a"), (5, passage, "a"), (6, "short", "a"), (7, "short", "a"), (8, "r\nr\nr\nr\nr", "a"), (9, "\n\n\n\nx\n\n\n\n", "a"), (6, "short", "a")]
    frame = docs(spark, rows).withColumn("n_removed", F.lit(9))
    found = {r.doc_id: r for r in linededup.dedup_lines(frame).collect()}
    assert found[1].text == rows[0][1] and found[2].text == "own c" and found[5].text == ""
    assert list(found[2].removed) == [1, 2, 3]
    assert found[3].text is None and found[3].n_lines == 0 and found[4].text == ""
    assert found[6].text == "short" and found[7].text == ""
    assert found[8].text == "r\nr\nr" and found[9].text == rows[8][1]
    assert linededup.dedup_lines(frame).count() == len(rows) and linededup.dedup_lines(nothing(spark)).count() == 0


def test_line_dedup_has_one_plan_for_all_sizes(spark):
    plain = "a b\nc d\ne f"
    frame = spark.createDataFrame([(k, plain) for k in range(3)], "doc_id long, text string")
    found = linededup.dedup_lines(frame)
    assert [(r.doc_id, r.text) for r in found.orderBy("doc_id").collect()] == [(0, plain), (1, ""), (2, "")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # a few gone lines would be broadcast, many not


def test_passages_inside_lines_go(spark):
    rng = random.Random(6)
    some = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    shared, long_, short, line = some(51), some(300), some(50), some(60)
    own = [some(40) for _ in range(12)]
    rows = [
        (1, [*own[0], *shared, *own[1]]), (2, [*own[2], *shared, *own[3]]), (3, [*long_, *own[4]]), (4, [*own[5], *long_[20:290]]), (5, [*short, *own[6]]), (6, [*own[7], *short]),
        (7, line), (8, line), (9, [*own[8], *own[9], *own[8], *own[9]]), (10, ["r"] * 120), (None, [*own[10], *shared]), (None, [*own[11], *line]),
    ]
    frame = docs(spark, [(i, " ".join(w), "a") for i, w in rows] + [(11, None, "a"), (12, "", "a"), (2, " ".join(rows[1][1]).replace(" ", "\n", 3), "a")])
    found = [(r.doc_id, None if r.text is None else r.text.split()) for r in passages.cut_passages(frame).collect()]
    by = {i: w for i, w in found if i is not None and i != 2}
    assert by[1] == [*own[0], *own[1]] and by[3] == rows[2][1] and by[4] == own[5] and by[5] == rows[4][1] and by[6] == rows[5][1]
    assert by[7] == [] and by[8] == [] and by[9] == [*own[8], *own[9]] and by[10] == ["r"] * 51
    assert by[11] is None and by[12] == []
    assert sorted(len(w) for i, w in found if i is None) == [91, 100]
    assert len(found) == len(rows) + 3
    assert passages.cut_passages(nothing(spark)).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.line_dedup(spark, frame, "").collect()}
    assert 7 not in kept and 8 not in kept and {1, 3, 4, 5, 6} <= kept


# --- 10: token counts ---


def test_token_counts(spark):
    tok = Tokenizer.from_file(WORD_BPE)
    rows = corpus(spark).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(tok.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in rows]
    assert sorted(map(tuple, tokencount.count_tokens(corpus(spark), WORD_BPE).collect()), key=repr) == sorted(want, key=repr)
    assert tokencount.count_tokens(nothing(spark), WORD_BPE).count() == 0


def test_chunk_maps_compose():
    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 6, 5000).astype(np.uint8)
    kinds[:300] = tokencount.LETTER
    state, want = tokencount.OUT, []
    for k in kinds:
        want.append(bool(tokencount.STARTS[state, k]))
        state = tokencount.NEXT[state, k]
    assert tokencount.word_starts(kinds).tolist() == want


def test_long_words_are_counted_in_chunks():
    count, tok, rng = tokencount.counter(WORD_BPE), Tokenizer.from_file(WORD_BPE), random.Random(4)
    some = lambda n, of="abcdefghinorst": "".join(rng.choice(of) for _ in range(n))
    texts = [some(n) for n in (255, 256, 257, 512, 513, 5000)] + ["a" * 3000, "ab" * 2000, "é" * 700, "!" * 2000, "abc" * 400 + " x " + "hello" * 300, "_-" * 600, "𝔘" * 300, "abcde" * 333]
    texts.append("".join(rng.choice(("the", "ing", "ation", "er", "st", "of", "wind")) for _ in range(300_000)))
    assert len(texts[-1]) > 890_000
    assert count(texts).tolist() == [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="plain BPE"):
        tokencount.Counter(BYTE_BPE)


@pytest.mark.parametrize("seed", range(3))
def test_counts_of_random_words(seed):
    count, tok, rng = tokencount.counter(WORD_BPE), Tokenizer.from_file(WORD_BPE), random.Random(seed)
    texts = ["".join(rng.choice("abcdefghinorst'  .!é0") for _ in range(rng.randrange(60))) for _ in range(300)]
    assert count(texts).tolist() == [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


# --- what all operators share ---


NAMES = ("_id", "_th", "_GONE", "_n", "_g", "_cut", "_whole", "_c", "_of", "_copy", "_keep", "_hash", "_row", "_node", "_component", "from_alias", "_carried", "_quality", "n_removed", "cut", "node", "part", "a.b", "x`y")


def test_columns_may_have_any_names(spark):
    odd = corpus(spark).select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in NAMES], F.create_map(F.lit("k"), "doc_id").alias("m"))
    own = lambda r: all(r[n] == f"{n} {'null' if r.doc_id is None else r.doc_id}" for n in NAMES)
    plain = corpus(spark)
    for step in (quality.keep_good, passages.cut_passages, mixing.mixed, simhash.keep_one, minhash.keep_one, *[lambda d, f=f: f(spark, d, "") for _, f in corpus_pipeline.STAGES[:4]]):
        rows = step(odd).collect()
        assert rows and all(map(own, rows)) and rows[0].__fields__ == odd.columns
        assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((r.doc_id, r.text) for r in step(plain).collect()), key=repr)
    lines = linededup.dedup_lines(odd.drop("n_removed"), names=("k1", "k2", "k3"))
    assert lines.columns[-3:] == ["k1", "k2", "k3"] and lines.count() == plain.count()
    pages = odd.select(F.lit("https://e.test/").alias("url"), F.lit("").alias("html"), *[F.col(common.quoted(n)) for n in NAMES])
    assert urlfilter.judge(pages).count() == plain.count()


def test_intermediate_tables_go(spark, tmp_path):
    import glob

    left = lambda: set(glob.glob(common.shared_dir(spark).removeprefix("file:") + "/urlsieve/*"))
    before = left()
    with common.scope(spark) as keep:
        a = common.written(spark.range(3), "a")
        with common.scope(spark) as inner:
            common.written(spark.range(4), "b")
            c = inner(common.written(a.where("id > 0"), "c"))
        d = keep(common.written(c.where("id > 1"), "d"))
    assert d.count() == 1 and len(left() - before) == 1
    simhash.near_duplicates(corpus(spark)).count()
    assert {p.rpartition("/")[2].partition("-")[0] for p in left() - before} == {"d", "prints", "named"}
    minhash.groups(corpus(spark)).count()
    assert len(left() - before) == 4


def test_the_other_queries_do_without_these(monkeypatch):
    import sys

    import __spark_entry__ as entry

    everything = set(entry.queries())
    for gone in ("tokenizers", "urlsieve.llm.queries", "corpus_pipeline"):
        with monkeypatch.context() as m:
            for name in [n for n in sys.modules if n.startswith("urlsieve.llm") or n == "corpus_pipeline"]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, gone, None)
            left = set(entry.queries())
            assert left and not any(re.match(r"op\d|pipeline", n) for n in left) and set(entry.oracle_sql()) <= left
    assert {f"op{k}" for k in range(1, 11)} | {"pipeline"} <= {n.partition("_")[0] for n in everything}


# --- the pipeline ---


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    words = ["river", "stone", "weg", "être", "sol", "light", "grün", "of", "and", "winter", "house", "bird", "field", "open", "slow"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = {i: "\n".join(text(25) for _ in range(4)) for i in range(20)}
    rows = [(i, t, "ab"[i % 2]) for i, t in texts.items()]
    rows += [(50, None, "a"), (51, "", "b"), (52, "%%% " * 40, "a"), (60, texts[3], "a"), (61, texts[4] + " end", "b"), (62, texts[4].replace("\n", " ", 1), "b")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    frame, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = common.written(stage(spark, frame, str(tmp_path)), "stage")
        seen[name] = frame
    kept = {n: {r.doc_id for r in f.select("doc_id").collect()} for n, f in seen.items()}
    assert kept["quality rules"] == set(texts) | {60, 61, 62}
    assert 60 not in kept["line dedup"] and set(texts) <= kept["line dedup"]
    assert kept["near-duplicates"] >= set(texts)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert seen[name].columns == [x.split()[0] for x in DOCS.split(", ")]
    mixed = {r.doc_id: r.text for r in seen["mixing sources"].collect()}
    assert all(r.text == mixed[r.doc_id] for r in seen["sentencepiece"].collect())
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, frame.collect()))
