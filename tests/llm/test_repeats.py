"""Repeated byte strings against a table of all windows, and suffixes against sorting them."""

from __future__ import annotations

import hashlib
import random

import duckdb
import numpy as np
import pytest

from urlsieve.llm import repeats


def brute(docs):
    """(n_bytes, n_removed, n_spans, sha256) of each row, by a set of windows for each id."""
    raw = [(-(2**63) if d is None else d, (t or "").encode()) for d, t in docs]
    least: dict[bytes, int] = {}
    for d, t in raw:
        for k in range(len(t) - 49):
            w = t[k : k + 50]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in raw:
        gone = [False] * (len(t) + 1)
        for k in range(len(t) - 49):
            if least[t[k : k + 50]] < d:
                gone[k : k + 50] = [True] * 50
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def documents(seed: int):
    """Random words, passages that several share whole or in part, copies, near copies, runs of one byte, and edges of 50 bytes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randrange(8, 40)) for _ in range(12)]
    middle = text(7)[:30]
    out = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.random()
            p = rng.choice(passages)
            if kind < 0.3:
                parts.append(text(rng.randrange(1, 30)))
            elif kind < 0.6:
                s = rng.randrange(len(p) // 2)
                parts.append(p[s : s + rng.randrange(30, 120)])
            elif kind < 0.75:
                parts.append(text(6) + middle + text(6))
            elif kind < 0.85:
                parts.append(rng.choice("xy ") * rng.randrange(20, 130))
            else:
                at = rng.randrange(len(p))
                parts.append(p[:at] + "#" + p[at + 1 :])
        out.append("".join(parts))
    out += out[:10] + ["", None, "a", "q" * 49, "q" * 50, "q" * 51, passages[0], passages[0][:50], passages[0][:49]]
    ids = rng.sample(range(1000), len(out))
    docs = list(zip(ids, out, strict=True))
    return docs + [(None, passages[1]), (None, passages[1]), (docs[0][0], docs[0][1]), (-5, passages[2])]


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"chunk": 2000, "strings": 40}), (3, {"chunk": 3000, "hot": 3, "strings": 100})])
def test_rows_equal_brute_force(spark, seed, sizes):
    docs = documents(seed)
    df = spark.createDataFrame([(d, t, k, "x") for k, (d, t) in enumerate(docs)], "doc_id long, text string, chunk int, `range` string").repartition(4)
    rows = repeats.remove_repeats(df, **sizes).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows)
    want = sorted((d is not None, d or 0, *x) for (d, _), x in zip(docs, brute(docs), strict=True))
    assert got == want and sum(x[3] for x in want) > 1000


def test_suffixes_in_order_with_prefixes(tmp_path):
    rng = np.random.default_rng(3)
    strings = [rng.integers(1, 4, n) for n in rng.integers(1, 30, 60)] + [np.array([2, 2, 2, 2, 2, 2])] * 3
    size = np.array([len(s) for s in strings])
    files = repeats.Files(f"file://{tmp_path}")
    width = 4
    string, length, prefix = repeats.suffixes(np.concatenate(strings), np.cumsum(size) - size, size, width, files)
    files.close()
    got = [strings[i][len(strings[i]) - n :].tolist() for i, n in zip(string, length, strict=True)]
    want = sorted(s[k:].tolist() for s in strings for k in range(len(s) - width + 1))
    assert got == want
    common = [next((k for k in range(width) if a[k] != b[k]), width) for a, b in zip(want, want[1:], strict=False)]
    assert prefix[1:].tolist() == common
    assert not list(tmp_path.iterdir())


def test_windows_choose_by_their_bytes_alone():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    sizes = np.array([0, 10, 49, 50, 51, 0, 1000, 1840])
    ends = np.cumsum(sizes)
    first, seed, count = repeats.chosen(text, ends)
    place = {int(f) + k: int(s) - int(f) - k for f, s, c in zip(first, seed, count, strict=True) for k in range(c)}
    starts = ends - sizes
    assert sorted(place) == [w for s, e in zip(starts, ends, strict=True) for w in range(s, e - 49)]
    by: dict[bytes, int] = {}
    for w, at in place.items():
        assert by.setdefault(text[w : w + 50].tobytes(), at) == at and 0 <= at <= 30
    # other slices, same choice
    again = repeats.chosen(np.concatenate([text, text]), np.concatenate([ends, ends + 3000]))
    assert {int(f) - 3000 + k: int(s - f) - k for f, s, c in zip(*again, strict=True) for k in range(c) if f >= 3000} == place


def test_empty_tables_and_texts(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = repeats.remove_repeats(spark.createDataFrame([(1, None), (2, ""), (3, "z" * 60)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.spans, bytes(r.kept)) for r in rows) == [(1, 0, [], b""), (2, 0, [], b""), (3, 60, [], b"z" * 60)]


def test_sql_equals_brute_force():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    docs = [d for d in documents(2) if d[0] is not None]
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert sorted(con.sql(repeats.SQL).fetchall()) == sorted((d, *x) for (d, _), x in zip(docs, brute(docs), strict=True))
