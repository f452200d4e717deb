"""Cross-tokenizer alignment against the libraries and a plain loop over byte offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from urlsieve.llm import alignment

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens_of():
    """Ids and byte spans of blank + text by both libraries, or none where the bytes differ."""
    first, second = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}

    def spans(words: list[bytes]) -> list[tuple[int, int]]:
        out, at = [], 0
        for w in words:
            out.append((at, at + len(w)))
            at += len(w)
        return out

    def tokens(text: str | None):
        if not text:
            return [], [], [], []
        a = first.encode(" " + text, add_special_tokens=False).ids
        b = second.encode(text)
        by_a = [bytes(letter[c] for c in first.id_to_token(i)) for i in a]
        by_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if b"".join(by_a) != (" " + text).encode() or b"".join(by_b) != (" " + text).encode():
            return [], [], [], []
        return a, b, spans(by_a), spans(by_b)

    return tokens


def brute(texts, tokens_of):
    linked, held = [], []
    for t in texts:
        a, b, at_a, at_b = tokens_of(t)
        pairs = [(i, j) for i, (s, e) in enumerate(at_a) for j, (u, v) in enumerate(at_b) if s < v and u < e]
        held.append((a, b, at_a, at_b))
        linked.append([(a[i], b[j]) for i, j in pairs])
    count = Counter(p for x in linked for p in x)
    best: dict[int, int] = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (a, b, at_a, at_b), pairs in zip(held, linked, strict=True):
        both = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, low = [], 0
        for e in both:
            of = [",".join(str(x) for x, (s, _) in zip(ids, at, strict=True) if low <= s < e) for ids, at in ((a, at_a), (b, at_b))]
            groups.append("|".join(of))
            low = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(both), len(pairs), sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), digest))
    return out


WORDS = ["the", "naïve", "données", "12,345", "x", "  ", "\n\n", "it's", "ĀĂ", "漢字", "日本語テキスト", "😀", "<|endoftext|>", "<s>", "</s>", "<0x41>", "\t", "tion", "\x00", " ", "ﬁ", "é", "'re", "…"]
TEXTS = [None, "", " ", "  ", "a", "▁", "a▁b", "\x01", "\n", "hello world", "hello world", " lead", "trail ", "漢字" * 40, "!" * 50, "don't  stop", "<|endoftext|>"]


def mixed(n: int) -> list[str]:
    rng = random.Random(4)
    return ["".join(rng.choice(WORDS) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_rows_equal_brute_force(spark, tokens_of):
    texts = TEXTS + mixed(60)
    docs = spark.createDataFrame([(k, t, "other", 1) for k, t in enumerate(texts)], "doc_id long, text string, a string, n long").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs, BYTE_LEVEL, PIECES).collect()}
    want = brute(texts, tokens_of)
    assert [got[k] for k in range(len(texts))] == want
    assert got[0] == (0, 0, 0, 0, 0, 0, "") and got[6][-1] == ""  # a text with a mark of its own has other bytes


def test_long_texts_are_cut_where_both_end_a_token(tokens_of):
    texts = [" long words here ".join(mixed(9)) + " and an end" for _ in range(4)]
    for size in (7, 40):
        for t in texts:
            parts = alignment.stretches(" " + t, size)
            assert "".join(parts) == " " + t and len(parts) > 1
            whole, cut = (alignment.pair(BYTE_LEVEL, PIECES).tokens(x) for x in ([" " + t], parts))
            assert whole[0].tolist() == cut[0].tolist() and whole[2].tolist() == cut[2].tolist()
    batches = list(alignment._groups(texts, 64))
    assert len(batches) > 4
    ids = [[] for _ in texts]
    for row, few in batches:
        a, n_a, *_ = alignment.pair(BYTE_LEVEL, PIECES).tokens(few)
        for r, x in zip(row, np.split(a, np.cumsum(n_a)[:-1]), strict=True):
            ids[r] += x.tolist()
    assert ids == [tokens_of(t)[0] for t in texts]


def test_pieces_equal_the_library(tokens_of):
    both = alignment.pair(BYTE_LEVEL, PIECES)
    texts = [t for t in TEXTS + mixed(300) if t]
    a, n_a, b, n_b, same = both.tokens([" " + t for t in texts])
    at_a = at_b = 0
    for t, x, y, ok in zip(texts, n_a.tolist(), n_b.tolist(), same.tolist(), strict=True):
        want = tokens_of(t)
        assert ok == bool(want[0])
        if ok:
            assert a[at_a : at_a + x].tolist() == want[0] and b[at_b : at_b + y].tolist() == want[1]
        at_a, at_b = at_a + x, at_b + y


def test_counts_over_several_shards(spark, tmp_path):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 50, 4000) << 32 | rng.integers(0, 9, 4000)
    n = rng.integers(1, 5, 4000)
    rows = spark.createDataFrame([(int(k >> 32), int(k), int(c)) for k, c in zip(keys, n, strict=True)], "b int, key long, n long")
    shards = [tuple(r) for r in alignment.count_shards(rows, f"file://{tmp_path}/pairs", 500).collect()]
    assert len(shards) > 3
    want = Counter()
    for k, c in zip(keys.tolist(), n.tolist(), strict=True):
        want[k] += c
    every = np.array(sorted(want), np.int64)
    found, best = alignment.Counts(shards).of(every)
    assert found.tolist() == [want[k] for k in every.tolist()]
    top = Counter()
    for k, c in want.items():
        top[k >> 32] = max(top[k >> 32], c)
    assert best.tolist() == [top[k >> 32] for k in every.tolist()]


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, BYTE_LEVEL, PIECES).collect() == []
    docs = spark.createDataFrame([(None, "some words"), (1, "some words"), (1, "some words")], "doc_id long, text string")
    rows = alignment.align(docs, BYTE_LEVEL, PIECES).collect()
    assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1 and rows[0].count_sum == 3 * rows[0].n_links
