"""Token counts by transducers compiled from a tokenizer file: one that cuts words, one that counts a word's BPE tokens.

The first runs over characters in chunks: each chunk yields a map from every entry state to its exit state, and the maps
compose in a parallel prefix scan, which gives each chunk's true entry state. The second runs over the bytes of all words
side by side. Its state is what BPE can still change: the longest end of the input that starts a token, and for each cut
in it the last token before the cut and how many tokens there are. A transition carries the number of tokens by which
the count grows (it may shrink: two tokens become one). Its states and transitions are compiled when they are first met.
A long word is cut into chunks, too, whose maps from entry state to exit state and count are worked out for the states
that can come in, all chunks side by side, and compose in a scan by doubling.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from urlsieve.llm.common import cache_of_worker, slices, take_worker
from urlsieve.llm.runs import STRETCH, stretches
from urlsieve.llm.tokenids import SAFE, _byte_letters

#: The limit above which a document is too long.
LIMIT = 2048
#: Characters in a chunk of the first transducer; states kept before all are compiled anew.
CHUNK, STATES = 64, 120_000
#: Texts and bytes taken at once.
TEXTS, BYTES = 4096, 1 << 21
#: Bytes in a chunk of a long word, and of the run-up that guesses a chunk's entry state.
PIECE, RUN_UP = 256, 32
END = "</w>"
#: How the file must say that texts are normalised and cut into words, which the first transducer does.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# The first transducer. Characters: white space, letter, digit, other, and apostrophes that two or three characters of a
# contraction start with. States: outside a word, in letters, in others, one or two letters before a contraction's end.
SPACE, LETTER, DIGIT, OTHER, TWO, THREE = range(6)
OUT, LETTERS, OTHERS, ONE_LEFT, TWO_LEFT = range(5)
NEXT = np.zeros((5, 6), np.uint8)
NEXT[:, SPACE] = OUT
NEXT[:, LETTER] = LETTERS, LETTERS, LETTERS, OUT, ONE_LEFT
NEXT[:, DIGIT] = OUT
NEXT[:, OTHER] = OTHERS
NEXT[:, TWO] = ONE_LEFT, ONE_LEFT, OTHERS, ONE_LEFT, ONE_LEFT
NEXT[:, THREE] = TWO_LEFT, TWO_LEFT, OTHERS, TWO_LEFT, TWO_LEFT
STARTS = np.ones((5, 6), bool)  # whether the character starts a word
STARTS[:, SPACE] = False
STARTS[LETTERS, LETTER] = STARTS[ONE_LEFT, LETTER] = STARTS[TWO_LEFT, LETTER] = False
STARTS[OTHERS, [OTHER, TWO, THREE]] = False


def entry_states(kinds: np.ndarray) -> np.ndarray:
    """The state before each chunk (a row of kinds): state maps of chunks, composed by a prefix scan."""
    maps = np.tile(np.arange(5, dtype=np.uint8), (len(kinds), 1))
    for k in range(kinds.shape[1]):
        maps = NEXT[maps, kinds[:, k, None]]
    step = 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)
        step *= 2
    return np.concatenate([[OUT], maps[:-1, OUT]]).astype(np.uint8)


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Whether each character starts a word."""
    rows = np.concatenate([kinds, np.full(-len(kinds) % CHUNK, SPACE, np.uint8)]).reshape(-1, CHUNK)
    state, out = entry_states(rows), np.zeros(rows.shape, bool)
    for k in range(CHUNK):
        out[:, k] = STARTS[state, rows[:, k]]
        state = NEXT[state, rows[:, k]]
    return out.ravel()[: len(kinds)]


class Counter:
    """Compiled from a tokenizer file of BPE over bytes with an end-of-word suffix, as word_bpe_49k.json."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        model, (split, spell) = kind["model"], (kind["pre_tokenizer"] or {}).get("pretokenizers") or ({}, {})
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} is not plain BPE with the end-of-word suffix {END}")
        if kind["normalizer"] != NORMALIZER or split.get("pattern") != {"Regex": WORDS} or (split.get("behavior"), split.get("invert")) != ("Removed", True) or spell.get("type") != "ByteLevel" or spell.get("add_prefix_space") or spell.get("use_regex"):
            raise ValueError(f"{path} cuts words in another way")
        if kind["post_processor"] or kind["truncation"] or kind["padding"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in kind["added_tokens"]):
            raise ValueError(f"{path} adds tokens in another way")
        # a symbol is a character: a byte, or 256 more for a word's last byte
        symbol = {c: chr(b) for b, c in _byte_letters().items()}

        def symbols(token: str) -> str:
            last = token.endswith(END) and token != END
            body = "".join(symbol[c] for c in (token[: -len(END)] if last else token))
            return body[:-1] + chr(ord(body[-1]) + 256) if last else body

        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {}
        for k, (a, b) in enumerate(pairs):
            self.rank.setdefault((symbols(a), symbols(b)), k)
        tokens = {chr(c) for c in range(512)} | {a + b for a, b in self.rank}
        self.tokens = {t for t in tokens if len(t) == 1 or self.bpe(t) == [t]}
        self.heads = {t[:k] for t in self.tokens for k in range(1, len(t))}
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.kind = np.full(0x110000, 255, np.uint8)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        start = ("", ((0, "", 0),))
        self.states, self.names = [start], {start: 0}
        self.size = 1 << 16
        self.keys, self.values, self.used = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int64), 0

    def bpe(self, text: str) -> list[str]:
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = min(((rank.get(p, 1 << 30), p) for p in zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 30:
                break
            a, b = best[1]
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether BPE leaves the two tokens apart: no merge crosses their border."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self.bpe(a + b) == [a, b]
        return found

    def move(self, state: int, sym: int) -> tuple[int, int]:
        """Next state and by how much the count grows. A state: the input's end that starts a token, and its cuts as
        (characters before the cut in that end, last token before it or empty at the word's start, count less the count
        at the end)."""
        tail, cuts = self.states[state]
        grown = tail + chr(sym)
        for at, last, count in cuts:  # the longest token first
            token = grown[at:]
            if token in self.tokens and (not last or self.fits(last, token)):
                break
        else:
            raise AssertionError("every symbol is a token")
        delta = count + 1
        if sym >= 256:
            return 0, delta
        left = [(a, x, n - delta) for a, x, n in cuts if grown[a:] in self.heads] + [(len(grown), token, 0)]
        skip = left[0][0]
        name = (grown[skip:], tuple((a - skip, x, n) for a, x, n in left))
        to = self.names.get(name)
        if to is None:
            to = self.names[name] = len(self.states)
            self.states.append(name)
        return to, delta

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(0x9E3779B97F4A7C1)) >> np.int64(20)) & np.int64(self.size - 1)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 3 * (self.used + len(keys)) > self.size:
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            while 3 * len(keys) > self.size:
                self.size *= 4
            self.keys, self.values, self.used = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int64), 0
        self.used += len(keys)
        for key, value, s in zip(keys.tolist(), values.tolist(), self._slot(keys).tolist(), strict=True):
            while self.keys[s] >= 0:
                s = (s + 1) & (self.size - 1)
            self.keys[s], self.values[s] = key, value

    def step(self, state: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and growths of many machines at once."""
        key = state << 9 | sym
        at = self._slot(key)
        found = self.keys[at]
        if (found != key).any():
            at = self._probe(key, at)
            if (missing := at < 0).any():
                new = np.unique(key[missing])
                moves = [self.move(k >> 9, k & 511) for k in new.tolist()]
                self._insert(new, np.array([to << 8 | delta + 128 for to, delta in moves], np.int64))
                at = self._probe(key, self._slot(key))
        value = self.values[at]
        return value >> 8, (value & 255) - 128

    def _probe(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        open_ = np.flatnonzero(self.keys[at] != key)
        at = at.copy()
        while len(open_):
            gone = self.keys[at[open_]] < 0
            at[open_[gone]] = -1
            open_ = open_[~gone]
            at[open_] = (at[open_] + 1) & (self.size - 1)
            open_ = open_[self.keys[at[open_]] != key[open_]]
        return at

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """Each character's kind; the library itself says how it splits a character that is new."""
        kind = self.kind[points]
        if (kind == 255).any():
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for p in np.unique(points[kind == 255]).tolist():
                c = chr(p)
                self.kind[p] = SPACE if not cut(c) else LETTER if len(cut("a" + c)) == 1 else DIGIT if len(cut(c + c)) == 2 else OTHER
            kind = self.kind[points]
        quote = np.flatnonzero(points == ord("'"))
        if len(quote):
            far = np.concatenate([points, [0, 0]])
            a, b = far[quote + 1], far[quote + 2]
            kind[quote[np.isin(a, [ord(c) for c in "stmd"])]] = TWO
            kind[quote[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = THREE
        return kind

    def normal(self, text: str) -> str:
        return text.lower() if SAFE.fullmatch(text) else self.tokenizer.normalizer.normalize_str(text)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        if len(self.states) > STATES:
            self.forget()
        total, parts, owner = np.zeros(len(texts), np.int64), [], []
        for k, text in enumerate(texts):
            cut = self.added.split(text)
            total[k] += len(cut) - 1
            for x in cut:
                if x:
                    parts.append(self.normal(x) + "\n")
                    owner.append(k)
        if not parts:
            return total
        flat = "".join(parts)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds(points)
        first = word_starts(kind)
        spaced = np.append(first[1:], True) | np.append(kind[1:] == SPACE, True)
        last = (kind != SPACE) & spaced
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte_end = np.cumsum(width)
        begin, end = (byte_end - width)[first], byte_end[last]
        raw = np.frombuffer(flat.encode("utf-8", "surrogatepass"), np.uint8)
        part_end = byte_end[np.cumsum([len(p) for p in parts]) - 1]
        which = np.array(owner)[np.searchsorted(part_end, begin, side="right")]
        total += np.bincount(which, self.words(raw, begin, end - begin), len(texts)).astype(np.int64)
        return total

    def run(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray, entry: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of stretches raw[begin : begin + size] from their entry states, a byte of each at a time.

        ends: whether the stretch's last byte is its word's.
        """
        order = np.argsort(-size, kind="stable")
        at, n, state, last = begin[order], size[order], entry[order], ends[order]
        count = np.zeros(len(n), np.int64)
        live = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right") if len(n) else np.zeros(0, np.int64)
        for step, m in enumerate(live.tolist()):
            sym = raw[at[:m] + step].astype(np.int64)
            done = int(np.searchsorted(-n[:m], -(step + 1), side="left"))
            sym[done:] += 256 * last[done:m]
            state[:m], grown = self.step(state[:m], sym)
            count[:m] += grown
        out, counts = np.empty_like(state), np.empty_like(count)
        out[order], counts[order] = state, count
        return out, counts

    def words(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of tokens of each word raw[begin : begin + size]."""
        out, long_ = np.zeros(len(size), np.int64), size > PIECE
        short = np.flatnonzero(~long_)
        out[short] = self.run(raw, begin[short], size[short], np.zeros(len(short), np.int64), np.ones(len(short), bool))[1]
        if long_.any():
            out[long_] = self.long_words(raw, begin[long_], size[long_])
        return out

    def long_words(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        chunks = -(-size // PIECE)
        first = np.cumsum(chunks) - chunks
        word = np.repeat(np.arange(len(size)), chunks)
        k = np.arange(len(word)) - first[word]
        at = begin[word] + PIECE * k
        n = np.minimum(PIECE, begin[word] + size[word] - at)
        last = k == chunks[word] - 1
        # the maps, as far as they are needed: chunk << 32 | entry state, exit state, count
        entry, later = np.zeros(len(word), np.int64), np.flatnonzero(k)
        entry[later] = self.run(raw, at[later] - RUN_UP, np.full(len(later), RUN_UP), np.zeros(len(later), np.int64), np.zeros(len(later), bool))[0]
        keys, exits, counts = (np.zeros(0, np.int64) for _ in range(3))
        new = np.arange(len(word)) << 32 | entry
        while len(new):
            c = new >> 32
            out, count = self.run(raw, at[c], n[c], new & 0xFFFFFFFF, last[c])
            keys, exits, counts = np.concatenate([keys, new]), np.concatenate([exits, out]), np.concatenate([counts, count])
            # what comes out of a chunk comes into the next one
            new = np.setdiff1d((c[~last[c]] + 1) << 32 | out[~last[c]], keys)
        order = np.argsort(keys)
        keys, exits, total = keys[order], exits[order], np.append(counts[order], 0)
        c = keys >> 32
        next_ = np.append(np.where(last[c], len(keys), np.searchsorted(keys, (c + 1) << 32 | exits)), len(keys))
        while (next_ < len(keys)).any():
            total, next_ = total + total[next_], next_[next_]
        return total[np.searchsorted(keys, first << 32)]


_counters = cache_of_worker()


def counter(path: str) -> Counter:
    """One per worker process and tokenizer."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def by_stretches(count: Counter, texts: list[str], size: int = STRETCH) -> np.ndarray:
    """The number of tokens of each text; of a long one, stretches that end before a blank are counted in turn.

    A blank between two other characters ends a word, and neither normal forms nor special tokens reach over it.
    """
    if max(map(len, texts), default=0) <= size:
        return count(texts)
    return np.array([sum(int(count([s])[0]) for s in stretches(t, size)) for t in texts], np.int64)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row per row, no shuffle.

    Null and empty texts have no bytes and no tokens. A special token's string inside a text is one token, as it is for
    the library by default. Extra columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(_counters)
        count = counter(tokenizer)
        for batch in batches:
            for part in slices(batch, 1, TEXTS, BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = by_stretches(count, texts)
                size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
