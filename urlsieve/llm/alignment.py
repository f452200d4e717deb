"""Aligning the tokens of two tokenizers by bytes, and counting over the corpus which ids cover the same bytes.

A text is cut where both tokenizers surely end a token, so that however long it is, few of its tokens are in memory as
numbers at once. An id pair is one 64-bit number, the second id in its high half. Each task counts its distinct pairs with
np.unique; the partial counts are sorted by ranges of the second id and equal neighbours summed, so that a shard holds all
pairs of its ids and knows each id's highest count. Shards are flat files that lookups map into memory and search by bisection.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm.common import cache_of_worker, remove, scope, scratch, slices, take_worker, written
from urlsieve.llm.pieces import MARK, Lattices
from urlsieve.llm.runs import STRETCH, Grown, Runs, code_points, ranges, stretches
from urlsieve.llm.tokenids import Encoder

#: Texts, and bytes of them, encoded at once. Results depend on neither.
TEXTS, BYTES = 2048, 1 << 20
#: Pairs that a task holds before it gives their counts, pairs in a shard, units remembered.
HELD, SHARD, MEMO = 6_000_000, 2_000_000, 400_000
#: A character that no piece holds beside another, put before a unit so that the library adds no mark to the unit itself.
GUARD = "\x01"


def _spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes one after another, where each id's start, and how many they are."""
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size


class Pair:
    """Both tokenizers: ids of texts, and the bytes of ids."""

    def __init__(self, byte_level: str, pieces: str):
        self.first = Encoder(byte_level, plain=True)
        letter = {c: b for b, c in self.first.letters.items()}
        tokens = [self.first.tokenizer.id_to_token(i) or "" for i in range(self.first.tokenizer.get_vocab_size())]
        a = [bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode() for t in tokens]
        lattice = Lattices(pieces)
        self.sp, self.part = lattice.sp, lattice.part
        self.part[ord(" ")] = 0
        back = {i: bytes([b]) for b, i in lattice.byte.items()}
        b = [back.get(i) or self.sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.sp.get_piece_size())]
        self.spelled = _spelled(a), _spelled(b)
        self.guard = len(self.sp.encode(GUARD))
        self.forget()

    def forget(self) -> None:
        self.units, self.start, self.ids = Runs(), Grown(np.int64), Grown(np.uint32)
        self.start.add(np.zeros(1, np.int64))

    def second(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The piece model's ids of texts that start with a blank in place of the library's mark, and the number of each text's.

        Units that no piece crosses are encoded once while they are remembered.
        """
        if len(self.units) > MEMO:
            self.forget()
        flat = "".join(texts)
        points = code_points(flat)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.cumsum(sizes) - sizes
        part = self.part[points]
        cut = np.ones(len(points), bool)
        cut[1:] = (part[:-1] > 0) & ((part[1:] != part[:-1]) | (part[1:] == 1))
        cut[edges[sizes > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(points)))
        which, new = self.units.number(points, start, size)
        if len(new):
            words = [GUARD + flat[x:z] for x, z in zip(start[new].tolist(), (start + size)[new].tolist(), strict=True)]
            found = [ids[self.guard :] for ids in self.sp.encode(words, num_threads=1)]
            self.start.add(self.ids.n + np.cumsum([len(x) for x in found]))
            self.ids.add(np.array([i for x in found for i in x], np.uint32))
        at = self.start.of[which]
        n = self.start.of[which + 1] - at
        upto = np.concatenate([[0], np.cumsum(n)])
        counts = upto[np.searchsorted(start, edges + sizes)] - upto[np.searchsorted(start, edges)]
        return self.ids.of[ranges(at, n)], counts

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both and their numbers by text, and whether the bytes of both are the text's."""
        a, n_a = self.first(texts)
        b, n_b = self.second(texts)
        raw = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
        same = np.ones(len(texts), bool)
        for ids, n, (flat, start, wide) in ((a, n_a, self.spelled[0]), (b, n_b, self.spelled[1])):
            own = sums(wide[ids], n)
            whole = own == size
            if not whole.all():
                # bytes are compared where the numbers of bytes agree
                ids, left = ids[np.repeat(whole, n)], raw[np.repeat(whole, size)]
            else:
                left = raw
            wrong = flat[ranges(start[ids], wide[ids])] != left
            whole[whole] = sums(wrong, size[whole]) == 0
            same &= whole
        return a, n_a, b, n_b, same


def sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of n[0], n[1], ... values in turn."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(n)
    return upto[ends] - upto[ends - n]


class Links:
    """Tokens of both side by side: where both end, and which overlap. n_a and n_b are tokens by part; parts' bytes agree."""

    def __init__(self, wide: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        end_a, end_b = np.cumsum(wide[0][a]), np.cumsum(wide[1][b])
        total = int(end_a[-1]) if len(end_a) else 0
        ends = np.zeros((2, total + 1), bool)
        ends[0, end_a] = ends[1, end_b] = True
        # each stretch between neighbouring ends is the overlap of one token of either
        at = np.flatnonzero(ends[0] | ends[1])
        in_a, in_b = ends[0, at], ends[1, at]
        self.at_a, self.at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        both = in_a & in_b
        self.last_a, self.last_b = both[in_a], both[in_b]

    def keys(self) -> np.ndarray:
        return self.b[self.at_b].astype(np.int64) << 32 | self.a[self.at_a]

    def by_part(self, n_a: np.ndarray) -> np.ndarray:
        """Links of parts that have so many tokens of the first."""
        return np.diff(np.searchsorted(self.at_a, np.concatenate([[0], np.cumsum(n_a)])))

    def spelled(self, digits: np.ndarray, n_digits: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The groups as text, each with a semicolon at its end, and where each part's ends."""
        upto_a, upto_b = np.concatenate([[0], np.flatnonzero(self.last_a) + 1]), np.concatenate([[0], np.flatnonzero(self.last_b) + 1])
        group_a, group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        spot_a = np.arange(len(self.a)) + upto_b[group_a]
        spot_b = np.arange(len(self.b)) + upto_a[group_b + 1]
        ids, mark = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        ids[spot_a], ids[spot_b] = self.a, self.b
        mark[spot_a], mark[spot_b] = np.where(self.last_a, ord("|"), ord(",")), np.where(self.last_b, ord(";"), ord(","))
        rows, size = digits[ids], n_digits[ids]
        rows[np.arange(len(ids)), size] = mark
        ends = np.concatenate([[0], np.cumsum(size + 1)])[np.cumsum(n_a + n_b)]
        return rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes(), ends


_pairs = cache_of_worker()


def pair(byte_level: str, pieces: str) -> Pair:
    """One per worker process and pair of tokenizers."""
    if (byte_level, pieces) not in _pairs:
        _pairs[byte_level, pieces] = Pair(byte_level, pieces)
    return _pairs[byte_level, pieces]


def encode_both(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b, parts): ids of blank + text by both as unsigned 32-bit integers, and how many of either are in each part.

    Parts are cut where both tokenizers end a token. A null or empty text, and one whose tokens' bytes are not the text's,
    has no tokens. A row per row; extra columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(_pairs)
        both = pair(byte_level, pieces)
        for batch in batches:
            for part in slices(batch, 1, TEXTS, BYTES):
                texts = part.column(1).to_pylist()
                found: list[list[tuple]] = [[] for _ in texts]
                bad = np.zeros(len(texts), bool)
                for row, few in _groups(texts):
                    a, n_a, b, n_b, same = both.tokens(few)
                    bad[np.array(row)[~same]] = True
                    upto_a, upto_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
                    for k, r in enumerate(row):
                        found[r].append((a[upto_a[k] : upto_a[k + 1]].astype("<u4").tobytes(), b[upto_b[k] : upto_b[k + 1]].astype("<u4").tobytes()))
                for r in np.flatnonzero(bad):
                    found[r] = []
                columns = [[b"".join(x[c] for x in f) for f in found] for c in (0, 1)]
                sizes = [np.array([(len(x) // 4, len(y) // 4) for x, y in f], "<u4").tobytes() for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.binary()) for c in (*columns, sizes))], ["doc_id", "a", "b", "parts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, a binary, b binary, parts binary")


def _groups(texts: list[str | None], size: int = STRETCH) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and stretches of their texts, a blank before each text, so many at once as one call should take."""
    row, few, n = [], [], 0
    for r, t in enumerate(texts):
        for s in stretches(" " + t, size) if t else ():
            row.append(r)
            few.append(s)
            n += len(s)
            if n >= size:
                yield row, few
                row, few, n = [], [], 0
    if few:
        yield row, few


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the parts, the ids of both and their numbers by part, for about STRETCH tokens at once."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    n = 0

    def out() -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return [r for r, _, _ in held], *(np.concatenate([x[c] for x in held]) for c in (1, 2)), *(np.array([len(x[c]) for x in held]) for c in (1, 2))

    for r in range(batch.num_rows):
        a, b, sizes = (np.frombuffer(batch.column(c)[r].as_buffer(), "<u4") for c in (1, 2, 3))
        i = j = 0
        for n_a, n_b in sizes.reshape(-1, 2).tolist():
            held.append((r, a[i : i + n_a], b[j : j + n_b]))
            i, j, n = i + n_a, j + n_b, n + n_a
            if n >= STRETCH // 2:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def partial_counts(tokens: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(b, key, n): links by id pair as each task finds them; a pair comes once from a task, or again after HELD others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(_pairs)
        wide = tuple(x[2] for x in pair(byte_level, pieces).spelled)
        keys, n, more = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, back = np.unique(np.concatenate([keys, *(k for k, _ in more)]), return_inverse=True)
            return found, np.bincount(back, np.concatenate([n, *(c for _, c in more)]), len(found)).astype(np.int64)

        def given() -> Iterator[pa.RecordBatch]:
            for s in range(0, len(keys), 1 << 18):
                k = keys[s : s + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array(k), pa.array(n[s : s + (1 << 18)])], ["b", "key", "n"])

        waiting = 0
        for batch in batches:
            for part in slices(batch, 1, TEXTS, BYTES):
                for _, a, b, _, _ in _parts(part):
                    more.append(np.unique(Links(wide, a, b).keys(), return_counts=True))
                    waiting += len(more[-1][0])
                    if waiting > max(len(keys), HELD // 4):
                        keys, n = merged()
                        more, waiting = [], 0
                        if len(keys) > HELD:
                            yield from given()
                            keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = merged()
        yield from given()

    return tokens.select("doc_id", "a", "b", "parts").mapInArrow(run, "b int, key long, n long")


def count_shards(partial: DataFrame, folder: str, size: int = SHARD) -> DataFrame:
    """Writes shards of summed counts, sorted by pair; the written manifest: path, low, high (the first and last pair), n.

    A shard holds its pairs, their counts, and for each pair the highest count of its second id, as 64-bit integers. Pairs of
    one second id, fewer than the first tokenizer has ids, are in one shard. Each attempt of a task writes a file of its own.
    """
    parts = partial.count() // size + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            if not len(keys):
                continue
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys, n = keys[start], np.add.reduceat(n, start)
            if found and found[-1][0][-1] == keys[0]:
                found[-1][1][-1] += n[0]
                keys, n = keys[1:], n[1:]
            if len(keys):
                found.append((keys, n))
        if not found:
            return
        keys, n = (np.concatenate([x[c] for x in found]) for c in (0, 1))
        second = keys >> 32
        start = np.flatnonzero(np.append(True, second[1:] != second[:-1]))
        best = np.repeat(np.maximum.reduceat(n, start), np.diff(np.append(start, len(n))))
        uri = f"{folder}/{uuid.uuid4().hex}.pairs"
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as f:
            for x in (keys, n, best):
                f.write(x.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"path": [uri], "low": [int(keys[0])], "high": [int(keys[-1])], "n": [len(keys)]})

    rows = partial.repartitionByRange(parts, "b").sortWithinPartitions("key").select("key", "n")
    return written(rows.mapInArrow(run, "path string, low long, high long, n long"), "shards")


class Counts:
    """Counts of pairs from shards, which are mapped into memory where they are files of a mounted file system."""

    def __init__(self, shards: list[tuple[str, int, int, int]]):
        self.shards = sorted(shards, key=lambda s: s[1])
        self.low = np.array([s[1] for s in self.shards], np.int64)
        self.open: dict[int, np.ndarray] = {}

    def _shard(self, k: int) -> np.ndarray:
        if k not in self.open:
            uri, _, _, n = self.shards[k]
            fs, path = pafs.FileSystem.from_uri(uri)
            if isinstance(fs, pafs.LocalFileSystem):
                self.open[k] = np.memmap(path, "<i8", "r", shape=(3, n))
            else:
                with fs.open_input_file(path) as f:
                    self.open[k] = np.frombuffer(f.read(), "<i8").reshape(3, n)
        return self.open[k]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted pairs, all of which were counted: their counts, and the highest of their second ids."""
        out = np.zeros((2, len(keys)), np.int64)
        spots = np.append(np.searchsorted(keys, self.low), len(keys))
        for k in np.flatnonzero(np.diff(spots)):
            s, z = spots[k], spots[k + 1]
            shard = self._shard(int(k))
            out[:, s:z] = shard[1:, np.searchsorted(shard[0], keys[s:z])]
        return out[0], out[1]





def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a written table with a row per row of docs.

    The tokens are those of blank + text. Groups end where tokens of both end; a link is a token of either that overlap in
    bytes; a pair's count is its number of links over all docs; n_best is the number of links whose pair has the highest count
    of its second id, ties included. A null or empty text, and one whose tokens' bytes are not the text's, has zeros and ''.
    Repeated rows count each time. Extra columns are ignored. Empty table: no rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "pairs")
    with scope(spark) as keep:
        tokens = written(encode_both(docs, byte_level, pieces, id_col, text_col), "tokens", "zstd")
        partial = written(partial_counts(tokens, byte_level, pieces), "partial", "zstd")
        shards = [tuple(r) for r in count_shards(partial, folder).collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take_worker(_pairs)
            wide = tuple(x[2] for x in pair(byte_level, pieces).spelled)
            digits, n_digits = _digits(max(map(len, wide)))
            counts = Counts(shards)
            for batch in batches:
                for part in slices(batch, 1, TEXTS, BYTES):
                    rows = np.zeros((6, part.num_rows), np.int64)
                    hashes = [hashlib.sha256() if len(part.column(1)[r].as_buffer()) else None for r in range(part.num_rows)]
                    pending = [False] * part.num_rows
                    for row, a, b, n_a, n_b in _parts(part):
                        links = Links(wide, a, b)
                        keys, back = np.unique(links.keys(), return_inverse=True)
                        n, best = counts.of(keys)
                        by = links.by_part(n_a)
                        found = n_a, n_b, sums(links.last_a, n_a), by, sums((n == best)[back], by), sums(n[back], by)
                        for c, x in enumerate(found):
                            np.add.at(rows[c], row, x)
                        text, ends = links.spelled(digits, n_digits, n_a, n_b)
                        for r, s, z in zip(row, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                            # a semicolon between groups, none after the last
                            hashes[r].update(b";" * pending[r] + text[s : z - 1])
                            pending[r] = True
                    shown = pa.array([h.hexdigest() if h else "" for h in hashes])
                    yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, rows), shown], NAMES)

        kinds = ", ".join(["doc_id long", *(f"{c} long" for c in NAMES[1:-1]), "groups_sha256 string"])
        out = keep(written(tokens.select("doc_id", "a", "b", "parts").mapInArrow(run, kinds), "aligned"))
    remove(spark, [folder])
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1 as rows with room for one more byte, and how many there are."""
    words = [str(i).encode() for i in range(n)]
    wide = len(words[-1]) + 1
    return np.frombuffer(b"".join(w.ljust(wide) for w in words), np.uint8).reshape(n, wide), np.array([len(w) for w in words])


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
