"""Token ids in binary shards of patched frame-of-reference blocks, written in document order and read back.

A shard: MAGIC; blocks; the byte offset of each block (u64); a row per document (i64 id, u8 whether the id is null, u32
number of ids) as three arrays; a footer of six u64: number of ids, blocks, documents, offset of the block index, offset
of the document index, MAGIC. A block holds BLOCK ids, the last of a shard fewer: u32 least id, u16 number of ids, u8
width, u8 zero, u16 number of exceptions, then the low `width` bits of each id's distance from the least one, then
positions (u16) and the remaining high bits (u32) of those that need more. The width is that of the distance at a
percentile of the block. All numbers are little-endian; bits are packed least first.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from urlsieve.llm.common import cache_of_worker, scratch, slices, take_worker, written
from urlsieve.llm.runs import STRETCH, Grown, Runs, code_points, ranges, stretches

MAGIC = int.from_bytes(b"PFORIDS1", "little")
BLOCK = 1024
PERCENTILE = 0.9
END_ID = 0
#: Pre-tokens whose ids a worker remembers; at this number it forgets them all. Texts and bytes encoded at once. Results
#: don't depend on them.
MEMO, TEXTS, BYTES = 400_000, 1024, 1 << 20
#: Ids packed at once, and blocks unpacked at once.
CHUNK, AT_ONCE = 1 << 19, 512
#: Characters on whose classes all Unicode versions and both regular-expression libraries agree.
SAFE = re.compile("[\t\n\r\x20-\x7e¡-ſΑ-ΡΣ-ωА-я–—‘’“”…ぁ-んァ-ヶ一-龥가-힣]*")
#: The letters and numbers among them.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſΑ-ΡΣ-ωА-яぁ-んァ-ヶ一-龥가-힣", "0-9²³¹¼-¾"
#: Classes of characters.
OTHER, LETTER, NUMBER, BLANK, WHITE = range(5)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _classes() -> np.ndarray:
    kind = np.zeros(0x10000, np.uint8)
    every = "".join(map(chr, range(0xD800)))
    for number, chars in ((LETTER, _LETTERS), (NUMBER, _NUMBERS)):
        for m in re.finditer(f"[{chars}]", every):
            kind[ord(m[0])] = number
    kind[[ord(c) for c in "\t\n\r"]] = WHITE
    kind[ord(" ")] = BLANK
    return kind


_CLASS = _classes()


def pre_tokens(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokens of SAFE texts start, the texts standing one after another, each from its edge on.

    A pre-token is a contraction's end ('s 't 're 've 'm 'll 'd), or an optional blank and a run of letters, of numbers or
    of others, or white space: a run of it leaves its last character to what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[points]
    space, fresh = kind >= BLANK, np.zeros(n + 1, bool)
    fresh[edges] = fresh[n] = True
    before, after = np.empty_like(kind), np.empty(n, bool)
    before[0], before[1:] = WHITE, kind[:-1]
    before[fresh[:n]] = WHITE
    after[:-1], after[-1] = space[1:], True
    after |= fresh[1:]  # so the end of a text is like white space
    start = np.where(space, (before < BLANK) | ~after, (kind != before) & (before != BLANK))
    start |= fresh[:n]
    quote = np.flatnonzero((points == ord("'")) & start & (before != BLANK))
    if len(quote):
        edge = np.flatnonzero(fresh)
        room = edge[np.searchsorted(edge, quote, side="right")] - quote
        far = np.append(points, [0, 0])
        a, b = np.where(room > 1, far[quote + 1], 0), np.where(room > 2, far[quote + 2], 0)
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[quote[two] + 1] = start[quote[three] + 1] = start[quote[three] + 2] = False
        ends = np.concatenate([quote[two] + 2, quote[three] + 3])
        ends = ends[ends < n]
        start[ends[~space[ends]]] = True
    return np.flatnonzero(start)


class Encoder:
    """The tokenizers library's ids of whole texts; the model runs once per distinct pre-token while it is remembered.

    A text with an added token's string or a character outside SAFE goes through the library as a whole, and so does any
    text if the tokenizer is another than plain byte-level BPE. With `plain` those strings are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        cut, model = kind["pre_tokenizer"] or {}, kind["model"]
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback") if model.get(k)]
        tokens = [t for t in kind["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and kind["normalizer"]]
        self.by_word = all(cut.get(k) == v for k, v in usual.items()) and model["type"] == "BPE" and not (odd or tokens or kind["normalizer"] or kind["post_processor"] or kind["truncation"] or kind["padding"])
        self.added = [] if plain else [t["content"] for t in kind["added_tokens"]]
        self.tokenizer.encode_special_tokens = plain
        self.letters = _byte_letters()
        self.words = Runs()
        self.forget()

    def forget(self) -> None:
        self.words.forget()
        self.start, self.ids = Grown(np.int64), Grown(np.uint32)
        self.start.add(np.zeros(1, np.int64))

    def _learn(self, words: list[str]) -> None:
        tokenize = self.tokenizer.model.tokenize
        wide = np.array([len(w.encode()) for w in words], np.int64)
        spelled, ends = "".join(words).encode().decode("latin-1").translate(self.letters), np.cumsum(wide)
        found = [[t.id for t in tokenize(spelled[a:z])] for a, z in zip((ends - wide).tolist(), ends.tolist(), strict=True)]
        self.start.add(self.ids.n + np.cumsum([len(x) for x in found]))
        self.ids.add(np.fromiter(chain.from_iterable(found), np.uint32))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each text's ids.

        A long text is encoded by stretches that end where a pre-token does, so that of it only the ids are held at once.
        """
        if not self.by_word or any(" " in a for a in self.added) or max(map(len, texts), default=0) <= STRETCH:
            return self._encoded(texts)
        found = [[self._encoded([s])[0] for s in stretches(t)] for t in texts]
        return np.concatenate([x for f in found for x in f]), np.array([sum(map(len, f)) for f in found], np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > MEMO:
            self.forget()
        whole, plain = {}, []
        for k, t in enumerate(texts):
            if self.by_word and SAFE.fullmatch(t) and not any(a in t for a in self.added):
                plain.append(k)
            else:
                whole[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        flat = "".join(texts[k] for k in plain)
        points = code_points(flat)
        sizes = np.array([len(texts[k]) for k in plain], np.int64)
        edges = np.cumsum(sizes) - sizes
        start = pre_tokens(points, edges[sizes > 0])
        size = np.diff(np.append(start, len(points)))
        which, new = self.words.number(points, start, size)
        if len(new):
            self._learn([flat[a:z] for a, z in zip(start[new].tolist(), (start + size)[new].tolist(), strict=True)])
        first = self.start.of[which]
        n = self.start.of[which + 1] - first
        ids = self.ids.of[ranges(first, n)]
        counts = np.zeros(len(texts), np.int64)
        cut = np.concatenate([[0], np.cumsum(n)])
        counts[plain] = cut[np.searchsorted(start, edges + sizes)] - cut[np.searchsorted(start, edges)]
        if not whole:
            return ids, counts
        upto = np.cumsum(counts)
        parts = [whole[k] if k in whole else ids[upto[k] - counts[k] : upto[k]] for k in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_encoders = cache_of_worker()


def encoder(path: str) -> Encoder:
    """One per worker process and tokenizer."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _packed(rows: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of each row's numbers as the row's bytes: 64 numbers fill w words of 64 bits."""
    k, n = rows.shape
    groups = -(-n // 64)
    x = np.zeros((k, groups * 64), np.uint64)
    x[:, :n] = rows & np.uint32((1 << w) - 1)
    x = np.ascontiguousarray(x.reshape(k * groups, 64).T)
    out = np.zeros((w + 1, k * groups), np.uint64)
    for j in range(64):
        at, shift = divmod(j * w, 64)
        out[at] |= x[j] << np.uint64(shift)
        if shift + w > 64:
            out[at + 1] |= x[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out[:w].T).astype("<u8").view(np.uint8).reshape(k, groups * w * 8)[:, : (n * w + 7) // 8]


def _unpacked(rows: np.ndarray, n: int, w: int) -> np.ndarray:
    """The n numbers of w bits that each row of bytes holds."""
    k, groups = len(rows), -(-n // 64)
    raw = np.zeros((k, groups * w * 8), np.uint8)
    raw[:, : rows.shape[1]] = rows
    words = np.zeros((w + 1, k * groups), np.uint64)
    words[:w] = raw.view("<u8").reshape(k * groups, w).T
    out = np.empty((64, k * groups), np.uint32)
    for j in range(64):
        at, shift = divmod(j * w, 64)
        x = words[at] >> np.uint64(shift)
        if shift + w > 64:
            x |= words[at + 1] << np.uint64(64 - shift)
        out[j] = x & np.uint64((1 << w) - 1)
    return np.ascontiguousarray(out.T).reshape(k, groups * 64)[:, :n]


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of ids; all are full but perhaps the last."""
    out: list[bytes] = [b""] * (len(ids) // BLOCK + (len(ids) % BLOCK > 0))
    for first, rows in ((0, ids[: len(ids) // BLOCK * BLOCK].reshape(-1, BLOCK)), (len(ids) // BLOCK, ids[len(ids) // BLOCK * BLOCK :].reshape(1, -1))):
        if not rows.size:
            continue
        n = rows.shape[1]
        least = rows.min(axis=1)
        far = rows - least[:, None]
        at = np.partition(far, int(percentile * (n - 1)), axis=1)[:, int(percentile * (n - 1))]
        width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            part = far[own]
            packed = _packed(part, int(w))
            high = part >> np.uint32(w) if w < 32 else np.zeros_like(part)
            for k, b in enumerate(own):
                spots = np.flatnonzero(high[k])
                head = int(least[b]).to_bytes(4, "little") + n.to_bytes(2, "little") + bytes([w, 0]) + len(spots).to_bytes(2, "little")
                out[first + b] = head + packed[k].tobytes() + spots.astype("<u2").tobytes() + high[k, spots].astype("<u4").tobytes()
    return out


def unpack(data: bytes | memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at these bytes of data."""
    parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(starts)
    kinds: dict[tuple[int, int], list[int]] = {}
    for k, s in enumerate(starts):
        kinds.setdefault((data[s + 6], int.from_bytes(data[s + 4 : s + 6], "little")), []).append(k)
    for (w, n), own in kinds.items():
        size = (n * w + 7) // 8
        rows = np.stack([np.frombuffer(data, np.uint8, size, starts[k] + 10) for k in own])
        ids = _unpacked(rows, n, w)
        for row, k in zip(ids, own, strict=True):
            s = starts[k]
            m = int.from_bytes(data[s + 8 : s + 10], "little")
            if m:
                at = np.frombuffer(data, "<u2", m, s + 10 + size)
                row[at] |= np.frombuffer(data, "<u4", m, s + 10 + size + 2 * m) << np.uint32(w)
            parts[k] = row + np.uint32(int.from_bytes(data[s : s + 4], "little"))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Shard:
    """Writes one file, a chunk of blocks at a time."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC.to_bytes(8, "little"))
        self.at, self.n, self.rest = 8, 0, np.zeros(0, np.uint32)
        self.starts: list[int] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, doc: np.ndarray, null: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append((doc, null, counts))
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        if len(self.rest) >= CHUNK:
            full = len(self.rest) // BLOCK * BLOCK
            for k in range(0, full, CHUNK):
                self._write(self.rest[k : min(k + CHUNK, full)])
            self.rest = self.rest[full:]

    def _write(self, ids: np.ndarray) -> None:
        blocks = pack(ids)
        for b in blocks:
            self.starts.append(self.at)
            self.at += len(b)
        self.out.write(b"".join(blocks))

    def close(self) -> tuple[int, int, int]:
        self._write(self.rest)
        doc, null, counts = (np.concatenate(x) if self.docs else np.zeros(0, np.int64) for x in (list(zip(*self.docs, strict=True)) or [[], [], []]))
        index = np.array(self.starts, "<u8").tobytes()
        rows = doc.astype("<i8").tobytes() + null.astype("u1").tobytes() + counts.astype("<u4").tobytes()
        self.out.write(index + rows)
        foot = (self.n, len(self.starts), len(doc), self.at, self.at + len(index), MAGIC)
        self.out.write(b"".join(x.to_bytes(8, "little") for x in foot))
        self.out.close()
        return len(doc), self.n, self.at + len(index) + len(rows) + 48


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts to shards in folder; returns the written manifest: shard, path, n_docs, n_tokens, bytes.

    Documents stand in order of id, null ids first, equal ids by their text's hash, over all shards in turn. A null text
    is an empty one; end_id, if any, follows each document. Each attempt of a task writes a file of its own name; the
    manifest, which Spark commits, names those that count. Empty input: shards without documents. Other columns are
    ignored.
    """
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(_encoders)
        k = TaskContext.get().partitionId()
        uri = f"{folder}/ids-{k:05d}-{uuid.uuid4().hex}.pfor"
        shard, encode = Shard(uri), encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, 1, TEXTS, BYTES):
                ids, counts = encode(part.column(1).to_pylist())
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                    counts = counts + 1
                own = part.column(0)
                shard.add(ids, own.fill_null(0).to_numpy(zero_copy_only=False), own.is_null().to_numpy(zero_copy_only=False), counts)
        n_docs, n_ids, size = shard.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "path": [uri], "n_docs": [n_docs], "n_tokens": [n_ids], "bytes": [size]})

    return written(rows.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long, bytes long"), "manifest")


def read_shard(uri: str) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """Each document of a shard: its id, and its ids in one or more parts, of which few are in memory at once."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        n, n_blocks, n_docs, index_at, docs_at, magic = (int(x) for x in np.frombuffer(f.read_at(48, size - 48), "<u8"))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard of token ids")
        starts = np.frombuffer(f.read_at(8 * n_blocks, index_at), "<u8").astype(np.int64)
        rows = f.read_at(13 * n_docs, docs_at)
        doc, null, counts = np.frombuffer(rows, "<i8", n_docs), np.frombuffer(rows, "u1", n_docs, 8 * n_docs), np.frombuffer(rows, "<u4", n_docs, 9 * n_docs)
        ends = np.append(starts, index_at)
        held, used, block = np.zeros(0, np.uint32), 0, 0
        for d, is_null, count in zip(doc.tolist(), null.tolist(), counts.tolist(), strict=True):
            parts, left = [], count
            while left or not parts:
                if used == len(held) and block < n_blocks:
                    upto = min(block + AT_ONCE, n_blocks)
                    data = f.read_at(int(ends[upto] - ends[block]), int(ends[block]))
                    held, used, block = unpack(data, starts[block:upto] - starts[block]), 0, upto
                take = min(left, len(held) - used)
                parts.append(held[used : used + take])
                used += take
                left -= take
            yield (None if is_null else d), parts


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, from the files: start counts all ids before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    rows = rows.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32())])
        for batch in batches:
            for row in batch.to_pylist():
                out, start = [], row["start"]
                for doc, parts in read_shard(row["path"]):
                    crc, n = 0, 0
                    for p in parts:
                        crc, n = zlib.crc32(p.astype("<u4").tobytes(), crc), n + len(p)
                    out.append((doc, start, n, crc, row["shard"]))
                    start += n
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kind.types, strict=True)], schema=kind)

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_ids(docs, scratch(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(manifest)
