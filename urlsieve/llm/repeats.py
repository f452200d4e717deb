"""Removing byte strings of a given width that a document of smaller id holds, too, by suffix order and common prefixes.

Documents are packed into chunks. Of each window of WIDTH bytes the least of its seeds of SEED bytes by hash, the first among
equals, is chosen, so that equal windows choose equal seeds at equal places. Neighbouring windows with one seed make a string.
Only strings whose seed occurs more than once can hold a repeated window; they are dealt out by seed, equal ones as one.

Strings that share a seed without being equal are a collection, whose Burrows-Wheeler transform, common prefixes and suffix
owners are built column by column: round j puts the suffixes of j symbols of all strings in their places at once, reading the
last round's columns from files and writing the next one's. The seed, equal by its bytes, is one symbol. Windows whose suffixes
stand side by side with common prefixes of a whole window are equal, and each learns the smallest id among them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm.common import dealt, remove, scope, scratch, take_worker, written
from urlsieve.llm.runs import mix, ranges

#: Bytes of a window and of a seed; bytes on either side of a seed that a string of its windows can have; columns of a string.
WIDTH, SEED = 50, 20
SIDE = WIDTH - SEED
COLUMNS = WIDTH + SIDE
#: Symbols of a window: its bytes beside the seed, and the seed.
SYMBOLS = SIDE + 1
#: Bytes in a chunk, but for longer documents; windows looked through, and strings gathered, at once.
CHUNK, AT_ONCE = 8 << 20, 1 << 16
#: Seeds in a range of hashes, strings in a range, strings in a collection but for one seed's.
SEEDS, STRINGS, TOGETHER = 500_000, 50_000, 1 << 15
#: Occurrences of a seed over which its windows are dealt out one by one, by their own bytes, so that no task gets them all.
HOT = 1 << 16
#: The id that stands for none.
NONE = -(2**63)
ODD = np.uint64(0x9E3779B97F4A7C15)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays' bytes one after another, compressed behind their number."""
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def restored(data: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Arrays of these kinds and sizes; a size of -1 takes the rest."""
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b""
    out, at = [], 0
    for kind, n in kinds:
        n = (len(raw) - at) // np.dtype(kind).itemsize if n < 0 else n
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def chosen(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, seed, count): runs of windows that choose one seed, by the first window's place, the seed's and their number.

    Documents end at `ends`; no window crosses an end.
    """
    n = len(text) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    found = []
    for s in range(0, n, AT_ONCE):
        z = min(s + AT_ONCE, n)
        part = text[s : z + WIDTH - 1].astype(np.uint32)
        # hashes of 2, 4, 8, 16 bytes, then of 20
        by, size, four = part * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15), 1, None
        while size < 16:
            by = (by[:-size] ^ (by[:-size] >> np.uint32(13))) * np.uint32(0x85EBCA6B) + by[size:]
            size *= 2
            four = by if size == SEED - 16 else four
        by = (by[: len(part) - SEED + 1] * np.uint32(0xC2B2AE35)) ^ four[16 : 16 + len(part) - SEED + 1] * np.uint32(0x27D4EB2F)
        by = (by ^ (by >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        least = (by ^ (by >> np.uint32(12))).astype(np.uint64) << np.uint64(32) | np.arange(len(by), dtype=np.uint64)
        cover = 1
        while cover < SIDE + 1:
            far = min(cover, SIDE + 1 - cover)
            least = np.minimum(least[:-far], least[far:])
            cover += far
        seed = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + s
        # windows inside documents
        low, high = np.searchsorted(ends, s, side="right"), np.searchsorted(starts, z)
        step = np.zeros(z - s + 1, np.int32)
        a = np.clip(starts[low:high], s, z) - s
        np.add.at(step, a, 1)
        np.add.at(step, np.maximum(np.clip(ends[low:high] - WIDTH + 1, s, z) - s, a), -1)
        at = np.flatnonzero(np.cumsum(step[:-1]))
        if not len(at):
            continue
        seed = seed[at]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (seed[1:] != seed[:-1])]))
        found.append((at[first] + s, seed[first], np.diff(np.append(first, len(at)))))
    return tuple(np.concatenate([x[c] for x in found]) if found else np.zeros(0, np.int64) for c in range(3))


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    return np.ndarray((max(len(text) - 7, 0),), "<u8", text, strides=(1,))[at]


def seed_hashes(text: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return mix(mix(_words(text, seed) + ODD) ^ mix(_words(text, seed + 8) * ODD) * np.uint64(3) ^ (_words(text, seed + SEED - 8) >> np.uint64(32)) * ODD)


def _pack(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of chunk, docs, n_docs, text, seeds, n_seeds."""
    number = TaskContext.get().partitionId() << 32

    def packed(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(t for _, t in held), np.uint8)
        sizes = np.array([len(t) for _, t in held], np.int64)
        first, seed, count = chosen(text, np.cumsum(sizes))
        gap = first - np.concatenate([[0], (first + count)[:-1]]) if len(first) else first
        seeds = squeezed(gap.astype("<u4"), (seed - first).astype(np.uint8), count.astype(np.uint8))
        docs = squeezed(np.array([d for d, _ in held], "<i8"), sizes)
        return pa.RecordBatch.from_pydict({"chunk": [number], "docs": [docs], "n_docs": pa.array([len(held)], pa.int32()), "text": [squeezed(text)], "seeds": [seeds], "n_seeds": pa.array([len(first)], pa.int32())})

    held, n = [], 0
    for batch in batches:
        for d, t in zip(*(batch.column(c) for c in (0, 1)), strict=True):
            held.append((NONE if d.as_py() is None else d.as_py(), (t.as_py() or "").encode("utf-8", "surrogatepass")))
            n += len(held[-1][1])
            if n >= size:
                yield packed(held)
                held, n, number = [], 0, number + 1
    if held:
        yield packed(held)


class Chunk:
    """A row of the table of chunks."""

    def __init__(self, row: dict):
        self.docs, sizes = restored(row["docs"], ("<i8", row["n_docs"]), ("<i8", row["n_docs"]))
        self.ends = np.cumsum(sizes)
        (self.text,) = restored(row["text"], ("u1", -1))
        n = row["n_seeds"]
        gap, offset, count = restored(row["seeds"], ("<u4", n), ("u1", n), ("u1", n))
        self.count = count.astype(np.int64)
        self.first = np.cumsum(gap.astype(np.int64)) + np.cumsum(self.count) - self.count
        self.seed = self.first + offset
        self.hash, self.of = np.unique(seed_hashes(self.text, self.seed), return_inverse=True) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def strings(self, found: list[dict] | None) -> Strings:
        """The strings whose seeds are marked as found more than once, by ranges of their hashes."""
        found = sorted(found or [], key=lambda x: x["range"])
        again, hot = (np.concatenate([np.unpackbits(np.frombuffer(x[c], np.uint8), count=x["n"]) for x in found]).astype(bool) if found else np.zeros(0, bool) for c in ("again", "hot"))
        return Strings(self, again[self.of], hot[self.of])


class Strings:
    """Occurrences (first window, columns before it, number of windows, document) and the distinct strings among them, sorted by key."""

    def __init__(self, chunk: Chunk, again: np.ndarray, hot: np.ndarray):
        cold, hot = np.flatnonzero(again & ~hot), np.flatnonzero(again & hot)
        self.chunk = chunk
        self.first = np.concatenate([chunk.first[cold], ranges(chunk.first[hot], chunk.count[hot])])
        self.count = np.concatenate([chunk.count[cold], np.ones(len(self.first) - len(cold), np.int64)])
        seed = np.concatenate([chunk.seed[cold], np.repeat(chunk.seed[hot], chunk.count[hot])])
        self.column = SIDE - (seed - self.first)
        self.doc = chunk.docs[np.searchsorted(chunk.ends, self.first, side="right")] if len(self.first) else np.zeros(0, np.int64)
        hashes = [row_hashes(self.rows(s), self.column[s], self.count[s]) for s in self.slices(np.arange(len(self.first)))]
        one, two = (np.concatenate([h[c] for h in hashes]) if hashes else np.zeros(0, np.uint64) for c in (0, 1))
        key = np.concatenate([chunk.hash[chunk.of[cold]], one[len(cold) :]])
        order, start = distinct(key, one, two)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        self.one, self.key = order[start], key[order[start]]
        self.least = np.minimum.reduceat(self.doc[order], start) if len(start) else np.zeros(0, np.int64)

    @staticmethod
    def slices(of: np.ndarray) -> Iterator[np.ndarray]:
        return (of[s : s + AT_ONCE] for s in range(0, len(of), AT_ONCE))

    def rows(self, of: np.ndarray) -> np.ndarray:
        """Occurrences' bytes by column, zero where they have none."""
        column = np.arange(COLUMNS)
        own = (column >= self.column[of][:, None]) & (column < (self.column + self.count + WIDTH - 1)[of][:, None])
        at = (self.first - self.column)[of][:, None] + column
        return np.where(own, self.chunk.text[np.where(own, at, 0)], np.uint8(0))

    def spelled(self, low: int, high: int) -> bytes:
        """Strings low to high: keys, columns, numbers of windows, least documents, bytes."""
        of, flat = self.one[low:high], []
        for s in self.slices(of):
            size = self.count[s] + WIDTH - 1
            flat.append(self.chunk.text[ranges(self.first[s], size)])
        return squeezed(self.key[low:high], self.column[of].astype(np.uint8), self.count[of].astype(np.uint8), self.least[low:high], *flat)


def row_hashes(rows: np.ndarray, column: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each string's bytes and their columns."""
    words = np.ascontiguousarray(rows).view("<u8")
    one = mix((column * 64 + count).astype(np.uint64) + ODD)
    two = one * ODD
    for c in range(words.shape[1]):
        one = mix(one ^ words[:, c])
        two = (two ^ (two >> np.uint64(29)) ^ words[:, c]) * ODD
    return one, mix(two)


def distinct(key: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by all three, and where in it equal ones start."""
    order = np.lexsort((two, one, key))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (key, one, two):
        new[1:] |= x[order][1:] != x[order][:-1]
    return order, np.flatnonzero(new)


def _by_range(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted hashes: the ranges that have any, and where each starts and ends."""
    of = hashes >> np.uint64(64 - bits)
    start = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    return of[start].astype(np.int64), start, np.append(start, len(of))[1:]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of equal range, which stand together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["range"] != row["range"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def repeated_seeds(chunks: DataFrame, bits: int, hot: int) -> DataFrame:
    """(chunk, range, n, again, hot, n_again): for each of a chunk's n seeds in a range of hashes, in order, whether it occurs again, and over `hot` times."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker()
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                many = np.bincount(chunk.of, minlength=len(chunk.hash))
                low = ((chunk.hash << np.uint64(bits)) >> np.uint64(24)).astype("<u8")
                power = np.ceil(np.log2(np.maximum(many, 1))).astype(np.uint8)
                parts = list(zip(*(x.tolist() for x in _by_range(chunk.hash, bits)), strict=True))
                keys = [low[s:z].view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for _, s, z in parts]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in parts], pa.int32()), pa.array([row["chunk"]] * len(parts), pa.int64()), pa.array(keys, pa.binary()), pa.array([power[s:z].tobytes() for _, s, z in parts], pa.binary())], ["range", "chunk", "keys", "power"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker()
        for rows in _grouped(batches):
            power = np.frombuffer(b"".join(r["power"] for r in rows), np.uint8)
            wide = np.zeros((len(power), 8), np.uint8)
            wide[:, :5] = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, 5)
            _, of = np.unique(wide.view("<u8").ravel(), return_inverse=True)
            total = np.bincount(of, 2.0 ** power)
            again, much = (total >= 2)[of], (total > hot)[of]
            ends = np.cumsum([len(r["power"]) for r in rows]).tolist()
            out = [(r["chunk"], r["range"], z - s, np.packbits(again[s:z]).tobytes(), np.packbits(much[s:z]).tobytes(), int(again[s:z].sum())) for r, s, z in zip(rows, [0, *ends[:-1]], ends, strict=True)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["chunk", "range", "n", "again", "hot", "n_again"])

    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.mapInArrow(send, "range int, chunk long, keys binary, power binary")
    rows = rows.repartition(max(parts, 1 << bits), "range").sortWithinPartitions("range", "chunk")
    return rows.mapInArrow(meet, "chunk long, range int, n int, again binary, hot binary, n_again long")


class Files:
    """A collection's columns, each in a file that a round reads from end to end; what it writes is a new file, and the old one goes."""

    def __init__(self, folder: str):
        self.fs, self.base = pafs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}")
        self.fs.create_dir(self.base, recursive=True)
        self.round: dict[str, int] = {}

    def _path(self, name: str) -> str:
        return f"{self.base}/{name}-{self.round[name]}"

    def write(self, name: str, values: np.ndarray) -> None:
        old = self._path(name) if name in self.round else None
        self.round[name] = self.round.get(name, 0) + 1
        with self.fs.open_output_stream(self._path(name), compression=None, buffer_size=0) as f:
            f.write(values)
        if old:
            self.fs.delete_file(old)

    def read(self, name: str, kind: str) -> np.ndarray:
        with self.fs.open_input_file(self._path(name)) as f:
            return np.frombuffer(f.read_buffer(), kind)

    def close(self) -> None:
        self.fs.delete_dir(self.base)


def suffixes(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, files: Files) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, length, prefix) of the suffixes of `width` symbols or more, in order; prefix: symbols in common with the suffix before, `width` at most.

    Strings are symbols[start : start + size]; symbols are over 0 and under 65,536. Before round j the files hold, in order,
    all suffixes of fewer than j symbols: the symbol before each (0 before a whole string), and the prefix in common with the
    one before. A symbol c before suffix r gives suffix cr, and those stand in order of c, then r. So a stable sort of the
    symbols gives all suffixes of up to j symbols but the empty ones, new ones among the old; a new one's common prefix is one
    more than the least between the two suffixes it and its neighbour come from. Work is the sum of the rounds' symbols.
    """
    n = len(size)
    files.write("before", symbols[start + size - 1].astype("<u2"))
    files.write("prefix", np.zeros(n, np.uint8))
    active, who = np.arange(n), np.arange(n, dtype=np.int32)
    for j in range(1, int(size.max(initial=0)) + 1):
        before, prefix = files.read("before", "<u2"), files.read("prefix", "u1")
        string = np.full(len(before), -1, np.int32)
        string[active] = who
        order = np.argsort(before, kind="stable")[np.count_nonzero(before == 0) :]
        fresh = string[order] >= 0
        new = np.flatnonzero(fresh)
        who = string[order[new]]
        new_before, new_prefix = np.empty(n + len(order), "<u2"), np.empty(n + len(order), np.uint8)
        new_before[:n], new_prefix[:n] = before[:n], 0
        tail, tops = new_before[n:], new_prefix[n:]
        tail[~fresh], tops[~fresh] = before[n:], prefix[n:]
        more = size[who] > j
        tail[new] = np.where(more, symbols[np.where(more, (start + size)[who] - j - 1, 0)], 0)
        # new ones, and old ones that follow a new one, have another neighbour
        moved = np.zeros(len(order) + 1, bool)
        moved[new] = moved[new + 1] = True
        moved = np.flatnonzero(moved[:-1])
        tops[moved] = 0
        moved = moved[moved > 0]
        low, high = order[moved - 1], order[moved]
        same = np.flatnonzero(before[low] == before[high])
        # reduceat() takes no time between ranges whose starts go down
        same = same[np.argsort(low[same])[::-1]]
        spots = np.stack([low[same] + 1, high[same] + 1], axis=1).ravel()
        if len(spots):
            tops[moved[same]] = np.minimum(np.minimum.reduceat(np.append(prefix, 0), spots)[::2] + 1, width)
        files.write("before", new_before)
        files.write("prefix", new_prefix)
        if j >= width:
            owner = np.full(n + len(order), -1, "<i4")
            if j > width:
                owner[n:][~fresh] = files.read("owner", "<i4")[n:]
            owner[n:][new] = who << 6 | j
            files.write("owner", owner)
        active, who = n + new[more], who[more]
    if int(size.max(initial=0)) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    owner, prefix = files.read("owner", "<i4"), files.read("prefix", "u1")
    # common prefixes over suffixes left out
    held = np.flatnonzero(owner >= 0)
    least = np.minimum.reduceat(prefix[: held[-1] + 1], np.append(0, held[:-1] + 1)) if len(held) else prefix[:0]
    return owner[held] >> 6, owner[held] & 63, least


def first_holders(rows: np.ndarray, column: np.ndarray, count: np.ndarray, doc: np.ndarray, folder: str) -> np.ndarray:
    """For each window of each string the least id of those that hold its bytes, from a collection's suffixes."""
    seeds = np.ascontiguousarray(rows[:, SIDE : SIDE + SEED])
    _, seed = np.unique(seeds.view([("a", "<u8"), ("b", "<u8"), ("c", "<u4")]).ravel(), return_inverse=True)
    table = rows.astype(np.uint16) + 1
    table[:, SIDE] = seed.ravel() + 257
    symbol = np.arange(COLUMNS)
    own = (symbol >= column[:, None]) & (symbol < (column + count + WIDTH - 1)[:, None]) & ((symbol <= SIDE) | (symbol >= SIDE + SEED))
    size = own.sum(axis=1)
    files = Files(folder)
    try:
        string, length, prefix = suffixes(table[own], np.cumsum(size) - size, size, SYMBOLS, files)
    finally:
        files.close()
    out = np.repeat(doc[:, None], SIDE + 1, axis=1)
    new = np.flatnonzero(prefix < SYMBOLS)
    if len(string):
        new = np.union1d([0], new)
        least = np.minimum.reduceat(doc[string], new)
        out[string, size[string] - length] = np.repeat(least, np.diff(np.append(new, len(string))))
    return out


def earlier_holders(strings: DataFrame, folder: str) -> DataFrame:
    """(chunk, range, masks): for each of a chunk's strings in a range, a bit for each window that a smaller id than the chunk's least for the string holds."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker()
        for parts in _grouped(batches):
            held = [restored(r["strings"], ("<u8", r["n"]), ("u1", r["n"]), ("u1", r["n"]), ("<i8", r["n"]), ("u1", -1)) for r in parts]
            key, column, count, doc, flat = (np.concatenate([h[c] for h in held]) for c in range(5))
            column, count = column.astype(np.int64), count.astype(np.int64)
            size = count + WIDTH - 1
            rows = np.zeros((len(key), COLUMNS), np.uint8)
            rows[np.repeat(np.arange(len(key)), size), ranges(column, size)] = flat
            order, start = distinct(key, *row_hashes(rows, column, count))
            of = np.empty(len(order), np.int64)
            of[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
            least = np.minimum.reduceat(doc[order], start)
            one = order[start]
            # strings of seeds that have more than one go into collections of about TOGETHER
            seed = np.flatnonzero(np.append(True, key[one][1:] != key[one][:-1]))
            many = np.diff(np.append(seed, len(one)))
            mask = np.where(least[of] < doc, (np.int64(1) << count) - 1, 0)
            several = np.flatnonzero(np.repeat(many > 1, many))
            edge = np.append(np.flatnonzero(np.append(True, key[one][several][1:] != key[one][several][:-1])), len(several))
            at = 0
            while at < len(several):
                upto = int(edge[max(np.searchsorted(edge, at + TOGETHER, side="right") - 1, np.searchsorted(edge, at, side="right"))])
                own = several[at:upto]
                o = one[own]
                holders = first_holders(rows[o], column[o], count[o], least[own], folder)
                place = np.full(len(one), -1, np.int64)
                place[own] = np.arange(len(own))
                these = np.flatnonzero(place[of] >= 0)
                smaller = (holders[place[of[these]]] < doc[these][:, None]) & (np.arange(SIDE + 1) < count[these][:, None])
                mask[these] = smaller @ (np.int64(1) << np.arange(SIDE + 1))
                at = upto
            ends = np.cumsum([r["n"] for r in parts]).tolist()
            out = [(r["chunk"], r["range"], r["n"], squeezed(mask[s:z].astype("<u4"))) for r, s, z in zip(parts, [0, *ends[:-1]], ends, strict=True) if mask[s:z].any()]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["chunk", "range", "n", "masks"])

    return strings.mapInArrow(meet, "chunk long, range int, n int, masks binary")


CHUNK_COLUMNS = ["chunk", "docs", "n_docs", "text", "seeds", "n_seeds"]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, hot: int = HOT, strings: int = STRINGS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): a written table, a row per row of docs.

    spans: maximal runs [start, end) of bytes of the UTF-8 text that strings of 50 bytes cover which also start in a document
    of smaller id; kept: the other bytes. Strings are judged on the input and never cross documents. Repeats within an id,
    repeated rows among them, stay. A null id is smaller than any other (and so is -2^63, which comes out as null); a null
    text is empty. Other columns are ignored. An empty table gives no rows. A document is in one chunk however long it is.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "columns")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "chunk long, docs binary, n_docs int, text binary, seeds binary, n_seeds int"
    packed = rows.mapInArrow(lambda batches: _pack(batches, chunk), kinds)
    # texts are never shuffled: what is found of a chunk goes to where it is
    with scope(spark) as keep, dealt(packed, "chunk", parts) as chunks:
        n_seeds = chunks.agg(F.sum("n_seeds")).first()[0] or 0
        found = written(repeated_seeds(chunks, _bits(n_seeds, SEEDS), hot), "seeds")
        n_again = found.agg(F.sum("n_again")).first()[0] or 0
        bits = _bits(n_again, strings)
        marks = found.groupBy("chunk").agg(F.collect_list(F.struct("range", "n", "again", "hot")).alias("found"))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take_worker()
            for batch in batches:
                for k in range(batch.num_rows):
                    (row,) = batch.slice(k, 1).to_pylist()
                    own = Chunk(row).strings(row["found"])
                    for r, s, z in zip(*(x.tolist() for x in _by_range(own.key, bits)), strict=True):
                        yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([row["chunk"]]), pa.array([z - s], pa.int32()), pa.array([own.spelled(s, z)], pa.binary())], ["range", "chunk", "n", "strings"])

        sent = chunks.join(marks, "chunk").select(*CHUNK_COLUMNS, "found").mapInArrow(send, "range int, chunk long, n int, strings binary")
        sent = sent.repartition(max(parts, 1 << bits), "range").sortWithinPartitions("range", "chunk")
        holders = written(earlier_holders(sent, folder), "holders")
        masks = holders.groupBy("chunk").agg(F.collect_list(F.struct("range", "n", "masks")).alias("masks"))

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take_worker()
            for batch in batches:
                for k in range(batch.num_rows):
                    (row,) = batch.slice(k, 1).to_pylist()
                    yield from _cut(row, bits)

        every = chunks.join(marks, "chunk", "left").join(masks, "chunk", "left").select(*CHUNK_COLUMNS, "found", "masks")
        out = every.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
        out = keep(written(out, "kept", "zstd"))
    remove(spark, [folder])
    return out


def _bits(n: int, size: int) -> int:
    """The power of two of how many ranges of about `size` hold n; 1 at least."""
    return max(1, (n // size).bit_length())


def _cut(row: dict, bits: int) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk without the windows that its marks and masks name."""
    chunk = Chunk(row)
    own = chunk.strings(row["found"])
    mask = np.zeros(len(own.key), np.int64)
    ranges_, starts, _ = _by_range(own.key, bits)
    spot = dict(zip(ranges_.tolist(), starts.tolist(), strict=True))
    for m in row["masks"] or []:
        s = spot[m["range"]]
        mask[s : s + m["n"]] = restored(m["masks"], ("<u4", m["n"]))[0]
    # a copy of a larger id than the chunk's least goes whole, the least one by its mask
    mask = np.where(own.doc > own.least[own.of], -1, mask[own.of]) if len(own.of) else mask
    gone = np.zeros(len(chunk.text), bool)
    for j in range(SIDE + 1):
        gone[own.first[(own.count > j) & (mask >> j & 1 > 0)] + j] = True
    window = np.flatnonzero(gone)
    doc = np.searchsorted(chunk.ends, window, side="right")
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] > window[:-1] + WIDTH) | (doc[1:] != doc[:-1])
    start = window[new]
    end = window[np.append(np.flatnonzero(new)[1:], len(window)) - 1] + WIDTH if len(window) else start
    first, last = np.searchsorted(start, chunk.ends - np.diff(chunk.ends, prepend=0)), np.searchsorted(start, chunk.ends)
    low = chunk.ends - np.diff(chunk.ends, prepend=0)
    at = 0
    while at < len(chunk.docs):
        upto = at + 1
        while upto < len(chunk.docs) and upto < at + 1024 and chunk.ends[upto] - low[at] < 1 << 20:
            upto += 1
        kept, spans = [], []
        for d in range(at, upto):
            s, z = start[first[d] : last[d]], end[first[d] : last[d]]
            spans.append([{"start": a, "end": b} for a, b in zip((s - low[d]).tolist(), (z - low[d]).tolist(), strict=True)])
            cuts = zip([int(low[d]), *z.tolist()], [*s.tolist(), int(chunk.ends[d])], strict=True)
            kept.append(b"".join(chunk.text[a:b].tobytes() for a, b in cuts))
        ids = chunk.docs[at:upto]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == NONE), pa.array((chunk.ends - low)[at:upto]), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"],
        )
        at = upto


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return rows.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, h, unnest(range(length(h) // 2 - {WIDTH - 1})) AS p FROM t WHERE length(h) >= {2 * WIDTH}),
v AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, {2 * WIDTH}) AS k FROM w),
m AS (SELECT k, min(doc_id) AS least FROM v GROUP BY k HAVING count(*) > 1),
g AS (SELECT v.r, v.p FROM v JOIN m USING (k) WHERE v.doc_id > m.least),
n AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + {WIDTH}, true)::INT AS new FROM g),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS i FROM n),
s AS (SELECT r, min(p) AS a, max(p) + {WIDTH} AS z FROM i GROUP BY r, i),
b AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM s),
c AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS far, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS kept
  FROM b JOIN t USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(far, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN c USING (r)
"""
