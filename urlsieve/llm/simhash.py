"""SimHash near-duplicates: balls of half the radius around each fingerprint meet in the middle."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm.common import WORD, components, keep_least, scope, slices, take_worker, written

#: Words a shingle, differing bits of a link, seed of the hash.
SHINGLE, RADIUS, SEED = 4, 4, 42
#: Rounds over parts of the variants' space, each of which shuffles its part and frees it; fingerprints expanded at once.
ROUNDS, AT_ONCE = 5, 256
#: Variants that a task of a round sorts, 10 bytes each, as their hash deals them: tasks grow in number, not in size.
TASK = 1_200_000
#: Texts and bytes hashed at once.
TEXTS, BYTES = 512, 1 << 20
#: Shingles whose bits are counted at once.
CHUNK = 1 << 17

_WORDS = re.compile(WORD.encode())
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of the text with A-Z lower-cased, as u64; empty for a text without words."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:z], SEED) for a, z in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """A fingerprint per array of hashes: the bits set in over half of them; zero without any."""
    n = np.array([len(h) for h in hashes], np.int64)
    counts = np.zeros((len(hashes), 64), np.int64)
    flat, ends, at = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.cumsum(n), 0
    while at < len(flat):
        upto = min(at + CHUNK, len(flat))
        first, last = np.searchsorted(ends, [at, upto - 1], side="right")
        bits = np.unpackbits(flat[at:upto].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = np.arange(first, last + 1)
        own = own[n[own] > 0]
        edges = np.maximum(ends[own] - n[own], at) - at
        counts[own] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
        at = upto
    return np.packbits(2 * counts > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. With `hashed`, (doc_id, th, fp): th is the text's hash."""
    names = ["doc_id", *["th"] * hashed, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker()
        for batch in batches:
            for part in slices(batch, 1, TEXTS, BYTES):
                fp = majority([shingle_hashes(t, size) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(fp.view(np.int64))], names)

    th = [F.xxhash64(text_col).alias("th")] * hashed
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *th).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def masks(half: int) -> np.ndarray:
    """All differences of up to `half` bits, as u64."""
    return np.array([sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(64), k)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of the same components as the edges a-b, one for each node but the roots."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    top = np.array([find(x) for x in range(len(names))], np.int64)
    away = np.flatnonzero(top != np.arange(len(names)))
    return names[away], names[top[away]]


def collisions(variants: np.ndarray, owners: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between owners of equal variants, each to the least owner there, once each and verified.

    Two owners of one variant are each within half the radius of it, so all links to the least one hold and join the
    same owners as all pairs would.
    """
    order = np.lexsort((owners, variants))
    v, o = variants[order], owners[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    first = o[np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))]
    hit = o != first
    pairs = np.unique(np.stack([o[hit], first[hit]], axis=1), axis=0)
    apart = np.unpackbits((pairs[:, 0] ^ pairs[:, 1]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
    pairs = pairs[apart <= radius]
    return pairs[:, 0], pairs[:, 1]


def _forget(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of rounds that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def links(fps: DataFrame, radius: int = RADIUS, rounds: int = ROUNDS, task: int = TASK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough to join all that differ in `radius` bits or fewer.

    Each fingerprint emits every variant within radius / 2 bits; variants are dealt out by their hash as packed rows, and
    equal ones meet. A round takes one part of the hash's range, so that only that part is on disk at a time; the number
    of its tasks follows from the number of fingerprints, so that each has about `task` variants. Each task reduces its
    links to a forest.
    """
    spark = fps.sparkSession
    ball = masks(radius // 2)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scope(spark) as keep:
        spread = written(fps.select("fp").distinct(), "fps")
        parts = max(few, -(-spread.count() * len(ball) // (rounds * task)))
        # expanded by about as many tasks as there are to sort, each a share of the fingerprints
        spread = spread.repartition(parts, "fp")

        def emit(which: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                take_worker()
                for batch in batches:
                    for at in range(0, batch.num_rows, AT_ONCE):
                        fp = batch.column(0).slice(at, AT_ONCE).to_numpy(zero_copy_only=False).view(np.uint64)
                        v = (fp[:, None] ^ ball[None, :]).ravel()
                        h = _mixed(v)
                        own = np.flatnonzero(h % np.uint64(rounds) == which)
                        to = ((h[own] >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
                        order = np.argsort(to, kind="stable")
                        own, to = own[order], to[order]
                        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
                        packed, mask = v[own].astype("<u8"), (own % len(ball)).astype("<u2")
                        ends = np.append(cut[1:], len(own))
                        yield pa.RecordBatch.from_pydict({"part": to[cut], "variants": pa.array([packed[s:e].tobytes() for s, e in zip(cut, ends, strict=True)], pa.binary()), "masks": pa.array([mask[s:e].tobytes() for s, e in zip(cut, ends, strict=True)], pa.binary())})

            return run

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take_worker()
            vs, ms = [], []
            for batch in batches:
                vs += [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(1)]
                ms += [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(2)]
            if vs:
                v = np.concatenate(vs)
                del vs
                owner = v ^ ball[np.concatenate(ms)]
                del ms
                a, b = forest(*collisions(v, owner, radius))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        found = None
        for k in range(rounds):
            # a part is a partition: none has two of them
            part = spread.mapInArrow(emit(k), "part int, variants binary, masks binary").repartitionById(parts, "part").mapInArrow(meet, "a long, b long")
            part = written(part.distinct(), "links")
            found = part if found is None else found.union(part)
            _forget(spark)
        found = keep(written(found.distinct(), "links"))
        _forget(spark)  # on a cluster the last round's files are held until another query has run
        return found


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest id among documents that links reach.

    Texts without a word, null or empty, have fingerprint zero and are linked like any other. Equal fingerprints are one
    node. Null ids are kept, and are a component's id only if all its ids are null. Repeated rows each get a row. Empty
    input gives no rows. Extra columns are ignored.

    A node's name begins with its smallest id, so that the smallest name in a component holds the component's: nothing is
    dealt out by component, of which one may hold most nodes.
    """
    spark = docs.sparkSession
    with scope(spark) as keep:
        prints = keep(written(fingerprints(docs, size, id_col, text_col), "prints"))
        nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
        name = F.struct(F.col("least").isNull().alias("none"), "least", "fp")
        near = links(nodes, radius)
        ends = nodes.select(F.col("fp").alias("a"), name.alias("x")), nodes.select(F.col("fp").alias("b"), name.alias("y"))
        joined = components(near.join(ends[0], "a").join(ends[1], "b"), "x", "y")
        named = nodes.join(joined.select(F.col("node.fp").alias("fp"), "component"), "fp", "left")
        named = keep(written(named.select("fp", F.coalesce("component", name)["least"].alias("component_id")), "named"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each component, the least by id (null last) and text hash.

    Components are told apart by their least fingerprint, which is never null, so null or repeated ids cost no row.
    """
    with scope(docs.sparkSession) as keep:
        prints = written(fingerprints(docs, size, id_col, text_col, hashed=True), "prints")
        joined = components(links(prints.select("fp"), radius))
        named = prints.join(joined, prints["fp"] == joined["node"], "left").select("doc_id", "th", F.coalesce("component", "fp").alias("group"))
        named = keep(written(named, "groups"))
    return keep_least(docs, named, id_col, text_col)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
