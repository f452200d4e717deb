"""Near-duplicates by Jaccard similarity of word shingles: SimHash and banded MinHash find candidates, their shingles decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.llm.common import components, keep_least, quoted, scope, slices, take_worker, written
from urlsieve.llm.simhash import SEED, links, majority, shingle_hashes

#: Words a shingle, and the similarity from which two texts are linked.
SHINGLE, LEAST = 5, 0.8
#: Bands and minima in each: texts of similarity s share a band with probability 1 - (1 - s^5)^20, 0.9996 at 0.8.
BANDS, WIDTH = 20, 5
#: Shingles whose minima are taken at once.
CHUNK = 2048
#: Texts and bytes hashed at once.
TEXTS, BYTES = 256, 1 << 19
#: Rounds of the SimHash links, more than op5 takes: Spark's cleaner may drop a round's shuffle files only when the next one's are
#: there, and this stage has tables of its own, and what is left of the stage before, on disk beside them.
ROUNDS = 10

_rng = np.random.default_rng(SEED)
_ADD = _rng.integers(0, 1 << 64, (BANDS * WIDTH, 1), np.uint64)
_TIMES = _rng.integers(0, 1 << 64, (BANDS * WIDTH, 1), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed hash for each band of a set of shingles; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, ((hashes[at : at + CHUNK][None, :] ^ _ADD) * _TIMES).min(axis=1))
    rows = least.astype("<u8").tobytes()
    return [xxhash.xxh64_intdigest(rows[k * WIDTH * 8 : (k + 1) * WIDTH * 8], k) - (1 << 63) for k in range(BANDS)]


def _prints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, th, node, fp, bands): node is a hash of the set of shingles, so that equal sets are one node; fp the SimHash of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker()
        for batch in batches:
            for part in slices(batch, 2, TEXTS, BYTES):
                hashes = [shingle_hashes(t, size) for t in part.column(2).to_pylist()]
                sets = [np.unique(h) for h in hashes]
                node = pa.array([xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), node, pa.array(majority(hashes).view(np.int64)), pa.array([bands(x) for x in sets], pa.list_(pa.int64()))], ["doc_id", "th", "node", "fp", "bands"])

    return docs.mapInArrow(run, "doc_id long, th long, node long, fp long, bands array<long>")


def _sets(wanted: DataFrame, keyed: DataFrame, rep: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the nodes wanted, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker()
        for batch in batches:
            for part in slices(batch, 1, TEXTS, BYTES):
                sets = [shingle_set(t, size).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    spots = rep.join(wanted, "node", "left_semi")
    texts = keyed.join(spots, keyed["doc_id"].eqNullSafe(spots["_id"]) & (keyed["th"] == spots["_th"])).select("node", "text").dropDuplicates(["node"])
    return written(texts.mapInArrow(run, "node long, shingles array<long>"), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have at least this similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(least) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _across(named: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of nodes in different groups that can have at least this similarity; named is (node, group).

    Sets that similar share one of the rarest shingles of each, as the others are too few: of n shingles the first
    n - ceil(least n) + 1 in order of how many sets hold them. Nothing is left out, and sets that only common shingles
    make alike don't meet.
    """
    every = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    every = every.join(every.groupBy("s").agg(F.count("*").alias("df")), "s")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "s"))
    rare = every.withColumn("rank", rank).where((F.col("rank") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1) & (F.col("df") > 1))
    rare = written(rare.join(named, "node").select("node", "n", "s", "group"), "rare")
    other = rare.select("s", F.col("node").alias("b"), F.col("n").alias("m"), F.col("group").alias("other"))
    alike = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - 1e-9
    return rare.join(other, "s").where((F.col("group") != F.col("other")) & (F.col("node") > F.col("b")) & alike).select(F.col("node").alias("a"), "b").distinct()


def groups(docs: DataFrame, size: int = SHINGLE, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, group) per row: texts that links of at least this similarity join are in one group; th is the text's hash.

    Texts without a word have the empty set and are one group. Buckets are texts whose SimHash fingerprints links of op5's
    radius join, and texts of one band. In each bucket all are first held against the least one; then those of buckets
    that are not one group by then are held against all others that share one of their rarest shingles, without which
    they can't be similar. So each pair of a bucket is in one group, has been compared or can't be linked. Only pairs that
    share no bucket are never compared.
    """
    keyed = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(quoted(text_col)).alias("th"), F.col(quoted(text_col)).cast("string").alias("text"))
    with scope(docs.sparkSession) as keep:
        prints = written(_prints(keyed, size), "prints")
        spot = F.struct(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
        rep = written(prints.groupBy("node").agg(F.min(spot).alias("k")).select("node", "k._id", "k._th"), "nodes")
        near = components(links(prints.select("fp"), rounds=ROUNDS))
        alike = prints.select("node", "fp").join(near.select(F.col("node").alias("fp"), "component"), "fp", "left")
        alike = alike.select("node", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("band"))
        buckets = written(prints.select("node", F.explode("bands").alias("band")).union(alike).distinct(), "buckets")

        ends = buckets.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b != top").select("band", "b")
        star = written(buckets.join(ends, "band").where("node != b").select(F.col("node").alias("a"), "b").distinct(), "candidates")
        ends = star.select(F.col("a").alias("node")).union(star.select(F.col("b").alias("node"))).distinct()
        first = written(_verified(star, _sets(ends, keyed, rep, size), least), "links")

        part = components(first)
        named = buckets.join(part, "node", "left").select("band", "node", F.coalesce("component", "node").alias("group"))
        mixed = named.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low != high").select("band")
        named = written(named.join(mixed, "band", "left_semi").select("node", "group").distinct(), "apart")
        sets = _sets(named.select("node"), keyed, rep, size)
        pairs = written(_across(named, sets, least).join(star, ["a", "b"], "left_anti"), "candidates")
        second = written(_verified(pairs, sets, least), "links")

        part = components(first.union(second))
        rows = prints.select("doc_id", "th", F.col("node").alias("_node")).join(part, F.col("_node") == part["node"], "left")
        return keep(written(rows.select("doc_id", "th", F.coalesce("component", "_node").alias("group")), "groups"))


def keep_one(docs: DataFrame, size: int = SHINGLE, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each group of near-duplicates, the least by id (null last) and text hash.

    Null and empty texts, and others without a word, are one group. Of repeated rows one stays. An empty table gives no
    rows. Other columns may have any names.
    """
    return keep_least(docs, groups(docs, size, least, id_col, text_col), id_col, text_col)
