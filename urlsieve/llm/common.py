"""What the operators of this subpackage share: words, written intermediate tables, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"


#: What operators remember in a Python worker, by operator.
_CACHES: list[dict] = []


def cache_of_worker() -> dict:
    """A dictionary for what one operator remembers in a worker process; see take_worker()."""
    _CACHES.append({})
    return _CACHES[-1]


def take_worker(cache: dict | None = None) -> None:
    """To be called as a task starts: a worker, which Spark reuses, keeps the memory of one operator at a time.

    What earlier tasks freed goes back to the system, as else it would count against the executor for as long as the
    worker lives.
    """
    for other in _CACHES:
        if other is not cache:
            other.clear()
    pa.default_memory_pool().release_unused()
    if _trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        _trim(0)


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each of so many rows and bytes of a string or binary column at most, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        before = int(ends[at - 1]) if at else 0
        upto = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, upto - at)
        at = upto


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of this machine, in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        current = context.getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            folder = "file://" + tempfile.mkdtemp(prefix="urlsieve-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/urlsieve/{name}-{uuid.uuid4().hex}"


#: Where written tables are, and those of the scopes that are open, the innermost last.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: later reads need no lineage, and survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    for own in _SCOPES.get()[-1:]:
        own.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


@contextmanager
def dealt(df: DataFrame, key: str, parts: int) -> Iterator[DataFrame]:
    """df as a table in the shared folder, in so many buckets by key: joins on the key don't shuffle it. It goes at the end."""
    spark, path, name = df.sparkSession, scratch(df.sparkSession, "dealt"), f"urlsieve_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).option("compression", "uncompressed").bucketBy(parts, key).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove(spark, [path])


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables, through Hadoop's file system, that nothing will read again."""
    gone = {_PATHS[t] for t in tables}
    remove(spark, gone)
    for own in _SCOPES.get():
        own[:] = [p for p in own if p not in gone]


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes files or folders through Hadoop's file system."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at its end, but for written ones given to keep(): those pass to the scope around it.

    So only written tables may leave it. A failure deletes nothing.
    """
    own: list[str] = []
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(_PATHS[table])
        return table

    outer = _SCOPES.get()
    token = _SCOPES.set((*outer, own))
    try:
        yield keep
    finally:
        _SCOPES.reset(token)
    remove(spark, [p for p in own if p not in kept])
    for around in outer[-1:]:
        around += kept


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name for F.col(), whatever characters are in it."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component being the smallest node reachable.

    Alternates large-star and small-star steps; each is one aggregation with map-side combining and one join whose
    other side has a row per node, so that a hub's edges are split by AQE's skew join. Each step is written to the
    shared folder. Nodes that no edge between different nodes names are not returned. Nulls are dropped.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    mark = F.struct(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias("h"))
    now = _step(None, pair.distinct(), "edges")
    seen = now.agg(mark.alias("m")).first().m
    while seen.n:
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _step(now, both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: u and its smaller neighbours are linked to the smallest of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()
        now = _step(large, small, "small")
        last, seen = seen, now.agg(mark.alias("m")).first().m
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _step(before: DataFrame | None, df: DataFrame, name: str) -> DataFrame:
    """df written, after which the table that it was made from goes."""
    out = written(df, name)
    if before is not None:
        drop(df.sparkSession, before)
    return out


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def keep_least(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each group: that of the least id (null last) and text hash; of rows equal in both, the least by hash.

    groups is (doc_id, th, group), th being the text's xxhash64; rows equal in id and text are in one group. Both steps
    are aggregates with map-side combining. Other columns may have any names; maps and variants among them don't count
    in the last choice.
    """
    keep, th, one, h, row = free(docs, "_keep", "_th", "_id", "_hash", "_row")
    key = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")
    best = groups.groupBy("group").agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias(keep), F.col("k.th").alias(th))
    kept = docs.join(best, docs[quoted(id_col)].cast("long").eqNullSafe(F.col(keep)) & (F.xxhash64(docs[quoted(text_col)]) == F.col(th)), "left_semi")
    ids = [F.col(quoted(f.name)) for f in docs.schema if _hashable(f.dataType)]
    least = F.min_by(F.struct(*[F.col(quoted(c)) for c in docs.columns]), F.xxhash64(*ids)).alias(row)
    return kept.groupBy(F.col(quoted(id_col)).alias(one), F.xxhash64(quoted(text_col)).alias(h)).agg(least).select(f"{row}.*")
