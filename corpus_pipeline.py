"""A training corpus from the documents table: five stages, each one operator over all that the stage before kept.

In every stage an empty table gives no rows, and columns beside doc_id, text, source and n_chars may have any names and
pass through, but for the last stage, which has its own. Ties between rows are broken by id and text hash, so that
reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm import linededup, minhash, mixing, passages, pieces, quality
from urlsieve.llm.common import WORD, free, quoted, scope, written

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5
#: Similarity of two sets of shingles from which one of the documents goes.
SIMILARITY = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go; null and empty texts are among them. Repeated rows share a verdict."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line passages, then runs of over 50 words, are cut from all but the first document; one that loses every word goes.

    Rows equal in id and text count as one document and stay, all of them; a null id comes first, a null text stays as it is.
    """
    whole, *new = free(docs, "_whole", "_lines", "_gone", "_spots")
    rows = linededup.dedup_lines(docs, names=tuple(new)).withColumn(whole, F.xxhash64("text"))
    rows = passages.cut_passages(written(rows, "lines"))
    same = (F.col(new[1]) == 0) & (F.xxhash64("text") == F.col(whole))
    rows = rows.where(same | F.col("text").rlike(WORD))
    size = F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in docs.columns else None
    return rows.select(*[size.alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id, null last.

    SimHash links of op5's radius find candidates; as they miss most of similarity 0.8, bands of MinHash find others, and
    exact sets of shingles decide on both. Of repeated rows one stays. Texts without a word are one group.
    """
    return minhash.keep_one(docs, SHINGLE, SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the shares of their weights; a document taken twice is two equal rows. A null source is one of its own, last."""
    return mixing.mixed(docs)


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document as ids, and the text that they decode to; a null text has one, of no pieces."""
    return pieces.sample(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("mixing sources", mix_sources),
    ("sentencepiece", segmentations),
]

#: Fingerprints and sampled segmentations can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scope(spark) as keep:
            docs = keep(written(stage(spark, docs, sf_dir), name.replace(" ", "-")))
    return docs
