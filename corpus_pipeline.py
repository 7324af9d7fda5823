"""The corpus pipeline: quality, line dedup, near-duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each
stage's result and reads it again as the next one's documents. All stages but the
last return the columns of documents.

Defined cases, for every stage: an empty table gives an empty result; repeated
rows, null ids and null sources are rows like others; columns of any name pass
through all stages but the last. Null and empty texts are stated at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from snapgraph import scratch
from snapgraph.llm import bpe, lines, mixing, neardup, quality
from snapgraph.session import ship


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the importance resampling keeps; the target is what the table labels calls good.

    Null and empty texts have log weight 0; without labels of both kinds all stay; equal rows stay or go together.
    """
    ship(spark)
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without lines that stand, much alike, in another place that stays.

    A null text stays null, an empty one empty, with its n_chars; equal rows keep equal lines.
    """
    ship(spark)
    return lines.dedupe(docs)


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates.

    Null texts are one class, empty texts another; of equal rows one stays; null ids come last in a class.
    """
    ship(spark)
    return neardup.dedupe(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have size 0 and are taken as often as their source's rate says; a null source is one of its own.
    """
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of ids and decoded bytes of every row.

    A null text is an empty one: no tokens, the digests of nothing.
    """
    ship(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("lines", dedupe_lines),
    ("near_duplicates", dedupe_documents),
    ("mix", mix_sources),
    ("bpe", tokenize),
]

#: Learned scores, similarity classes and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
