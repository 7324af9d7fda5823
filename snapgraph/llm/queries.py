"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from snapgraph.llm import bpe, clusters, codes, crf, gif, licenses, lines, mixing, neardup, quality, spans, topk, toxicity
from snapgraph.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_texts(table(spark, sf_dir, "documents"))


def quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "log_weight", "key")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.report(table(spark, sf_dir, "documents"))


def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(table(spark, sf_dir, "embeddings"))


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mix_sources,
        "op2_media_columns": media_columns,
        "op3_quality_resample": quality_resample,
        "op4_line_dedup": line_dedup,
        "op5_minhash_near_dup": minhash_near_dup,
        "op6_span_dedup": span_dedup,
        "op7_exact_topk": exact_topk,
        "op8_bpe_codec": bpe_codec,
        "op9_toxicity": toxicity_scores,
        "op10_license_scan": license_scan,
        "op11_line_crf": line_crf,
        "op12_vector_codes": vector_codes,
        "op13_centroid_clusters": centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op7_exact_topk": topk.SQL, "op12_vector_codes": codes.sql(), "op13_centroid_clusters": clusters.sql()}
