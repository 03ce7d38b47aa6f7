"""Registered queries of the training-data operators, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, bpe, divergence, langid, licenses, mixing, nearjoin, pieces, pii, quality, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"))


def op3_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_classes(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_ann_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(_table(spark, sf_dir, "documents")).select("doc_id", "text", "pii_kinds")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_predictions(_table(spark, sf_dir, "documents"))


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(_table(spark, sf_dir, "documents"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(_table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_near_join": op3_near_join,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_ann_multi_index": op5_ann_multi_index,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_language_id": op8_language_id,
    "op9_temperature_mixing": op9_temperature_mixing,
    "op10_warc_round_trip": op10_warc_round_trip,
    "op11_alignment": op11_alignment,
    "op12_bpe": op12_bpe,
    "op13_divergence": op13_divergence,
}

ORACLE = {
    "op1_license_scan": licenses.oracle_sql(),
    "op6_exact_top_k": topk.oracle_sql(),
    "op9_temperature_mixing": mixing.oracle_sql(),
    "op13_divergence": divergence.oracle_sql(),
}
