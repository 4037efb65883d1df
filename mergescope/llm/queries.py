"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from mergescope.llm import (
    bpe, embed_dedup, hard_negatives, licenses, line_dedup, packing, pieces, quality, secret_scan, simhash, suffix_dedup, url_filter,
    vector_codes,
)
from mergescope.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """A public vocabulary's content, read by the driver and sent to the executors by the operators."""
    import public_tokenizers

    return packing.read_vocabulary(public_tokenizers.path(name))


def model_file(name: str) -> bytes:
    """A public model's content, read by the driver; a file of fixed size."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op1_packing(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op3_suffix_array_dedup(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.fuzzy_lines(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8_quality_rules(table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_findings(table(spark, sf_dir, "documents")).drop("value")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), model_file("piece_bpe_32k.model"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.op11_vector_codes(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.op13_hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_url_filters": op2_url_filters,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_bpe": op4_bpe,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scans": op9_license_scans,
    "op10_secret_scans": op10_secret_scans,
    "op11_vector_codes": op11_vector_codes,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {"op8_quality_rules": quality.SQL}
