"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm import decontaminate, hmm, licenses, lines, mixing, quality, secrets, shards, simhash, urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op4_hmm_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_table(spark, sf_dir, "documents"))
    rates = [F.round(f"{part}_{r}", 6).alias(f"{part}_{r}") for r in quality.rules() for part in ("rate", "limit")]
    host = ["host", "host_docs", "host_rejected", *(f"fails_{r}" for r in quality.rules())]
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *host, *rates)


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_lines(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_license_scans": op3_license_scans,
    "op4_hmm_lm_scoring": op4_hmm_lm_scoring,
    "op5_quality_rules": op5_quality_rules,
    "op6_rendezvous_sharding": op6_rendezvous_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_url_filters": op9_url_filters,
    "op10_secret_scans": op10_secret_scans,
}
