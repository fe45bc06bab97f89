"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Between stages the rows are written as Parquet below
the shared checkpoint folder and read again, so a later stage never repeats an earlier one after a lost executor.

In every stage nulls, empty and blank texts are texts without words, very long ones are taken whole, and an empty table gives no rows. Rows with a null
id can't be named by a decision: the filters keep them. Of rows that repeat an id, the quality and contamination filters drop all if one
fails; near-duplicates keep one row of an id in a group; mixing decides all alike; sharding puts all into one shard. Other columns of documents, whatever
their names, go through the filters unchanged, and sharding drops them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattice.llm import decontaminate, mixing, quality, shards, simhash
from lattice.plans.materialize import discard, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor come from a rejected host; those without words fail."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group of five-word shingles with a Jaccard similarity of 0.8 or more; texts without words are one group."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, edits included; an item without words matches nothing."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target mixture of sources, languages and forms; a cell without words gives none."""
    return mixing.sample(docs)


def rendezvous_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document; null ids share a shard."""
    return shards.shard(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("rendezvous_sharding", rendezvous_sharding),
]

#: SQL has neither XXH64 nor edit matching of passages; the tests hold every stage's rows against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, with its benchmark; the rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        out = materialize(stage(spark, docs, sf_dir))
        if at:
            discard(docs)
        docs = out
    return docs
