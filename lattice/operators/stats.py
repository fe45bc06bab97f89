"""Counts, vocabularies and profiles of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattice.schemas import Graph


def table_counts(graph: Graph) -> DataFrame:
    """(metric, n) of documents, chunks, entities and relations."""
    one = lambda name: getattr(graph, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
    return reduce(DataFrame.unionByName, map(one, ("documents", "chunks", "entities", "relations")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(column, n), most frequent first, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def vocabulary(df: DataFrame, column: str, top: int = 50) -> DataFrame:
    """One row: the ``top`` most frequent values joined with comma and space; empty for an empty table."""
    best = value_counts(df, column).limit(top)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(column).alias("v"))))
    return best.agg(F.array_join(F.transform(ordered, lambda x: x["v"]), ", ").alias("vocabulary"))


def attribute_frequency(entities: DataFrame, top: int = 20, sample_limit: int | None = None) -> DataFrame:
    """(entity_type, attribute, n, frequency): the ``top`` attribute keys of each type, frequency over all of its entities.

    ``sample_limit`` counts keys over so many entities of least id of each type only.
    """
    totals = entities.groupBy("entity_type").agg(F.count("*").alias("total"))
    counted = entities
    if sample_limit is not None:
        rank = F.row_number().over(Window.partitionBy("entity_type").orderBy("id"))
        counted = entities.withColumn("_rank", rank).filter(F.col("_rank") <= sample_limit)
    keys = counted.select("entity_type", F.explode(F.array_distinct(F.json_object_keys("attributes"))).alias("attribute"))
    counts = keys.groupBy("entity_type", "attribute").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("entity_type").orderBy(F.desc("n"), "attribute"))
    best = counts.withColumn("_rank", rank).filter(F.col("_rank") <= top)
    return best.join(totals, "entity_type").select("entity_type", "attribute", "n", F.round(F.col("n") / F.col("total"), 2).alias("frequency"))


def type_pairs(relations: DataFrame, entities: DataFrame, top: int = 10) -> DataFrame:
    """(predicate, subject_type, object_type, n): the ``top`` pairs of each predicate.

    Only ids and types are joined, and a task holds its share of the entities: relations pass by, neither sorted nor kept. They aren't counted
    between the joins, since a task would hold nearly as many counts as it has relations. A frequent object is split by adaptive execution.
    """
    kind = lambda end: entities.select(F.col("id").alias(f"{end}_id"), F.col("entity_type").alias(f"{end}_type")).hint("shuffle_hash")
    some = relations.select("predicate", "subject_id", "object_id").join(kind("subject"), "subject_id").join(kind("object"), "object_id")
    counts = some.groupBy("predicate", "subject_type", "object_type").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("predicate").orderBy(F.desc("n"), "subject_type", "object_type"))
    return counts.withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")


def vocabulary_gap(found: DataFrame, known: DataFrame) -> DataFrame:
    """Values of ``found`` that ``known`` lacks, each once; both have one column."""
    return found.distinct().subtract(known)


def frequent_surface(mentions: DataFrame) -> DataFrame:
    """(entity_id, surface_form, n): the most frequent surface form of each entity, ties by the least text."""
    counts = mentions.groupBy("entity_id", "surface_form").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "surface_form")).alias("best")
    return counts.groupBy("entity_id").agg(best).select("entity_id", F.col("best.surface_form").alias("surface_form"), (-F.col("best.m")).alias("n"))


def dedupe_relations(relations: DataFrame) -> DataFrame:
    """One relation, of least id, for each (subject, predicate, object, evidence); null evidences are equal.

    The rows are read once. Each other column is an aggregate of its own: one that isn't used is not carried, and numbers are aggregated by hash.
    """
    keys = ["subject_id", "predicate", "object_id", "evidence_chunk_id"]
    others = [F.min_by(c, "id").alias(c) for c in relations.columns if c not in ("id", *keys)]
    return relations.filter("id IS NOT NULL").groupBy(*keys).agg(F.min("id").alias("id"), *others).select(*relations.columns)
