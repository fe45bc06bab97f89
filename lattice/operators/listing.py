"""Lookups and listings over entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.plans.materialize import bounded_broadcast
from lattice.schemas import Graph

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def _limited(df: DataFrame, limit: int) -> DataFrame:
    """The first rows; a negative limit means all."""
    return df if limit < 0 else df.limit(limit)


def list_entities(entities: DataFrame, entity_type: str | None = None, search: str | None = None, limit: int = 50) -> DataFrame:
    """(id, name, type, attributes) by name, then id. ``search`` is a pattern part: % and _ in it are wildcards."""
    out = entities
    if entity_type:
        out = out.filter(F.col("entity_type") == entity_type)
    if search:
        folded = search.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
        out = out.filter(ascii_fold(F.col("canonical_name")).like(f"%{folded}%"))
    out = out.select("id", F.col("canonical_name").alias("name"), F.col("entity_type").alias("type"), "attributes")
    return _limited(out.orderBy("name", "id"), limit)


def named_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with names and types of both ends; those with a missing end go."""
    return relations.join(_end(entities, "subject"), "subject_id").join(_end(entities, "object"), "object_id")


def _end(entities: DataFrame, p: str) -> DataFrame:
    return entities.select(F.col("id").alias(f"{p}_id"), F.col("canonical_name").alias(p), F.col("entity_type").alias(f"{p}_type"))


def list_relations(relations: DataFrame, entities: DataFrame, predicate: str | None = None, subject: str | None = None, object_name: str | None = None, limit: int = 50) -> DataFrame:
    """(id, subject, subject_type, predicate, object, object_type, confidence, attributes) by id.

    Name filters reduce the relations by id before the joins. With a limit, relations whose ends exist are found by id alone, each task
    keeps only its own first rows, and only the rows of the page are joined with names.
    """
    wanted = relations.filter(F.col("predicate") == predicate) if predicate else relations
    for end, name in (("subject", subject), ("object", object_name)):
        if name:
            ids = entities.filter(F.col("canonical_name") == name).select(F.col("id").alias(f"{end}_id"))
            wanted = wanted.join(bounded_broadcast(ids), f"{end}_id", "left_semi")
    if limit >= 0:
        ids = bounded_broadcast(entities.select("id"))
        for end in ("subject", "object"):
            wanted = wanted.join(ids.withColumnRenamed("id", f"{end}_id"), f"{end}_id", "left_semi")
        page = F.broadcast(wanted.orderBy("id").limit(limit))
        out = F.broadcast(page.join(_end(entities, "subject"), "subject_id")).join(_end(entities, "object"), "object_id")
    else:
        out = named_relations(wanted, entities)
    return out.select("id", "subject", "subject_type", "predicate", "object", "object_type", "confidence", "attributes").orderBy("id")


def get_entity(graph: Graph, name: str, entity_type: str | None = None) -> dict[str, DataFrame]:
    """The entity of a name (of several, the least id) as four tables: entity, mentions, outgoing, incoming.

    Mentions show the first 200 characters of their chunk. All are empty if there is no such entity.
    """
    found = graph.entities.filter(F.col("canonical_name") == name)
    if entity_type:
        found = found.filter(F.col("entity_type") == entity_type)
    entity = F.broadcast(found.orderBy("id").limit(1))
    key = entity.select(F.col("id").alias("_entity"))
    texts = graph.chunks.select(F.col("id").alias("chunk_id"), "document_id", F.substring("content", 1, 200).alias("chunk_text"))
    paths = graph.documents.select(F.col("id").alias("document_id"), "path")
    mine = graph.mentions.join(key, F.col("entity_id") == F.col("_entity"), "left_semi")
    mentions = mine.join(texts, "chunk_id").join(paths, "document_id").select("id", "surface_form", "confidence", "chunk_text", "path").orderBy("id")

    def side(own: str, other: str) -> DataFrame:
        mine = graph.relations.join(key, F.col(f"{own}_id") == F.col("_entity"), "left_semi")
        names = graph.entities.select(F.col("id").alias(f"{other}_id"), F.col("canonical_name").alias(f"{other}_name"), F.col("entity_type").alias(f"{other}_type"))
        return mine.join(names, f"{other}_id").select("id", "predicate", f"{other}_name", f"{other}_type", "confidence", "attributes").orderBy("id")

    return {"entity": entity, "mentions": mentions, "outgoing": side("subject", "object"), "incoming": side("object", "subject")}


def current_schema(schema_versions: DataFrame) -> DataFrame:
    """The newest schema version."""
    return schema_versions.orderBy(F.desc("id")).limit(1)


def latest(runs: DataFrame) -> DataFrame:
    """The newest row of a run table."""
    return runs.orderBy(F.desc("id")).limit(1)
