"""Incremental writes: classification of a scan, upserts of entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.functions.jsons import json_entries, json_string
from lattice.plans.ids import dense_ids
from lattice.plans.materialize import materialize

RELATION_KEY = ["subject_id", "predicate", "object_id", "evidence_chunk_id"]


def classify(scan: DataFrame, state: DataFrame) -> DataFrame:
    """(path, content_hash, id, change) of a scan (path, content_hash) against known documents (id, path, content_hash).

    change is new, updated, skipped, or absent for documents that the scan doesn't have.
    """
    known = state.select("path", "id", F.col("content_hash").alias("_known"))
    change = F.when(F.col("content_hash").isNull(), "absent").when(F.col("id").isNull(), "new").when(F.col("content_hash") == F.col("_known"), "skipped").otherwise("updated")
    return scan.join(known, "path", "full_outer").select("path", "content_hash", "id", change.alias("change"))


def stale(documents: DataFrame, force: bool = False) -> DataFrame:
    """Documents whose present content hasn't been extracted; all with ``force``."""
    return documents if force else documents.filter(~F.col("content_hash").eqNullSafe(F.col("last_extracted_hash")))


def backlog(rows: DataFrame, key: str, vectors: DataFrame, vector_key: str) -> DataFrame:
    """Rows that have no vector yet."""
    return rows.join(vectors.select(F.col(vector_key).alias(key)), key, "left_anti")


def normal_type(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def fold_attributes(rows: DataFrame, keys: list[str], seq: str = "seq", attributes: str = "attributes") -> DataFrame:
    """(keys, attributes): JSON objects of each key merged in order of ``seq``; a later value wins, its first place stays.

    Of a name that an object repeats the last value counts. A text that is no object is kept as the attribute ``_unparsed``.
    Values are aggregated by (key, attribute name) with map-side combination, so a key with any number of rows is never
    gathered; only its distinct attribute names are.
    """
    some = rows.filter(~F.col(attributes).isin("{}", "")).select(*keys, F.col(seq).alias("_seq"), F.posexplode(json_entries(F.col(attributes))).alias("_place", "_entry"))
    at = F.struct("_seq", "_place")
    folded = some.groupBy(*keys, F.col("_entry.key").alias("_key")).agg(F.max_by("_entry.value", at).alias("_value"), F.min(at).alias("_first"))
    entry = F.concat(json_string(F.col("_key")), F.lit(": "), F.col("_value"))
    listed = F.array_sort(F.collect_list(F.struct("_first", entry.alias("e"))))
    return folded.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(F.transform(listed, lambda x: x["e"]), ", "), F.lit("}")).alias("attributes"))


def upsert_entities(known: DataFrame, found: DataFrame, now: str, next_id: int | None = None) -> DataFrame:
    """Known entities with those of ``found`` (seq, canonical_name, entity_type, attributes) merged in.

    The key is (name, type lower-cased with spaces as underscores). Attributes merge in order of seq after the known ones; new entities get ids
    after the largest in order of their first seq. ``next_id`` is the first free id where ids above the known ones were used.
    """
    keys = ["canonical_name", "entity_type"]
    fresh = found.select("seq", "canonical_name", normal_type(F.col("entity_type")).alias("entity_type"), "attributes")
    first = fresh.groupBy(*keys).agg(F.min("seq").alias("_first"))
    marked = materialize(known.join(first, keys, "full_outer"))
    if next_id is None:
        next_id = (marked.agg(F.max("id")).first()[0] or 0) + 1
    touched = marked.filter(F.col("id").isNotNull() & F.col("_first").isNotNull())
    sources = touched.select(*keys, F.lit(None).cast("long").alias("seq"), "attributes").unionByName(fresh.withColumn("seq", F.col("seq").cast("long")))  # null sorts first
    folded = fold_attributes(sources, keys)
    old = marked.filter(F.col("id").isNotNull())
    new = dense_ids(marked.filter(F.col("id").isNull()).drop("id"), ["_first", *keys], next_id)
    out = old.unionByName(new.select(*old.columns)).withColumnRenamed("attributes", "_old").join(folded, keys, "left")
    return out.select(
        "id",
        *keys,
        F.when(F.col("_first").isNull(), F.col("_old")).otherwise(F.coalesce("attributes", F.lit("{}"))).alias("attributes"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"),
        F.when(F.col("_first").isNull(), F.col("updated_at")).otherwise(now).alias("updated_at"),
    )


def resolve_relations(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations by name with the ids of both ends: the least id of the name. Those with an unknown end go.

    Of equal (subject, predicate, object, evidence) the least seq stays; without evidence all stay.
    """
    ids = entities.groupBy("canonical_name").agg(F.min("id").alias("id"))
    end = lambda p: ids.select(F.col("canonical_name").alias(p), F.col("id").alias(f"{p}_id"))
    rows = found.join(end("subject"), "subject").join(end("object"), "object").drop("subject", "object")
    evident = rows.filter(F.col("evidence_chunk_id").isNotNull())
    one = evident.groupBy(*RELATION_KEY).agg(F.min_by(F.struct(*rows.columns), F.struct("seq", *[c for c in rows.columns if c != "seq"])).alias("_row")).select("_row.*")
    return one.unionByName(rows.filter(F.col("evidence_chunk_id").isNull()).select(*one.columns))


def insert_relations(known: DataFrame, resolved: DataFrame, next_id: int) -> DataFrame:
    """Known relations and those of ``resolved`` whose key isn't there yet; without evidence nothing conflicts."""
    there = known.filter(F.col("evidence_chunk_id").isNotNull()).select(*RELATION_KEY)
    new = resolved.join(there, RELATION_KEY, "left_anti")
    return known.unionByName(dense_ids(new, ["seq"], next_id).select(*known.columns))
