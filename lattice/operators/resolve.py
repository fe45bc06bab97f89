"""Entity resolution: similarity clusters of mentions, verification, merges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.operators.components import connected_components
from lattice.operators.search import similar_links
from lattice.operators.stats import dedupe_relations, frequent_surface
from lattice.operators.upsert import fold_attributes
from lattice.plans.materialize import bounded_broadcast, materialize
from lattice.schemas import Graph

STEP = 0.05


def cluster_ladder(pairs: DataFrame, threshold: float, max_size: int, step: float = STEP) -> DataFrame:
    """(node, cluster): components of the pairs (a, b, similarity); those above ``max_size`` nodes split at higher thresholds.

    Each rung keeps only the pairs inside oversize components, at a threshold higher by ``step``; above 1 every node is alone.
    """
    nodes = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    left, done = materialize(pairs), None
    while True:
        found = connected_components(left.filter(F.col("similarity") >= threshold), "a", "b")
        alone = nodes.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
        found = materialize(found.unionByName(alone))
        large = found.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > max_size).select("component")
        small = found.join(large, "component", "left_anti").select("node", F.col("component").alias("cluster"))
        done = small if done is None else done.unionByName(small)
        nodes = materialize(found.join(large, "component", "left_semi").select("node"))
        if nodes.isEmpty():
            return done
        threshold += step
        ends = lambda c: nodes.select(F.col("node").alias(c))
        left = materialize(left.join(ends("a"), "a", "left_semi").join(ends("b"), "b", "left_semi").select("a", "b", "similarity"))


def apply_merges(graph: Graph, mapping: DataFrame, now: str = "", names: DataFrame | None = None) -> Graph:
    """The graph with entities merged by (old_id, survivor): chains resolve to the least id reached.

    Attributes of the survivor, then of the dropped by ascending id, merge with the later value winning. Mentions and relations are
    repointed, then relations deduplicated over the whole table. ``names`` (id, canonical_name) renames survivors.
    """
    groups = materialize(connected_components(mapping, "old_id", "survivor"))
    moved = bounded_broadcast(groups.filter("node != component").select(F.col("node").alias("old_id"), F.col("component").alias("survivor")))
    at = lambda c: F.coalesce("survivor", c).alias(c)

    def repoint(df: DataFrame, column: str) -> DataFrame:
        return df.join(moved.withColumnRenamed("old_id", column), column, "left").select(*(at(c) if c == column else F.col(c) for c in df.columns))

    relations = dedupe_relations(materialize(repoint(repoint(graph.relations, "subject_id"), "object_id")))
    members = graph.entities.join(groups.withColumnRenamed("node", "id"), "id").select(F.col("component").alias("_to"), F.col("id").alias("seq"), "attributes")
    folded = fold_attributes(members, ["_to"]).select(F.col("_to").alias("id"), F.col("attributes").alias("_folded"))
    kept = graph.entities.join(moved.select(F.col("old_id").alias("id")), "id", "left_anti")
    kept = kept.join(folded, "id", "left").join(groups.select(F.col("component").alias("id")).distinct().withColumn("_merged", F.lit(True)), "id", "left")
    entities = kept.select(*(F.coalesce("_folded", "attributes").alias(c) if c == "attributes" else F.when(F.col("_merged"), now).otherwise(F.col(c)).alias(c) if c == "updated_at" and now else F.col(c) for c in graph.entities.columns))
    if names is not None:
        entities = entities.join(names.select("id", F.col("canonical_name").alias("_name")), "id", "left").select(*(F.coalesce("_name", c).alias(c) if c == "canonical_name" else F.col(c) for c in graph.entities.columns))
    return graph.with_(entities=entities, mentions=repoint(graph.mentions, "entity_id"), relations=relations)


def mention_clusters(graph: Graph, threshold: float = 0.85, max_size: int = 10, count_entities: bool = False) -> DataFrame:
    """(node, cluster) over mentions of at least two per entity type; clusters have more than one mention.

    With ``count_entities`` one mention per entity and vector stands for its repeats, so popular entities don't dissolve.
    """
    named = graph.mentions.select(F.col("id").alias("mention_id"), "entity_id").join(graph.entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id")
    rows = named.join(graph.mention_vectors, "mention_id")
    if count_entities:
        rows = rows.groupBy("entity_id", "embedding").agg(F.min("mention_id").alias("mention_id"), F.first("entity_type").alias("entity_type"))
    pairs = similar_links(rows, "mention_id", threshold, "entity_type")
    found = materialize(cluster_ladder(pairs, threshold, max_size))
    return found.join(found.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster"), "cluster", "left_semi").select("node", "cluster")


class _Verify:
    """Asks the client about one cluster at a time; a cluster has at most ``max_size`` mentions."""

    def __init__(self, client, on_error: str):
        self.client, self.on_error = client, on_error

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters, parts, names, members = [], [], [], []
            for cluster, kind, mentions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    answer = self.client.verify(kind, mentions)
                except Exception:
                    forms = [m["surface_form"] for m in mentions]
                    answer = [{"canonical_name": forms[0], "members": forms}] if self.on_error == "merge" else []
                for k, part in enumerate(answer):
                    clusters.append(cluster)
                    parts.append(k)
                    names.append(part.get("canonical_name"))
                    members.append(part["members"])
            yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int64()), pa.array(parts, pa.int32()), pa.array(names, pa.string()), pa.array(members, pa.list_(pa.string()))], ["cluster", "part", "canonical_name", "members"])


def resolve(graph: Graph, threshold: float = 0.85, max_size: int = 10, client=None, now: str = "", on_verify_error: str = "merge", count_entities: bool = False) -> tuple[Graph, int]:
    """The resolved graph and the number of entities merged away.

    Clusters whose mentions belong to one entity stay. Without a ``client`` a cluster is one group named by its first surface form; with one
    its answer partitions the surface forms. The survivor is the least id; a survivor without a name gets its most
    frequent form. A rename that meets another entity of the same name and type merges with it.
    """
    clusters = mention_clusters(graph, threshold, max_size, count_entities)
    rows = clusters.join(graph.mentions.withColumnRenamed("id", "node"), "node").select("cluster", "node", "entity_id", "surface_form", "chunk_id")
    mixed = rows.groupBy("cluster").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi")).filter("lo != hi").select("cluster")
    rows = materialize(rows.join(mixed, "cluster", "left_semi"))
    if client is None:
        first = rows.groupBy("cluster").agg(F.min_by("surface_form", "node").alias("canonical_name"))
        groups = rows.select("cluster", F.lit(0).alias("part"), "entity_id").distinct().join(first, "cluster")
    else:
        texts = graph.chunks.select(F.col("id").alias("chunk_id"), F.substring("content", 1, 150).alias("snippet"))
        named = graph.entities.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity"), "entity_type")
        told = rows.join(texts, "chunk_id", "left").join(named, "entity_id")
        asked = told.groupBy("cluster").agg(F.first("entity_type").alias("kind"), F.array_sort(F.collect_list(F.struct("node", "surface_form", "entity", "snippet"))).alias("mentions"))
        answers = materialize(asked.select("cluster", "kind", "mentions").mapInArrow(_Verify(client, on_verify_error), "cluster long, part int, canonical_name string, members array<string>"))
        forms = answers.select("cluster", "part", "canonical_name", F.explode("members").alias("surface_form")).distinct()
        groups = rows.join(forms, ["cluster", "surface_form"]).select("cluster", "part", "entity_id", "canonical_name").distinct()
    least = groups.groupBy("cluster", "part").agg(F.min("entity_id").alias("survivor"), F.countDistinct("entity_id").alias("n"), F.first("canonical_name").alias("name")).filter("n > 1")
    least = materialize(least)
    mapping = materialize(groups.join(least, ["cluster", "part"]).filter("entity_id != survivor").select(F.col("entity_id").alias("old_id"), "survivor"))
    if mapping.isEmpty():
        return graph, 0
    roots = connected_components(mapping, "old_id", "survivor").select(F.col("node").alias("survivor"), F.col("component").alias("id"))
    named = least.join(roots, "survivor").groupBy("id").agg(F.min_by("name", F.struct("cluster", "part")).alias("canonical_name"))
    of_root = graph.mentions.join(roots.select(F.col("survivor").alias("entity_id"), F.col("id").alias("_root")), "entity_id").select(F.col("_root").alias("entity_id"), "surface_form")
    forms = frequent_surface(of_root)
    named = named.join(forms.select(F.col("entity_id").alias("id"), F.col("surface_form").alias("_form")), "id", "left").select("id", F.coalesce(F.when(F.col("canonical_name") != "", F.col("canonical_name")), "_form").alias("canonical_name"))
    before = graph.entities.count()
    out = apply_merges(graph, mapping, now, materialize(named))
    out = out.with_(entities=materialize(out.entities), mentions=materialize(out.mentions), relations=materialize(out.relations))
    same = out.entities.groupBy("canonical_name", "entity_type").agg(F.min("id").alias("survivor"), F.count("*").alias("n")).filter("n > 1")
    clash = materialize(out.entities.join(same, ["canonical_name", "entity_type"]).filter("id != survivor").select(F.col("id").alias("old_id"), "survivor"))
    if not clash.isEmpty():
        out = apply_merges(out, clash, now)
        out = out.with_(entities=materialize(out.entities))
    return out, before - out.entities.count()
