"""Traversals: neighbourhoods and shortest paths over the name-keyed, undirected view of a graph.

A hop works on ids: the frontier meets the ends of the relations, and only what it reaches is looked up among the entities. Frontiers are
written, so the planner knows their size and broadcasts them while they are small. Relations that are computed are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.operators.listing import named_relations
from lattice.plans.materialize import discard, materialize, settled


def graph_view(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, type, attributes) and edges (subject, object, predicate, confidence, id).

    Entities of one name are one node, the largest id wins; so does the largest relation id of each ordered pair.
    """
    last = F.max_by(F.struct(F.col("entity_type").alias("type"), "attributes", "id"), "id").alias("n")
    nodes = entities.groupBy(F.col("canonical_name").alias("name")).agg(last).select("name", "n.type", "n.attributes", "n.id")
    edges = named_relations(relations, entities).groupBy("subject", "object").agg(F.max_by(F.struct("predicate", "confidence", "id"), "id").alias("e"))
    return nodes, edges.select("subject", "object", "e.predicate", "e.confidence", "e.id")


def _steps(relations: DataFrame) -> DataFrame:
    """(at, next): both directions of every relation by id, in one scan."""
    way = lambda a, b: F.struct(F.col(a).alias("at"), F.col(b).alias("next"))
    return relations.select(F.inline(F.array(way("subject_id", "object_id"), way("object_id", "subject_id"))))


def _nodes(entities: DataFrame) -> DataFrame:
    return entities.select("id", F.col("canonical_name").alias("node"))


def neighbors(entities: DataFrame, relations: DataFrame, name: str, depth: int = 1, entity_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and induced edges within ``depth`` hops of a name, either direction.

    A type filter keeps other nodes out and stops the search there; the start is exempt. An unknown name gives empty tables.
    Visited nodes are never expanded twice.
    """
    nodes = _nodes(entities)
    if depth > 1:
        relations = settled(relations.select("id", "subject_id", "predicate", "object_id", "confidence"))
    steps = _steps(relations)
    visited = frontier = materialize(nodes.filter(F.col("node") == name))
    for _ in range(max(0, depth)):
        reached = materialize(steps.join(frontier.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("next").alias("id")).distinct())
        met = nodes.join(reached, "id", "left_semi").select("node").distinct()
        if entity_type:
            types = entities.groupBy(F.col("canonical_name").alias("node")).agg(F.max_by("entity_type", "id").alias("type"))
            met = met.join(types.filter(F.col("type") == entity_type).select("node"), "node", "left_semi")
        met = materialize(met.join(visited.select("node"), "node", "left_anti"))
        if met.isEmpty():
            break
        frontier = materialize(nodes.join(met, "node").select("id", "node"))
        visited = visited.unionByName(frontier)
        discard(reached)
    mine = materialize(entities.join(visited.select("id"), "id", "left_semi"))
    return graph_view(mine, relations)


def shortest_path(entities: DataFrame, relations: DataFrame, start: str, end: str, max_depth: int = 5) -> DataFrame | None:
    """(step, subject, predicate, object) of a shortest path, either direction; None if there is none within ``max_depth``.

    Level by level from the start; each new node remembers its least parent by name. A hop shows the edge in its stored direction,
    the forward one if both exist. The path from a node to itself has no rows.
    """
    spark, nodes = entities.sparkSession, _nodes(entities)
    schema = "step int, subject string, predicate string, object string"
    frontier = materialize(nodes.filter(F.col("node").isin(start, end)))
    there = {r["node"] for r in frontier.select("node").distinct().collect()}
    if {start, end} - there:
        return None
    if start == end:
        return spark.createDataFrame([], schema)
    ends = settled(relations.select("id", "subject_id", "predicate", "object_id"))
    steps, frontier = _steps(ends), frontier.filter(F.col("node") == start)
    visited, levels = frontier.select("node"), []
    for _ in range(max_depth):
        parents = frontier.select(F.col("id").alias("at"), F.col("node").alias("parent"))
        reached = materialize(steps.join(parents, "at").groupBy(F.col("next").alias("id")).agg(F.min("parent").alias("parent")))
        met = nodes.join(reached, "id").groupBy("node").agg(F.min("parent").alias("parent"))
        level = materialize(met.join(visited, "node", "left_anti"))
        discard(reached)
        levels.append(level)
        if not level.filter(F.col("node") == end).isEmpty():
            break
        if level.isEmpty():
            return None
        frontier = materialize(nodes.join(level.select("node"), "node").select("id", "node"))
        visited = visited.unionByName(level.select("node"))
    else:
        return None
    hops, node = [], end
    for level in reversed(levels):
        parent = level.filter(F.col("node") == node).first()["parent"]
        hops.append((parent, node))
        node = parent
    for level in levels:
        discard(level)
    hops = hops[::-1]
    wanted = spark.createDataFrame([(i, *ends, ahead) for i, (a, b) in enumerate(hops) for ends, ahead in (((a, b), 0), ((b, a), 1))], "step int, subject string, object string, back int")
    same = [F.col(f"w.{c}") == F.col(f"e.{c}") for c in ("subject", "object")]
    mine = materialize(entities.filter(F.col("canonical_name").isin(start, *(b for _, b in hops))))
    edges = named_relations(ends, mine).select("subject", "object", "predicate", "id")
    found = edges.alias("e").join(F.broadcast(wanted).alias("w"), same)
    best = found.groupBy("w.step").agg(F.max(F.struct((-F.col("back")).alias("forward"), F.col("e.id"), F.col("e.subject"), F.col("e.predicate"), F.col("e.object"))).alias("b"))
    return best.select("step", "b.subject", "b.predicate", "b.object").orderBy("step")
