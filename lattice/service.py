"""What the command line and the tool server answer: plain values from the query layer."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.operators import export, graph, listing, search, stats
from lattice.schemas import Graph
from lattice.sources.models import Embedder


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a result that is bounded by a limit or by one entity."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    for row in out:
        if isinstance(row.get("attributes"), str):
            row["attributes"] = json.loads(row["attributes"])
    return out


def corpus_stats(g: Graph) -> dict:
    counts = {r["metric"]: r["n"] for r in stats.table_counts(g).collect()}
    pairs = lambda df, c: {r[c]: r["n"] for r in stats.value_counts(df, c).collect()}
    last = lambda df: next(iter(_rows(listing.latest(df))), None)
    return counts | {"entity_types": pairs(g.entities, "entity_type"), "relation_predicates": pairs(g.relations, "predicate"), "last_extraction": last(g.extraction_runs), "last_resolution": last(g.resolution_runs)}


def find(g: Graph, embedder: Embedder, query: str, limit: int = 10) -> list[dict]:
    return _rows(search.search_chunks(g, embedder.embed([query])[0], limit))


def entities(g: Graph, entity_type: str | None = None, search_text: str | None = None, limit: int = 50) -> list[dict]:
    return _rows(listing.list_entities(g.entities, entity_type, search_text, limit))


def relations(g: Graph, predicate: str | None = None, subject: str | None = None, object_name: str | None = None, limit: int = 50) -> list[dict]:
    return _rows(listing.list_relations(g.relations, g.entities, predicate, subject, object_name, limit))


def entity(g: Graph, name: str, entity_type: str | None = None) -> dict | None:
    found = {k: _rows(v) for k, v in listing.get_entity(g, name, entity_type).items()}
    if not found["entity"]:
        return None
    one = found["entity"][0]
    return {"id": one["id"], "name": one["canonical_name"], "type": one["entity_type"], "attributes": one["attributes"]} | {k: [{c: v for c, v in r.items() if c != "id"} for r in found[k]] for k in ("mentions", "outgoing", "incoming")}


def neighbors(g: Graph, name: str, depth: int = 1, entity_type: str | None = None) -> dict:
    nodes, edges = graph.neighbors(g.entities, g.relations, name, depth, entity_type)
    return {"nodes": _rows(nodes.select("name", "type", "attributes").orderBy("name")), "edges": _rows(edges.select("subject", "predicate", "object", "confidence").orderBy("subject", "object"))}


def path(g: Graph, start: str, end: str, max_depth: int = 5) -> list[dict] | None:
    found = graph.shortest_path(g.entities, g.relations, start, end, max_depth)
    return None if found is None else _rows(found.drop("step")) if found.isEmpty() else [{k: v for k, v in r.items() if k != "step"} for r in _rows(found.orderBy("step"))]


def schema(g: Graph) -> dict | None:
    row = listing.current_schema(g.schema_versions).first()
    return None if row is None else {"id": row["id"], "created_at": row["created_at"], "schema": yaml.safe_load(row["schema_yaml"])}


FORMATS = {"jsonld": export.jsonld, "cypher": export.cypher, "graphml": export.graphml}


def write_export(g: Graph, kind: str, output: Path) -> None:
    """Stream an export to a file, without holding it whole."""
    with open(output, "w", encoding="utf-8") as f:
        f.writelines(FORMATS[kind](g.entities, g.relations))


def export_rows(g: Graph, kind: str) -> DataFrame:
    """An export as rows of text, for graphs that one file can't hold; those of GraphML are in the order of the document."""
    if kind == "cypher":
        return export.cypher_lines(g.entities, g.relations).select("line")
    if kind == "jsonld":
        return export.jsonld_nodes(g.entities).select(F.col("node").alias("line")).unionByName(export.jsonld_edges(g.relations, g.entities).select(F.col("edge").alias("line")))
    if kind == "graphml":
        return export.graphml_lines(g.entities, g.relations).orderBy("part", "id", "other").select("line")
    raise ValueError(f"no row form of {kind}")
