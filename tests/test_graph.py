"""Listings, traversals, statistics, exports over the seeded graph."""

import io
import json
import re
import time
import tracemalloc
import xml.etree.ElementTree as ET

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattice import cli, server, service
from lattice.operators import export, resolve, stats
from lattice.operators.components import connected_components
from lattice.operators.search import _Pairs, nearest, similar_links, similar_pairs
from lattice.plans.materialize import spread
from lattice.sources.models import HashEmbedder


def test_listings(seeded):
    assert len(service.entities(seeded)) == 5
    assert [e["name"] for e in service.entities(seeded, "Person")] == ["Ana Ruiz", "Ben Okoye"]
    assert [e["name"] for e in service.entities(seeded, None, "ORBIT")] == ["Orbit Corp"]
    assert [e["name"] for e in service.entities(seeded, None, "a_a")] == ["Ana Ruiz"]
    assert len(service.entities(seeded, None, None, 2)) == 2
    assert len(service.entities(seeded, None, None, -1)) == 5
    assert len(service.relations(seeded)) == 4
    assert len(service.relations(seeded, "works_at")) == 2
    assert [r["object"] for r in service.relations(seeded, None, "Ana Ruiz")] == ["Orbit Corp", "Project Sol"]
    assert [r["subject"] for r in service.relations(seeded, None, None, "Project Sol")] == ["Ana Ruiz", "Nadir Group"]


def test_entity(seeded):
    one = service.entity(seeded, "Ana Ruiz")
    assert (len(one["mentions"]), len(one["outgoing"]), len(one["incoming"])) == (1, 2, 0)
    assert one["mentions"][0]["path"] == "team.md"
    project = service.entity(seeded, "Project Sol")
    assert (len(project["mentions"]), len(project["outgoing"]), len(project["incoming"])) == (0, 0, 2)
    assert service.entity(seeded, "Nobody") is None
    assert service.entity(seeded, "Ana Ruiz", "Project") is None


@pytest.mark.parametrize(
    ("name", "depth", "kind", "nodes", "edges"),
    [
        ("Ana Ruiz", 0, None, {"Ana Ruiz"}, 0),
        ("Ana Ruiz", 1, None, {"Ana Ruiz", "Orbit Corp", "Project Sol"}, 2),
        ("Ana Ruiz", 2, None, {"Ana Ruiz", "Orbit Corp", "Project Sol", "Nadir Group"}, 3),
        ("Ana Ruiz", 3, None, {"Ana Ruiz", "Orbit Corp", "Project Sol", "Nadir Group", "Ben Okoye"}, 4),
        ("Nadir Group", 1, None, {"Nadir Group", "Ben Okoye", "Project Sol"}, 2),
        ("Ana Ruiz", 3, "Organization", {"Ana Ruiz", "Orbit Corp"}, 1),
        ("Nobody", 1, None, set(), 0),
    ],
)
def test_neighbors(seeded, name, depth, kind, nodes, edges):
    found = service.neighbors(seeded, name, depth, kind)
    assert {n["name"] for n in found["nodes"]} == nodes
    assert len(found["edges"]) == edges


@pytest.mark.parametrize(
    ("start", "end", "most", "expected"),
    [
        ("Ana Ruiz", "Nadir Group", 5, [("Ana Ruiz", "leads", "Project Sol"), ("Nadir Group", "runs", "Project Sol")]),
        ("Orbit Corp", "Nadir Group", 5, [("Ana Ruiz", "works_at", "Orbit Corp"), ("Ana Ruiz", "leads", "Project Sol"), ("Nadir Group", "runs", "Project Sol")]),
        ("Orbit Corp", "Ben Okoye", 3, None),
        ("Ana Ruiz", "Ana Ruiz", 5, []),
        ("Ana Ruiz", "Nobody", 5, None),
    ],
)
def test_path(seeded, start, end, most, expected):
    found = service.path(seeded, start, end, most)
    assert (found if found is None else [(e["subject"], e["predicate"], e["object"]) for e in found]) == expected


def test_same_names_collapse(spark, seeded):
    twice = seeded.with_(entities=seeded.entities.unionByName(spark.createDataFrame([(9, "Ana Ruiz", "Alias", "{}", "t", "t")], seeded.entities.schema)))
    found = service.neighbors(twice, "Ana Ruiz", 1)
    assert {n["name"]: n["type"] for n in found["nodes"]}["Ana Ruiz"] == "Alias"
    assert service.entity(twice, "Ana Ruiz")["id"] == 1


def test_statistics(seeded):
    found = service.corpus_stats(seeded)
    assert {k: found[k] for k in ("documents", "chunks", "entities", "relations")} == {"documents": 1, "chunks": 2, "entities": 5, "relations": 4}
    assert found["entity_types"] == {"Organization": 2, "Person": 2, "Project": 1}
    assert found["relation_predicates"] == {"works_at": 2, "leads": 1, "runs": 1}
    frequency = {(r.entity_type, r.attribute): r.frequency for r in stats.attribute_frequency(seeded.entities).collect()}
    assert frequency == {("Person", "role"): 1.0, ("Organization", "industry"): 0.5, ("Organization", "listed"): 0.5}
    pairs = {(r.predicate, r.subject_type, r.object_type, r.n) for r in stats.type_pairs(seeded.relations, seeded.entities).collect()}
    assert ("works_at", "Person", "Organization", 2) in pairs
    assert len(pairs) == 3


def test_exports(seeded):
    made = {k: "".join(f(seeded.entities, seeded.relations)) for k, f in service.FORMATS.items()}
    whole = json.loads(made["jsonld"])
    assert len(whole["@graph"]) == 9
    assert whole["@graph"][0] == {"@id": "kg:entity/1", "name": "Ana Ruiz", "type": "schema:Person", "kg:entityType": "Person", "kg:role": "lead"}
    assert "kg:confidence" not in whole["@graph"][8]
    lines = made["cypher"].splitlines()
    assert lines[1] == "CREATE (e2:Person {name: 'Ben Okoye', role: 'it\\'s ops'});"
    assert lines[2] == "CREATE (e3:Organization {name: 'Orbit Corp', industry: 'space', listed: true});"
    assert lines[5] == "CREATE (e1)-[:WORKS_AT {confidence: 0.9}]->(e3);"
    assert lines[8] == "CREATE (e4)-[:RUNS]->(e5);"
    tree = ET.fromstring(made["graphml"])
    names = {x.tag.rpartition("}")[2] for x in tree.iter()}
    assert names >= {"node", "edge", "key", "graph"}
    assert sum(x.tag.endswith("}node") for x in tree.iter()) == 5
    assert sum(x.tag.endswith("}edge") for x in tree.iter()) == 4


def test_exports_of_odd_attributes(spark, seeded):
    """Repeated names, names of own members, nested values, quotes, non-ASCII text and malformed text."""
    attributes = ['{"name": "own", "a b": [1, "x"], "q": "it\'s \\\\ \\"é\\"", "f": 1.0, "t": true, "n": null}', '{"a": 1, "a": 2}', '{"entityType": "z"}', '{"bad', "", None]
    entities = spark.createDataFrame([(i, f"é{i}", "Person", a, "t", "t") for i, a in enumerate(attributes)], seeded.entities.schema)
    relations = spark.createDataFrame([(7, 0, "x y", 1, None, 1, float("nan"), '{"confidence": "high", "w": 2}', "t"), (8, 1, "z", 0, None, 1, 0.5, None, "t")], seeded.relations.schema)
    nodes = {r.id: json.loads(r.node) for r in export.jsonld_nodes(entities).collect()}
    assert nodes[0] == {"@id": "kg:entity/0", "name": "é0", "type": "schema:Person", "kg:entityType": "Person", **{f"kg:{k}": v for k, v in json.loads(attributes[0]).items()}}
    assert isinstance(nodes[0]["kg:f"], float)
    assert nodes[1]["kg:a"] == 2
    assert nodes[2]["kg:entityType"] == "z"
    assert nodes[3]["kg:_unparsed"] == '{"bad'
    assert set(nodes[5]) == {"@id", "name", "type", "kg:entityType"}
    assert all(r.node.isascii() for r in export.jsonld_nodes(entities).collect())
    edges = {r.id: json.loads(r.edge) for r in export.jsonld_edges(relations, entities).collect()}
    assert edges[7] == {"@type": "kg:Relation", "kg:subject": "kg:entity/0", "kg:predicate": "x y", "kg:object": "kg:entity/1", "kg:confidence": "high", "kg:w": 2}
    assert edges[8]["kg:confidence"] == 0.5
    lines = {(r.kind, r.id): r.line for r in export.cypher_lines(entities, relations).collect()}
    assert lines["entity", 0] == "CREATE (e0:Person {name: 'own', a_b: '[1,\"x\"]', q: 'it\\'s \\\\ \"é\"', f: 1.0, t: true, n: null});"
    assert lines["entity", 1] == "CREATE (e1:Person {name: 'é1', a: 2});"
    assert lines["relation", 7] == "CREATE (e0)-[:X_Y {confidence: 'high', w: 2}]->(e1);"
    assert lines["relation", 8] == "CREATE (e1)-[:Z {confidence: 0.5}]->(e0);"


def test_graphml_reserved_keys(spark, seeded):
    entities = spark.createDataFrame([(1, "A", "t", '{"label": "x", "entity_type": "y"}', "t", "t")], seeded.entities.schema)
    text = "".join(service.FORMATS["graphml"](entities, seeded.relations))
    assert 'attr.name="attr_label"' in text
    assert ET.fromstring(text) is not None


def operators_of(df):
    """The names of the physical operators, as planned where no table may be broadcast."""
    return set(re.findall(r"(\w+)", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_graphml_edges_sort_once(spark, seeded, no_broadcast):
    """The edge of largest id of a pair, of known ends only; the relations are neither sorted to be joined nor aggregated as text."""
    more = spark.createDataFrame([(9, 1, "left", 3, None, 1, None, "{}", "t"), (8, 1, "joined", 3, None, 1, 0.5, "{}", "t"), (10, 3, "hired", 1, None, 1, 0.25, "{}", "t"), (11, 1, "knows", 77, None, 1, 1.0, "{}", "t")], seeded.relations.schema)
    edges = export.graphml_edges(seeded.relations.unionByName(more), seeded.entities)
    assert {tuple(r) for r in edges.collect()} == {("1", "3", "left", ""), ("3", "1", "hired", "0.25"), ("2", "4", "works_at", "0.9"), ("1", "5", "leads", "0.9"), ("4", "5", "runs", "")}
    assert not {"SortMergeJoin", "SortAggregate"} & operators_of(edges)


def test_spread_by_the_bytes_of_the_files(spark, tmp_path):
    """More files make more partitions, not larger ones; few or unknown bytes leave the rows as they are."""
    spark.range(20_000).selectExpr("id AS a", "id % 7 AS b").coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    held = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    for df, times in ((one, 1), (one.unionByName(one), 2)):
        n = spread(df, "a", most=held // 10).rdd.getNumPartitions()
        assert 10 * times <= n <= 11 * times
        assert spread(df, "a", most=held // 10).count() == 20_000 * times
    known = spark.createDataFrame([(1,)], "a long")
    assert spread(one, "a", most=held) is one
    assert spread(known, "a", most=1) is known


def test_relations_deduplicated_in_one_pass(spark, seeded, no_broadcast):
    """The row of least id of each key, with its own values, nulls included; the rows are read once and numbers never sorted."""
    rows = [(5, 1, "p", 2, None, 1, None, "five", "t"), (7, 1, "p", 2, None, 2, 0.5, "seven", "u"), (3, 1, "p", 2, 9, 3, 0.25, "three", "v"), (2, 2, "p", 1, None, 4, float("nan"), None, "w"), (4, 2, "p", 1, None, 5, 1.0, "four", "x")]
    relations = spark.createDataFrame(rows, seeded.relations.schema)
    found = stats.dedupe_relations(relations)
    assert found.columns == relations.columns
    assert {(r.id, r.attributes, str(r.confidence), r.evidence_chunk_id) for r in found.collect()} == {(5, "five", "None", None), (3, "three", "0.25", 9), (2, None, "nan", None)}
    few = found.select("id", "subject_id", "predicate", "object_id", "evidence_chunk_id", "confidence")
    assert not {"SortMergeJoin", "BroadcastHashJoin", "SortAggregate"} & operators_of(few)


def test_edges_without_attributes_are_not_parsed(spark, seeded, no_broadcast):
    """Edges without attributes are the text that the general way gives, in less than half of its time, and aren't sorted to be joined."""
    odd = [(1, 1, 'a "b"\\\né', 3, 1, 1, 0.9, "{}", "t"), (2, 2, "p q", 4, 2, 1, None, "{}", "t"), (3, 1, "", 5, 1, 1, float("nan"), "{}", "t"), (4, 1, "p", 77, 1, 1, 1.0, "{}", "t"), (5, 1, None, 3, 1, 1, 1e-7, "{}", "t")]
    bare = spark.createDataFrame(odd, seeded.relations.schema)
    for attributes in ("{ }", None):
        spaced = bare.withColumn("attributes", F.lit(attributes).cast("string"))
        assert sorted(map(str, export.jsonld_edges(bare, seeded.entities).collect())) == sorted(map(str, export.jsonld_edges(spaced, seeded.entities).collect()))
        assert sorted(map(str, export.cypher_lines(seeded.entities, bare).collect())) == sorted(map(str, export.cypher_lines(seeded.entities, spaced).collect()))
    assert "SortMergeJoin" not in operators_of(export.jsonld_edges(bare, seeded.entities)) | operators_of(export.cypher_lines(seeded.entities, bare))
    many = spark.range(100_000).select("id", F.lit(1).cast("long").alias("subject_id"), F.lit("p").alias("predicate"), F.lit(3).cast("long").alias("object_id"), F.lit(0.5).alias("confidence"))

    def seconds(attributes):
        begun = time.perf_counter()
        text = F.when(F.col("id") >= 0, attributes)  # no constant
        export.jsonld_edges(many.withColumn("attributes", text), seeded.entities).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    assert min(seconds("{}") for _ in range(3)) < min(seconds("{ }") for _ in range(3)) / 2


def test_type_pairs_hold_no_relations(spark, seeded, no_broadcast):
    """Relations with unknown ends don't count; before the last aggregate nothing is sorted or counted, so a task holds entities only."""
    rows = [(10 + i, 1 + i % 2, "knows", 3 + i % 3, None, 1, None, "{}", "t") for i in range(30)] + [(90, 1, "knows", 77, None, 1, None, "{}", "t"), (91, 77, "knows", 1, None, 1, None, "{}", "t")]
    pairs = stats.type_pairs(spark.createDataFrame(rows, seeded.relations.schema), seeded.entities)
    plan = pairs._jdf.queryExecution().executedPlan().toString()  # before it runs; it is then told twice
    assert {tuple(r) for r in pairs.collect()} == {("knows", "Person", "Organization", 20), ("knows", "Person", "Project", 10)}
    assert "SortMergeJoin" not in plan
    assert plan.count("HashAggregate") == 2


def test_components(spark):
    edges = [(1, 2), (3, 2), (10, 11), (5, 5), (11, 12), (12, 13), (13, 14), (14, 15), (None, 4)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in found.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, **dict.fromkeys(range(10, 16), 10)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_long_chain(spark):
    found = connected_components(spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long"))
    assert {r.component for r in found.collect()} == {0}


def test_similar_pairs_in_blocks(spark):
    import random

    random.seed(5)
    rows = [(i, [random.gauss(0, 1) for _ in range(3)], "x" if i % 3 else "y") for i in range(60)] + [(99, [0.0, 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, kind string")

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    expected = {(i, j) for i, a, k in rows for j, b, m in rows if i < j and k == m and cosine(a, b) >= 0.7}
    for block in (7, 1000):
        assert {(r.a, r.b) for r in similar_pairs(df, "id", 0.7, "kind", block_rows=block).collect()} == expected


def test_blocks_meet_in_strips():
    """Two whole blocks, or one with itself: all pairs, and far less memory than a similarity for each."""
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(6000, 8))
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    for side in (np.zeros(6000, np.int32), (np.arange(6000) >= 3000).astype(np.int32)):
        batch = pa.RecordBatch.from_arrays([pa.array(["0:x"] * 6000), pa.array(side), pa.array(np.arange(6000)), pa.array(list(unit))], ["key", "side", "id", "vector"])
        tracemalloc.start()
        found = {(a, b) for out in _Pairs(0.95)([batch]) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == {(a, b) for a in range(6000) for b in (a + 1 + np.flatnonzero(unit[a + 1 :] @ unit[a] >= 0.95)).tolist() if not side.any() or side[a] != side[b]}
        assert peak < 50_000_000


def test_links_of_equal_vectors_are_few(spark):
    """Repeats of a vector add a link each; components are those of all pairs, whatever the threshold."""
    rows = [(i, [1.0, 0.0], "x") for i in range(40)] + [(100 + i, [0.0, 0.0], "x") for i in range(5)] + [(200, [0.9, 0.1], "x"), (201, [0.0, 1.0], "x"), (202, [0.0, 1.0], "x"), (300, [1.0, 0.0], "y"), (301, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, kind string")
    links = similar_links(df, "id", 0.9, "kind")
    assert links.count() == 39 + 1 + 1
    for threshold in (0.9, 0.999, 1.1):
        every, few = (sorted(map(tuple, connected_components(f(df, "id", 0.9, "kind").filter(f"similarity >= {threshold} - 1e-9"), "a", "b").collect())) for f in (similar_pairs, similar_links))
        assert every == few


def test_nearest(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0])], "id long, embedding array<float>")
    assert [(r.id, r.distance) for r in nearest(df, "id", [0.0, 0.0], 2).collect()] == [(1, 0.0), (3, 1.0)]


def test_oversize_ladder(spark):
    close = [(a, b, 0.97) for a in range(1, 4) for b in range(a + 1, 4)]
    loose = [(3, 10, 0.86), (10, 11, 0.92), (11, 12, 0.86)]
    found = resolve.cluster_ladder(spark.createDataFrame(close + loose, "a long, b long, similarity double"), 0.85, 3)
    assert {r.node: r.cluster for r in found.collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 12}
    same = [(a, b, 1.0000000000000002) for a in range(11) for b in range(a + 1, 11)]
    alone = resolve.cluster_ladder(spark.createDataFrame(same, "a long, b long, similarity double"), 0.85, 10)
    assert {r.node: r.cluster for r in alone.collect()} == {i: i for i in range(11)}


def test_merges(spark, seeded):
    mapping = spark.createDataFrame([(3, 2), (2, 1)], "old_id long, survivor long")
    out = resolve.apply_merges(seeded, mapping, "later")
    ents = {e.id: e for e in out.entities.collect()}
    assert set(ents) == {1, 4, 5}
    assert json.loads(ents[1].attributes) == {"role": "it's ops", "industry": "space", "listed": True}
    assert list(json.loads(ents[1].attributes)) == ["role", "industry", "listed"]
    assert {(r.subject_id, r.predicate, r.object_id) for r in out.relations.collect()} == {(1, "works_at", 1), (1, "works_at", 4), (1, "leads", 5), (4, "runs", 5)}
    assert {m.entity_id for m in out.mentions.collect()} == {1, 4}


def test_resolution(spark, seeded):
    vectors = [(1, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [1.0, 0.0])]
    graph = seeded.with_(mention_vectors=spark.createDataFrame(vectors, seeded.mention_vectors.schema))
    out, merges = resolve.resolve(graph, client=None)
    assert merges == 1
    assert [e.canonical_name for e in out.entities.filter("entity_type = 'Person'").collect()] == ["Ana Ruiz"]
    assert resolve.resolve(out, client=None)[1] == 0
    assert resolve.resolve(seeded)[1] == 0


def test_renames_that_collide_merge(spark, seeded):
    entities = [(1, "a", "t", "{}", "", ""), (2, "b", "t", "{}", "", ""), (3, "c", "t", "{}", "", "")]
    mentions = [(1, 1, "c", 1, None, None, 1, 0.9), (2, 2, "c", 1, None, None, 1, 0.9)]
    graph = seeded.with_(entities=spark.createDataFrame(entities, seeded.entities.schema), mentions=spark.createDataFrame(mentions, seeded.mentions.schema), relations=seeded.relations.limit(0), mention_vectors=spark.createDataFrame([(1, [1.0]), (2, [1.0])], seeded.mention_vectors.schema))
    out, merges = resolve.resolve(graph)
    assert [(e.id, e.canonical_name) for e in out.entities.collect()] == [(1, "c")]
    assert merges == 2


def test_server(spark, seeded):
    embedder = HashEmbedder(16)
    texts = [r.content for r in seeded.chunks.orderBy("id").collect()]
    graph = seeded.with_(chunk_vectors=spark.createDataFrame(list(enumerate(embedder.embed(texts), 1)), seeded.chunk_vectors.schema))
    ask = lambda method, **p: server.answer({"id": 1, "method": method, "params": p}, lambda: graph, lambda: embedder)["result"]
    tool = lambda which, **a: ask("tools/call", name=which, arguments=a)["content"][0]["text"]
    assert len(ask("tools/list")["tools"]) == 7
    found = json.loads(tool("search", query=texts[1], limit=1))
    assert found[0]["document_path"] == "team.md"
    assert {e["name"] for e in found[0]["entities"]} == {"Ben Okoye", "Nadir Group"}
    assert json.loads(tool("get_entity_tool", name="Ana Ruiz"))["type"] == "Person"
    assert "not found" in tool("get_entity", name="x")
    assert len(json.loads(tool("list_entities", limit=2))) == 2
    assert len(json.loads(tool("get_neighbors", name="Ana Ruiz"))["nodes"]) == 3
    assert len(json.loads(tool("find_path", from_name="Ana Ruiz", to_name="Nadir Group"))) == 2
    assert tool("find_path", from_name="Ana Ruiz", to_name="x").startswith("No path")
    assert len(json.loads(tool("list_relations", predicate="works_at"))) == 2
    assert tool("get_schema") == "No schema yet"
    assert server.answer({"method": "notifications/initialized"}, lambda: graph, lambda: embedder) is None
    assert "error" in server.answer({"id": 2, "method": "x"}, lambda: graph, lambda: embedder)


def test_server_takes_the_arguments_and_lines_of_other_clients(seeded):
    ask = lambda line: server.answer_line(line, lambda: seeded, lambda: None)
    tool = lambda which, **a: json.loads(ask(json.dumps({"id": 1, "method": "tools/call", "params": {"name": which, "arguments": a}}))["result"]["content"][0]["text"])
    assert [e["name"] for e in tool("list_entities_tool", type="Person")] == ["Ana Ruiz", "Ben Okoye"]
    assert [e["name"] for e in tool("list_entities", entity_type="Project")] == ["Project Sol"]
    assert tool("get_entity_tool", name="Ana Ruiz", type="Person")["id"] == 1
    assert "type" in next(t for t in ask('{"id": 1, "method": "tools/list"}')["result"]["tools"] if t["name"] == "get_entity")["inputSchema"]["properties"]
    assert ask("{not json")["error"]["code"] == -32700
    assert ask("[]")["error"]["code"] == ask("3")["error"]["code"] == ask('{"id": 1, "method": "ping", "params": 3}')["error"]["code"] == -32600
    batch = ask('[{"id": 1, "method": "ping"}, {"method": "notifications/x"}, {"id": 2, "method": "nothing"}]')
    assert [(r["id"], "error" in r) for r in batch] == [(1, False), (2, True)]
    assert ask('[{"method": "notifications/x"}]') is None
    out = io.StringIO()
    server.serve(lambda: seeded, lambda: None, io.StringIO('oops\n\n{"id": 7, "method": "ping"}\n'), out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [None, 7]


def test_a_tool_call_leaves_no_tables(seeded):
    from lattice.plans import materialize

    before = list(materialize._written)
    server.answer({"id": 1, "method": "tools/call", "params": {"name": "get_neighbors", "arguments": {"name": "Ana Ruiz", "depth": 2}}}, lambda: seeded, lambda: None)
    assert materialize._written == before


def test_tables_of_the_command_line():
    text = cli.table([{"name": "Ana\nRuiz", "n": 1, "more": None}, {"name": "x" * 80, "n": 22, "more": ["é"]}])
    lines = text.splitlines()
    assert lines[0].split(" | ")[1].strip() == "n"
    assert lines[2].startswith("Ana Ruiz ")
    assert lines[3].endswith('["é"]')
    assert "…" in lines[3]
