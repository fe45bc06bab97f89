"""Exports: JSON-LD, Cypher and GraphML, as rows of text that any file sink can write."""

from __future__ import annotations

import json
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattice.functions.jsons import MEMBERS, joined, json_members, json_string, member, value_text
from lattice.plans.materialize import spread

#: Keys of a GraphML node that an attribute may not take.
RESERVED = ("label", "entity_type")
IRI = "https://lattice.local/"
# Schema.org types of common entity types, by lower-cased name.
SCHEMA_ORG = {
    "person": "schema:Person",
    "organization": "schema:Organization",
    "location": "schema:Place",
    "place": "schema:Place",
    "event": "schema:Event",
    "project": "schema:Project",
    "technology": "schema:SoftwareApplication",
    "product": "schema:Product",
}


def _members(text: Column) -> Column:
    return F.coalesce(json_members(text), F.array().cast(MEMBERS))


def _quoted(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), escaped, F.lit("'"))


def cypher_props(members: Column) -> Column:
    """A Cypher map: true and false, null, bare numbers, quoted text; other values as quoted JSON."""
    name = lambda x: F.translate(x["key"], " -", "__")
    value = lambda x: F.when(x["kind"] == "plain", x["text"]).otherwise(_quoted(x["text"]))
    inside = F.transform(members, lambda x: F.concat(name(x), F.lit(": "), value(x)))
    return F.concat(F.lit("{"), F.array_join(inside, ", "), F.lit("}"))


def _confidence_text() -> Column:
    """The confidence as a number, or null where there is none."""
    return F.when(~F.isnan("confidence"), F.col("confidence").cast("double").cast("string"))


def _confidence(key: str) -> Column:
    """A member of the confidence, where there is one."""
    some = F.array(member(key, _confidence_text(), "plain"))
    return F.when(F.col("confidence").isNotNull() & ~F.isnan("confidence"), some).otherwise(F.array().cast(MEMBERS))


def _bare() -> Column:
    """Whether a row has no attributes: its text is then put together without any parsing or merging of members."""
    return F.col("attributes").isNull() | (F.col("attributes") == "{}")


def cypher_lines(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, id, line): a CREATE statement for each entity, then for each relation whose ends exist."""
    label = F.replace("entity_type", F.lit(" "), F.lit("_"))
    props = joined(F.array(member("name", F.col("canonical_name"))), _members(F.col("attributes")))
    nodes = entities.select(F.lit("entity").alias("kind"), "id", F.concat(F.lit("CREATE (e"), F.col("id").cast("string"), F.lit(":"), label, F.lit(" "), cypher_props(props), F.lit(");")).alias("line"))
    kind = F.replace(F.upper("predicate"), F.lit(" "), F.lit("_"))
    told = joined(_members(F.col("attributes")), _confidence("confidence"))
    own = F.coalesce(F.concat(F.lit(" {confidence: "), _confidence_text(), F.lit("}")), F.lit(""))
    more = F.when(_bare(), own).when(F.size(told) > 0, F.concat(F.lit(" "), cypher_props(told))).otherwise("")
    text = F.concat(F.lit("CREATE (e"), F.col("subject_id").cast("string"), F.lit(")-[:"), kind, more, F.lit("]->(e"), F.col("object_id").cast("string"), F.lit(");"))
    return nodes.unionByName(_with_ends(relations, entities).select(F.lit("relation").alias("kind"), "id", text.alias("line")))


def _with_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose ends exist. A task holds its share of the ids, never its relations, which are neither sorted nor kept."""
    ids = entities.select("id").hint("shuffle_hash")
    return relations.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi")


def _object(*members: Column) -> Column:
    """A JSON object, ASCII-escaped."""
    pair = lambda x: F.concat(json_string(x["key"], True), F.lit(": "), value_text(x, True))
    return F.concat(F.lit("{"), F.array_join(F.transform(joined(*members), pair), ", "), F.lit("}"))


def _prefixed(text: Column) -> Column:
    return F.transform(_members(text), lambda x: F.struct(F.concat(F.lit("kg:"), x["key"]).alias("key"), x["text"].alias("text"), x["kind"].alias("kind")))


def _iri(column: str) -> Column:
    return F.concat(F.lit("kg:entity/"), F.col(column).cast("string"))


def jsonld_nodes(entities: DataFrame) -> DataFrame:
    """(id, node): a JSON-LD object for each entity, ASCII-escaped."""
    known = F.create_map(*(F.lit(x) for pair in SCHEMA_ORG.items() for x in pair))
    kind = F.coalesce(F.element_at(known, F.lower("entity_type")), F.concat(F.lit("kg:"), "entity_type"))
    own = F.array(member("@id", _iri("id")), member("name", F.col("canonical_name")), member("type", kind), member("kg:entityType", F.col("entity_type")))
    return entities.select("id", _object(own, _prefixed(F.col("attributes"))).alias("node"))


def jsonld_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, edge): a JSON-LD object for each relation whose ends exist."""
    own = F.array(member("@type", F.lit("kg:Relation")), member("kg:subject", _iri("subject_id")), member("kg:predicate", F.col("predicate")), member("kg:object", _iri("object_id")))
    whole = _object(own, _confidence("kg:confidence"), _prefixed(F.col("attributes")))
    told = F.coalesce(F.concat(F.lit(', "kg:confidence": '), _confidence_text()), F.lit(""))
    ends = [F.concat(F.lit(f', "kg:{end}": "kg:entity/'), F.col(f"{end}_id").cast("string"), F.lit('"')) for end in ("subject", "object")]
    bare = F.concat(F.lit('{"@type": "kg:Relation"'), ends[0], F.lit(', "kg:predicate": '), json_string(F.col("predicate"), True), ends[1], told, F.lit("}"))
    edge = F.when(_bare(), bare).otherwise(whole)
    return _with_ends(relations, entities).select("id", edge.alias("edge"))


def jsonld(entities: DataFrame, relations: DataFrame) -> Iterator[str]:
    """The whole document in pieces, streamed from the executors: nodes by id, then edges by id."""
    context = {"schema": "https://schema.org/", "kg": IRI, "name": "schema:name", "type": "@type"}
    yield '{\n  "@context": ' + json.dumps(context, indent=2).replace("\n", "\n  ") + ',\n  "@graph": ['
    mark = "\n"
    for df, column in ((jsonld_nodes(entities), "node"), (jsonld_edges(relations, entities), "edge")):
        for row in df.orderBy("id").toLocalIterator():
            yield mark + "    " + json.dumps(json.loads(row[column]), indent=2).replace("\n", "\n    ")
            mark = ",\n"
    yield "\n  ]\n}"


def cypher(entities: DataFrame, relations: DataFrame) -> Iterator[str]:
    for row in cypher_lines(entities, relations).orderBy("kind", "id").toLocalIterator():
        yield row["line"] + "\n"


def graphml_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, target, predicate, confidence): the edge of largest id of each ordered pair; no confidence is empty.

    One sort serves the whole choice: an aggregate of text would sort the rows before and after it is combined. A task sorts a bounded share.
    """
    rank = F.row_number().over(Window.partitionBy("subject_id", "object_id").orderBy(F.desc("id")))
    known = _with_ends(relations.select("id", "subject_id", "predicate", "object_id", "confidence"), entities)
    best = spread(known, "subject_id", "object_id").withColumn("_rank", rank).filter("_rank = 1")
    confidence = F.coalesce(F.col("confidence").cast("string"), F.lit(""))
    return best.select(F.col("subject_id").cast("string").alias("source"), F.col("object_id").cast("string").alias("target"), "predicate", confidence.alias("confidence"))


def _xml(text: Column) -> Column:
    for mark, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(escaped))
    return text


def graphml_data(entities: DataFrame) -> DataFrame:
    """(id, place, key, value): what a node carries: its label, its type, its attributes in order.

    Attributes named like a reserved key get the prefix attr_. Text stands as it is, other values as JSON.
    """
    members = F.coalesce(F.map_entries(F.from_json("attributes", "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>"))
    name = lambda k: F.when(k.isin(*RESERVED), F.concat(F.lit("attr_"), k)).otherwise(k)
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    own = F.array(pair(F.lit("label"), F.col("canonical_name")), pair(F.lit("entity_type"), F.col("entity_type")))
    more = F.transform(members, lambda e: pair(name(e["key"]), F.coalesce(e["value"], F.lit("null"))))
    return entities.select("id", F.posexplode(F.concat(own, more)).alias("place", "d")).select("id", "place", "d.key", "d.value")


def graphml_lines(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(part, id, other, line): the lines of the document in the order of the first three columns; part 0 is the head, 3 the end."""
    spark = entities.sparkSession
    keys = sorted(r[0] for r in graphml_data(entities).select("key").distinct().collect() if r[0] not in ("label", "entity_type"))
    named = [*(("node", x) for x in ("label", "entity_type", *keys)), *(("edge", x) for x in ("label", "predicate", "confidence"))]
    ids = {of: f"d{n}" for n, of in enumerate(named)}
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'  <key id="{ids[of, x]}" for="{of}" attr.name={quoteattr(x)} attr.type="string"/>' for of, x in named]
    schema = "part int, id long, other long, line string"
    top = spark.createDataFrame([(0, i, 0, x) for i, x in enumerate([*head, '  <graph edgedefault="directed">'])], schema)
    end = spark.createDataFrame([(3, 0, 0, "  </graph>"), (3, 1, 0, "</graphml>")], schema)
    known = F.broadcast(spark.createDataFrame([(x, i) for (of, x), i in ids.items() if of == "node"], "key string, place_id string"))
    data = lambda k, v: F.concat(F.lit('<data key="'), k, F.lit('">'), _xml(v), F.lit("</data>"))
    inside = F.array_sort(F.collect_list(F.struct("place", data(F.col("place_id"), F.col("value")).alias("x"))))
    nodes = graphml_data(entities).join(known, "key").groupBy("id").agg(F.array_join(F.transform(inside, lambda d: d["x"]), "").alias("x"))
    node = F.concat(F.lit('    <node id="'), F.col("id").cast("string"), F.lit('">'), "x", F.lit("</node>"))
    edges = graphml_edges(relations, entities)
    edge = F.concat(F.lit('    <edge source="'), "source", F.lit('" target="'), "target", F.lit('">'), *(data(F.lit(ids["edge", k]), F.col(c)) for k, c in (("label", "predicate"), ("predicate", "predicate"), ("confidence", "confidence"))), F.lit("</edge>"))
    zero = F.lit(0).cast("long").alias("other")
    body = nodes.select(F.lit(1).alias("part"), "id", zero, node.alias("line")).unionByName(edges.select(F.lit(2).alias("part"), F.col("source").cast("long").alias("id"), F.col("target").cast("long").alias("other"), edge.alias("line")))
    return top.unionByName(body).unionByName(end)


def graphml(entities: DataFrame, relations: DataFrame) -> Iterator[str]:
    """The whole document in pieces, streamed from the executors."""
    for row in graphml_lines(entities, relations).orderBy("part", "id", "other").toLocalIterator():
        yield row["line"] + "\n"
