"""The registered queries of the graph engine, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions.text import content_hash, strip_code_fence
from lattice.operators import export, listing, search, stats, upsert
from lattice.operators import graph as traversal
from lattice.operators.chunking import chunk
from lattice.operators.components import connected_components
from lattice.operators.resolve import apply_merges, cluster_ladder
from lattice.plans import star
from lattice.plans.build import drop_chunks
from lattice.schemas import Graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Cosine thresholds at which the embeddings table has links at all.
PAIR_THRESHOLD, LADDER_START, LADDER_SIZE = 0.35, 0.3, 10
#: Ends of the path queries.
PATH_FROM, PATH_TO = "Customer#000000001", "Customer#000000002"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    out = Graph.empty(spark)
    made = {name: getattr(star, name)(spark, sf_dir) for name in ("documents", "chunks", "entities", "mentions", "relations")}
    return out.with_(**made)


@query
def list_entities_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_entities(star.entities(spark, sf_dir), entity_type="supplier")


@query
def list_entities_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_entities(star.entities(spark, sf_dir), search="an", limit=-1)


@query
def list_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.list_relations(star.relations(spark, sf_dir), star.entities(spark, sf_dir))


@query
def list_relations_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = star.table(spark, sf_dir, "nation").agg(F.min_by("n_name", "n_nationkey")).first()[0]
    return listing.list_relations(star.relations(spark, sf_dir), star.entities(spark, sf_dir), predicate="based_in", object_name=nation, limit=-1)


@query
def entity_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _graph(spark, sf_dir)
    name = star.table(spark, sf_dir, "part").agg(F.min_by("p_name", "p_partkey")).first()[0]
    found = listing.get_entity(graph, name)
    row = lambda df, part, *c: df.select(F.lit(part).alias("part"), "id", *(F.col(x).cast("string").alias(y) for x, y in zip(c, ("a", "b", "c"), strict=True)))
    out = row(found["entity"], "entity", "canonical_name", "entity_type", "attributes").unionByName(row(found["mentions"], "mention", "surface_form", "chunk_text", "path"))
    return out.unionByName(row(found["outgoing"], "outgoing", "predicate", "object_name", "object_type")).unionByName(row(found["incoming"], "incoming", "predicate", "subject_name", "subject_type"))


@query
def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.table_counts(_graph(spark, sf_dir))


@query
def entity_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(star.entities(spark, sf_dir), "entity_type")


@query
def predicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_counts(star.relations(spark, sf_dir), "predicate")


@query
def type_vocabulary_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.vocabulary(star.entities(spark, sf_dir), "entity_type")


@query
def predicate_vocabulary_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.vocabulary(star.relations(spark, sf_dir), "predicate")


@query
def predicate_type_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.type_pairs(star.relations(spark, sf_dir), star.entities(spark, sf_dir))


@query
def attribute_key_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.attribute_frequency(star.entities(spark, sf_dir))


@query
def most_frequent_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.frequent_surface(star.mentions(spark, sf_dir))


@query
def relation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' relations repointed to one customer per nation, without evidence, so that many become equal."""
    customer = star.table(spark, sf_dir, "customer").select(star.entity_id("customer", F.col("c_custkey")).alias("subject_id"), star.entity_id("nation", F.col("c_nationkey")).alias("to"))
    repointed = star.relations(spark, sf_dir).join(customer.hint("shuffle_hash"), "subject_id").select("id", F.col("to").alias("subject_id"), "predicate", "object_id", F.lit(None).cast("long").alias("evidence_chunk_id"), "confidence")
    return stats.dedupe_relations(repointed)


@query
def vocabulary_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface forms that are no entity's name."""
    forms = star.mentions(spark, sf_dir).select(F.col("surface_form").alias("name"))
    return stats.vocabulary_gap(forms, star.entities(spark, sf_dir).select(F.col("canonical_name").alias("name")))


@query
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"))


def _chunks(spark: SparkSession, sf_dir: str, text: Column, **how) -> DataFrame:
    docs = star.table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return chunk(docs, "text", **how).select("doc_id", "chunk_index", "char_start", "char_end", "token_count", F.md5("content").alias("content_md5"))


@query
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, F.col("text"), split_on="fixed")


@query
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of the documents as a paragraph."""
    return _chunks(spark, sf_dir, F.replace("text", F.lit("\n"), F.lit("\n\n")), max_chars=1000)


@query
def chunk_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of the documents as a section of its own."""
    return _chunks(spark, sf_dir, F.replace("text", F.lit("\n"), F.lit("\n## ")), max_chars=1000, split_on="heading")


@query
def incremental_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan against a state where every third document is unknown, every fifth has another text and one is gone."""
    docs = star.table(spark, sf_dir, "documents")
    scan = docs.select(F.col("doc_id").cast("string").alias("path"), content_hash(F.col("text")).alias("content_hash"))
    state = docs.filter("doc_id % 3 != 0").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 5 == 0, "old").otherwise(content_hash(F.col("text"))).alias("content_hash"))
    return upsert.classify(scan, state).select("path", "id", "change")


@query
def embedding_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector, were vec_id a document's number."""
    chunks = star.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    return upsert.backlog(chunks, "id", star.table(spark, sf_dir, "embeddings"), "vec_id")


@query
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers known with their balance, upserted by name and type from events that name them."""
    known = star.entities(spark, sf_dir).filter("entity_type = 'supplier'").withColumns({"created_at": F.lit("t0"), "updated_at": F.lit("t0")})
    n = star.table(spark, sf_dir, "supplier").count()
    events = star.table(spark, sf_dir, "events")
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("user_id") % (n + 20)).cast("string"), 9, "0"))
    attributes = F.concat(F.lit('{"'), "event_type", F.lit('":'), F.col("event_id").cast("string"), F.lit("}"))
    found = events.select(F.col("event_id").alias("seq"), name.alias("canonical_name"), F.lit("Supplier").alias("entity_type"), attributes.alias("attributes"))
    return upsert.upsert_entities(known, found, "t1").select("canonical_name", "entity_type", "attributes", "created_at", "updated_at")


@query
def relation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by name: customers that bought a part, found by the least id of each name."""
    orders, lines = star.table(spark, sf_dir, "orders"), star.table(spark, sf_dir, "lineitem")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(star.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    subject = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    found = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), subject.alias("subject"), F.lit("bought").alias("predicate"), F.col("p_name").alias("object"), F.col("l_orderkey").cast("long").alias("evidence_chunk_id"))
    return upsert.resolve_relations(found, star.entities(spark, sf_dir)).select("seq", "subject_id", "predicate", "object_id", "evidence_chunk_id")


@query
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = search.similar_pairs(star.table(spark, sf_dir, "embeddings"), "vec_id", PAIR_THRESHOLD, "label")
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query
def similarity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = search.similar_links(star.table(spark, sf_dir, "embeddings"), "vec_id", PAIR_THRESHOLD, "label")
    return connected_components(pairs, "a", "b")


@query
def oversize_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = search.similar_links(star.table(spark, sf_dir, "embeddings"), "vec_id", LADDER_START, "label")
    return cluster_ladder(pairs, LADDER_START, LADDER_SIZE)


@query
def merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation and segment merged into the one of least id; relations repointed and deduplicated."""
    entities = star.entities(spark, sf_dir)
    customer = star.table(spark, sf_dir, "customer")
    least = customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("least"))
    mapping = customer.join(least, ["c_nationkey", "c_mktsegment"]).filter("c_custkey != least").select(star.entity_id("customer", F.col("c_custkey")).alias("old_id"), star.entity_id("customer", F.col("least")).alias("survivor"))
    graph = Graph.empty(spark).with_(entities=entities.withColumns({"created_at": F.lit(""), "updated_at": F.lit("")}), relations=star.relations(spark, sf_dir), mentions=star.mentions(spark, sf_dir))
    return apply_merges(graph, mapping).relations.select("id", "subject_id", "predicate", "object_id", "evidence_chunk_id")


@query
def semantic_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = star.table(spark, sf_dir, "embeddings")
    probe = vectors.agg(F.min_by("embedding", "vec_id")).first()[0]
    return search.nearest(vectors, "vec_id", probe, 10).select("vec_id", F.round("distance", 6).alias("distance"))


def _neighbors(spark: SparkSession, sf_dir: str, depth: int, entity_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    return traversal.neighbors(star.entities(spark, sf_dir), star.relations(spark, sf_dir), PATH_FROM, depth, entity_type)


@query
def neighbors_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbors(spark, sf_dir, 1)[0].select("name", "type", "id")


@query
def neighbors_depth2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbors(spark, sf_dir, 2)[1].select("subject", "predicate", "object", "id")


@query
def neighbors_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbors(spark, sf_dir, 3, "part")[0].select("name", "type", "id")


@query
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traversal.shortest_path(star.entities(spark, sf_dir), star.relations(spark, sf_dir), PATH_FROM, PATH_TO)
    return found if found is not None else spark.createDataFrame([], "step int, subject string, predicate string, object string")


@query
def export_cypher_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.cypher_lines(star.entities(spark, sf_dir), star.relations(spark, sf_dir))


@query
def export_jsonld_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.jsonld_nodes(star.entities(spark, sf_dir)).select("id", "node")


@query
def export_jsonld_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.jsonld_edges(star.relations(spark, sf_dir), star.entities(spark, sf_dir)).select("id", "edge")


@query
def export_graphml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.graphml_edges(star.relations(spark, sf_dir), star.entities(spark, sf_dir)).select("source", "target", "predicate", "confidence")


def _merged_parts(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts of a brand merged into the one of least id."""
    part = star.table(spark, sf_dir, "part")
    least = part.groupBy("p_brand").agg(F.min("p_partkey").alias("least"))
    mapping = part.join(least, "p_brand").filter("p_partkey != least").select(star.entity_id("part", F.col("p_partkey")).alias("old_id"), star.entity_id("part", F.col("least")).alias("survivor"))
    entities = star.entities(spark, sf_dir).withColumns({"created_at": F.lit(""), "updated_at": F.lit("")})
    graph = Graph.empty(spark).with_(entities=entities, relations=star.relations(spark, sf_dir).limit(0), mentions=star.mentions(spark, sf_dir))
    return apply_merges(graph, mapping)


@query
def merge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities after the merge of parts; attributes of merged ones are folded."""
    return _merged_parts(spark, sf_dir).entities.select("id", "canonical_name", "entity_type", "attributes")


@query
def merge_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mentions, those of merged parts repointed."""
    return _merged_parts(spark, sf_dir).mentions.select("id", "entity_id", "surface_form", "chunk_id")


@query
def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chunks nearest to a vector with path and entities; the vectors are those of the embeddings table."""
    graph, vectors = _graph(spark, sf_dir), star.table(spark, sf_dir, "embeddings")
    probe = vectors.agg(F.min_by("embedding", "vec_id")).first()[0]
    none = F.lit(None).cast("int")
    chunks = graph.chunks.withColumns({"char_start": none, "char_end": none})
    some = vectors.join(graph.chunks.select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    found = search.search_chunks(graph.with_(chunks=chunks, chunk_vectors=some.select(F.col("vec_id").alias("chunk_id"), "embedding")), probe, 10)
    named = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["name"], e["type"])), ",")
    return found.select("chunk_id", "chunk_text", "document_path", F.round("distance", 6).alias("distance"), named.alias("entities"))


@query
def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents due for extraction, were every fourth never extracted and every fourth extracted from another text."""
    docs = star.table(spark, sf_dir, "documents")
    now = content_hash(F.col("text"))
    last = F.when(F.col("doc_id") % 4 == 1, "old").when(F.col("doc_id") % 4 > 1, now)
    return upsert.stale(docs.select("doc_id", now.alias("content_hash"), last.alias("last_extracted_hash"))).select("doc_id", "content_hash")


@query
def export_graphml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.graphml_data(star.entities(spark, sf_dir))


@query
def code_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts out of the fences of a model's answer: with a language, without one, without an end, without a fence."""
    text, kind = F.trim("text"), F.col("doc_id") % 4
    fenced = F.when(kind == 0, F.concat(F.lit(" ```json\n"), text, F.lit("\n```\n"))).when(kind == 1, F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("```yaml "), text)).otherwise(text)
    return star.table(spark, sf_dir, "documents").select("doc_id", F.md5(strip_code_fence(fenced)).alias("text_md5"))


def _without_chunks(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph after every seventh chunk is gone."""
    graph = _graph(spark, sf_dir)
    return drop_chunks(graph, graph.chunks.filter("id % 7 = 0").select("id"))


@query
def drop_chunks_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_chunks(spark, sf_dir).mentions.select("id", "entity_id", "chunk_id")


@query
def drop_chunks_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_chunks(spark, sf_dir).relations.select("id", "subject_id", "predicate", "object_id", "evidence_chunk_id")


@query
def relation_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations known up to a supplier, inserted again with all others; the new ones get ids after the known."""
    supplies = star.relations(spark, sf_dir).filter("predicate = 'supplies'")
    known = supplies.filter("subject_id % 3 = 0").withColumn("id", F.col("subject_id") * 1000000 + F.col("object_id") % 1000000)
    return upsert.insert_relations(known, supplies.withColumnRenamed("id", "seq"), 10**18).select("id", "subject_id", "predicate", "object_id", "evidence_chunk_id")


@query
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of a run table, were each order a run."""
    runs = star.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderstatus").alias("status"))
    return listing.latest(runs)
