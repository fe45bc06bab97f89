"""The build: ingest, embed, extract, resolve, induce; each stage is one commit of the store."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.operators import resolve as resolution
from lattice.operators import stats
from lattice.operators.chunking import chunk
from lattice.operators.upsert import backlog, classify, insert_relations, normal_type, resolve_relations, stale, upsert_entities
from lattice.plans.ids import dense_ids
from lattice.plans.materialize import materialize
from lattice.schemas import EXTRACTION, TABLES, Graph
from lattice.sources.markdown import scan_markdown
from lattice.sources.models import Embedder
from lattice.sources.store import Store


def now() -> str:
    return datetime.now(UTC).isoformat()


def drop_chunks(graph: Graph, chunks: DataFrame) -> Graph:
    """The graph without the given chunks (id), their vectors, mentions and mention vectors; relations lose the evidence."""
    ids = chunks.select(F.col("id").alias("chunk_id"))
    gone = materialize(graph.mentions.join(ids, "chunk_id", "left_semi").select(F.col("id").alias("mention_id")))
    mark = ids.select(F.col("chunk_id").alias("evidence_chunk_id"), F.lit(True).alias("_gone"))
    relations = graph.relations.join(mark, "evidence_chunk_id", "left").withColumn("evidence_chunk_id", F.when(F.col("_gone").isNull(), F.col("evidence_chunk_id"))).select(*graph.relations.columns)
    return graph.with_(
        chunks=graph.chunks.join(ids.withColumnRenamed("chunk_id", "id"), "id", "left_anti"),
        chunk_vectors=graph.chunk_vectors.join(ids, "chunk_id", "left_anti"),
        mentions=graph.mentions.join(ids, "chunk_id", "left_anti"),
        mention_vectors=graph.mention_vectors.join(gone, "mention_id", "left_anti"),
        relations=relations,
    )


def ingest_scan(store: Store, scan: DataFrame, config: dict, prune: bool = False, at: str | None = None) -> dict[str, int]:
    """Bring a scan (path, content, content_hash, size_bytes, mtime) into the store: changed documents only.

    Documents that the scan lacks stay; ``prune`` drops them with their chunks. Returns counts of new, updated, skipped and
    chunks_created.
    """
    graph, when = store.read(), at or now()
    scan = materialize(scan)
    known = materialize(classify(scan.select("path", "content_hash"), graph.documents))
    counts = {r["change"]: r["count"] for r in known.groupBy("change").count().collect()}
    out = {k: counts.get(k, 0) for k in ("new", "updated", "skipped")} | {"chunks_created": 0}
    dropped = known.filter(F.col("change").isin("updated", *["absent"] * prune)).select(F.col("id").alias("document_id"))
    if not out["new"] and not out["updated"] and not (prune and counts.get("absent")):
        return out
    fresh = dense_ids(known.filter("change = 'new'").select("path"), ["path"], store.next_id("documents"))
    touched = known.filter("change = 'updated'").select("path", "id").unionByName(fresh)
    rows = materialize(scan.join(touched, "path"))
    documents = rows.select("id", "path", "content_hash", "size_bytes", "mtime", F.lit(when).alias("ingested_at"), F.lit(None).cast("string").alias("last_extracted_hash"))
    how = config.get("chunking", {})
    made = chunk(rows.select(F.col("id").alias("document_id"), "content"), "content", how.get("max_chars", 4000), how.get("overlap_chars", 200), how.get("split_on", "paragraph"))
    made = materialize(dense_ids(made, ["document_id", "chunk_index"], store.next_id("chunks")))
    out["chunks_created"] = made.count()
    new = {"documents": documents, "chunks": made}
    if dropped.isEmpty():  # nothing but new documents: only their rows are written
        store.commit(append=new)
        return out
    kept = graph.documents.join(known.filter(F.col("change").isin("skipped", *["absent"] * (not prune))).select("path"), "path", "left_semi")
    left = drop_chunks(graph, materialize(graph.chunks.join(dropped, "document_id", "left_semi").select("id")))
    whole = {"documents": kept, "chunks": left.chunks}
    store.commit(
        **{t: df.select(*new[t].columns).unionByName(new[t]) for t, df in whole.items()},
        chunk_vectors=left.chunk_vectors,
        mentions=left.mentions,
        mention_vectors=left.mention_vectors,
        relations=left.relations,
    )
    return out


def ingest(store: Store, corpus: str, config: dict, prune: bool = False) -> dict[str, int]:
    return ingest_scan(store, scan_markdown(store.spark, corpus, config.get("corpus", {}).get("include")), config, prune)


class _Embed:
    def __init__(self, embedder: Embedder, batch: int = 64):
        self.embedder, self.batch = embedder, batch

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(ids), self.batch):
                vectors = self.embedder.embed(texts[at : at + self.batch])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + self.batch], pa.int64()), pa.array(vectors, pa.list_(pa.float32()))], ["key", "embedding"])


def embed(store: Store, embedder: Embedder, table: str) -> int:
    """Vectors for the chunks or mentions that have none; returns how many."""
    store.check_model(embedder.model_id(), embedder.dimension())
    graph = store.read()
    rows, key, text, vectors = (graph.chunks, "chunk_id", "content", "chunk_vectors") if table == "chunks" else (graph.mentions, "mention_id", "surface_form", "mention_vectors")
    held = getattr(graph, vectors)
    todo = backlog(rows.select(F.col("id").alias(key), text), key, held, key)
    new = materialize(todo.mapInArrow(_Embed(embedder), "key long, embedding array<float>").withColumnRenamed("key", key))
    n = new.count()
    if n:
        store.commit(append={vectors: new})
    return n


class _Extract:
    """(chunk_id, entities, relations, error) for each chunk; a failed chunk has only the error.

    ``concurrency`` calls of the model run at once in a worker; answers keep the chunks' order.
    """

    def __init__(self, model, entity_types: str, predicates: str, concurrency: int = 1):
        self.model, self.entity_types, self.predicates, self.concurrency = model, entity_types, predicates, concurrency

    def one(self, content: str) -> tuple[list, list, str | None]:
        try:
            found = self.model.extract(content, self.entity_types, self.predicates)
            return found["entities"], found["relations"], None
        except Exception as e:  # the build goes on without this chunk, which stays due
            return [], [], f"{type(e).__name__}: {e}"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, whole, real = pa.string(), pa.int32(), pa.float64()
        entity = pa.struct([("surface_form", text), ("canonical_name", text), ("entity_type", text), ("attributes", text), ("char_start", whole), ("char_end", whole), ("confidence", real)])
        relation = pa.struct([("subject", text), ("predicate", text), ("object", text), ("attributes", text), ("confidence", real)])
        for b in batches:
            with ThreadPoolExecutor(self.concurrency) as pool:
                found = list(pool.map(self.one, b.column(1).to_pylist()))
            entities, relations, errors = ([x[k] for x in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(entities, pa.list_(entity)), pa.array(relations, pa.list_(relation)), pa.array(errors, text)], ["chunk_id", "entities", "relations", "error"])


def extract(store: Store, model, force: bool = False, at: str | None = None, concurrency: int = 1) -> dict[str, int]:
    """Extract all chunks of stale documents; order is by chunk id, then place in the answer.

    Mentions of a chunk that is extracted again are replaced. A document counts as extracted when one of its chunks succeeded or it
    has none. Relations find their ends among all entities, those of this run included; the rest are counted as dropped.
    """
    graph, when = store.read(), at or now()
    due = materialize(stale(graph.documents, force).select(F.col("id").alias("document_id")))
    n_docs = due.count()
    types, predicates = (stats.vocabulary(df, c).first()[0] or "(none yet)" for df, c in ((graph.entities, "entity_type"), (graph.relations, "predicate")))
    todo = graph.chunks.join(due, "document_id", "left_semi").select(F.col("id").alias("chunk_id"), "content")
    answers = materialize(todo.mapInArrow(_Extract(model, types, predicates, concurrency), f"chunk_id long, {EXTRACTION}, error string"))
    done = answers.filter("error is null")
    run = store.next_id("extraction_runs")
    ids = done.select("chunk_id")
    old = graph.mentions.join(ids, "chunk_id", "left_semi").select(F.col("id").alias("mention_id"))
    kept_mentions = graph.mentions.join(ids, "chunk_id", "left_anti")
    known_relations = graph.relations.join(ids.select(F.col("chunk_id").alias("evidence_chunk_id")), "evidence_chunk_id", "left_anti") if force else graph.relations
    seq = (F.col("chunk_id") * 1_000_000 + F.col("pos")).alias("seq")
    entities = materialize(done.select("chunk_id", F.posexplode("entities").alias("pos", "e")).select(seq, "chunk_id", "e.*"))
    relations = materialize(done.select("chunk_id", F.posexplode("relations").alias("pos", "r")).select(seq, F.col("chunk_id").alias("evidence_chunk_id"), "r.*"))
    all_entities = materialize(upsert_entities(graph.entities, entities, when, store.next_id("entities")))
    keys = all_entities.select("canonical_name", F.col("entity_type").alias("_type"), F.col("id").alias("entity_id"))
    mentions = entities.withColumn("_type", normal_type(F.col("entity_type"))).join(keys, ["canonical_name", "_type"]).withColumn("extraction_run_id", F.lit(run).cast("long"))
    mentions = materialize(dense_ids(mentions.drop("attributes", "entity_type"), ["seq"], store.next_id("mentions")))
    resolved = materialize(resolve_relations(relations, all_entities))
    resolved = resolved.withColumn("extraction_run_id", F.lit(run).cast("long")).withColumn("created_at", F.lit(when))
    before = graph.relations.count() if not force else known_relations.count()
    all_relations = materialize(insert_relations(known_relations, resolved, store.next_id("relations")))
    ok = graph.chunks.select(F.col("id").alias("chunk_id"), "document_id").join(ids, "chunk_id").select("document_id").distinct()
    bare = due.join(graph.chunks.select("document_id"), "document_id", "left_anti")
    mark = ok.unionByName(bare).distinct().select(F.col("document_id").alias("id"), F.lit(True).alias("_ok"))
    documents = graph.documents.join(mark, "id", "left").withColumn("last_extracted_hash", F.when(F.col("_ok"), F.col("content_hash")).otherwise(F.col("last_extracted_hash"))).select(*graph.documents.columns)
    status = store.spark.createDataFrame([(run, when, now(), getattr(model, "model", type(model).__name__), "completed", n_docs, None)], TABLES["extraction_runs"])
    attempts = relations.count()
    runs, mine = {"extraction_runs": status}, mentions.select(*graph.mentions.columns)
    if force or not old.isEmpty():
        vectors = graph.mention_vectors.join(old, "mention_id", "left_anti")
        store.commit(append=runs, entities=all_entities, documents=documents, mentions=kept_mentions.unionByName(mine), mention_vectors=vectors, relations=all_relations)
    else:  # chunks that were never extracted: mentions and relations are only added
        added = all_relations.filter(F.col("id") >= store.next_id("relations"))
        store.commit(append=runs | {"mentions": mine, "relations": added}, entities=all_entities, documents=documents)
    return {
        "documents_processed": n_docs,
        "entities_created": mentions.count(),
        "relations_created": attempts,
        "relations_inserted": all_relations.count() - before,
        "chunks_failed": answers.filter("error is not null").count(),
    }


def resolve(store: Store, config: dict, model=None) -> dict[str, int]:
    """Merge entities whose mentions are alike; a new run row records it."""
    how, graph, when = config.get("resolution", {}), store.read(), now()
    verify = model if how.get("llm_verify_clusters", True) else None
    threshold = how.get("similarity_threshold", 0.85)
    out, merges = resolution.resolve(graph, threshold, how.get("max_cluster_size", 10), verify, when, how.get("on_verify_error", "merge"), how.get("count_entities", False))
    kv = store.pointer()["kv"]
    run = store.spark.createDataFrame([(store.next_id("resolution_runs"), when, now(), kv.get("embedding_model", ""), getattr(model, "model", "") or "", float(threshold), merges, "completed")], TABLES["resolution_runs"])
    changed = {"entities": out.entities, "mentions": out.mentions, "relations": out.relations} if merges else {}
    store.commit(append={"resolution_runs": run}, **changed)
    return {"merges": merges}


def profile_text(graph: Graph) -> tuple[str, str]:
    """Entity and predicate statistics as text, most frequent first."""
    entities, attributes = [], {}
    for r in stats.attribute_frequency(graph.entities).orderBy("entity_type", F.desc("n"), "attribute").collect():
        attributes.setdefault(r["entity_type"], []).append(f"  - {r['attribute']}: frequency={r['frequency']:.2f}")
    for r in stats.value_counts(graph.entities, "entity_type").collect():
        entities += [f"### {r['entity_type']} ({r['n']} entities)", *attributes.get(r["entity_type"], [])]
    predicates, pairs = [], {}
    for r in stats.type_pairs(graph.relations, graph.entities).orderBy("predicate", F.desc("n"), "subject_type", "object_type").collect():
        pairs.setdefault(r["predicate"], []).append(f"  - {r['subject_type']} -> {r['object_type']}: {r['n']}")
    for r in stats.value_counts(graph.relations, "predicate").collect():
        predicates += [f"### {r['predicate']} ({r['n']} relations)", *pairs.get(r["predicate"], [])]
    return "\n".join(entities) or "(no entities yet)", "\n".join(predicates) or "(no relations yet)"


def _names(tree: object) -> set[str]:
    """All names of a tree of types, children included."""
    if not isinstance(tree, dict):
        return set()
    return set(tree).union(*(_names(v.get("children")) for v in tree.values() if isinstance(v, dict)), set())


def induce(store: Store, config: dict, model) -> dict[str, int]:
    """Append a schema version; a schema that leaves out types in use is asked for once more.

    An answer that is no mapping never replaces a schema that is one.
    """
    graph = store.read()
    if graph.entities.isEmpty():
        return {"entity_type_count": 0, "relation_type_count": 0}
    told, when = profile_text(graph), now()
    depth = config.get("induction", {}).get("hierarchy_depth", 3)
    parsed = yaml.safe_load(model.induce(*told, depth, when))
    schema = parsed if isinstance(parsed, dict) else {}
    known = lambda c, tree: graph.entities.sparkSession.createDataFrame([(n,) for n in sorted(_names(tree))], f"{c} string")

    def missing(s: dict) -> list[str]:
        pairs = ((graph.entities, "entity_type", "entity_types"), (graph.relations, "predicate", "relation_types"))
        return sorted(r[0] for df, c, k in pairs for r in stats.vocabulary_gap(df.select(c), known(c, s.get(k))).collect())

    if gap := missing(schema):
        again = yaml.safe_load(model.induce(*told, depth, when, f"The schema leaves out: {', '.join(gap)}. Write it again with these."))
        schema = again if isinstance(again, dict) else schema
    counts = {"entity_type_count": len(schema.get("entity_types") or {}), "relation_type_count": len(schema.get("relation_types") or {})}
    row = (store.next_id("schema_versions"), when, getattr(model, "model", ""), yaml.safe_dump(schema, sort_keys=False), *counts.values(), None)
    store.commit(append={"schema_versions": store.spark.createDataFrame([row], TABLES["schema_versions"])})
    return counts


def build(store: Store, corpus: str | Path, config: dict, embedder: Embedder, model) -> dict[str, dict | int]:
    """All stages in order."""
    return {
        "ingest": ingest(store, str(corpus), config),
        "chunks_embedded": embed(store, embedder, "chunks"),
        "extract": extract(store, model, concurrency=config.get("llm", {}).get("concurrency", 4)),
        "mentions_embedded": embed(store, embedder, "mentions"),
        "resolve": resolve(store, config, model),
        "induce": induce(store, config, model),
    }
