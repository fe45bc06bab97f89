"""Tables of the knowledge graph and messages of the model boundary, as DDL."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, str] = {
    "kv": "key string, value string",
    "documents": "id bigint, path string, content_hash string, size_bytes bigint, mtime double, ingested_at string, last_extracted_hash string",
    "chunks": "id bigint, document_id bigint, chunk_index int, content string, char_start int, char_end int, token_count int",
    "extraction_runs": "id bigint, started_at string, finished_at string, model string, status string, documents_processed int, error_message string",
    "entities": "id bigint, canonical_name string, entity_type string, attributes string, created_at string, updated_at string",
    "mentions": "id bigint, entity_id bigint, surface_form string, chunk_id bigint, char_start int, char_end int, extraction_run_id bigint, confidence double",
    "relations": "id bigint, subject_id bigint, predicate string, object_id bigint, evidence_chunk_id bigint, extraction_run_id bigint, confidence double, attributes string, created_at string",
    "resolution_runs": "id bigint, started_at string, finished_at string, embedding_model string, llm_model string, similarity_threshold double, merges int, status string",
    "schema_versions": "id bigint, created_at string, llm_model string, schema_yaml string, entity_type_count int, relation_type_count int, notes string",
    "mention_vectors": "mention_id bigint, embedding array<float>",
    "chunk_vectors": "chunk_id bigint, embedding array<float>",
}

#: What an extraction answers for a chunk.
ENTITY = "struct<surface_form:string,canonical_name:string,entity_type:string,attributes:string,char_start:int,char_end:int,confidence:double>"
RELATION = "struct<subject:string,predicate:string,object:string,attributes:string,confidence:double>"
EXTRACTION = f"entities array<{ENTITY}>, relations array<{RELATION}>"


@dataclass(frozen=True)
class Graph:
    """The tables that graph operators read; each operator returns a changed copy."""

    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    mentions: DataFrame
    relations: DataFrame
    mention_vectors: DataFrame
    chunk_vectors: DataFrame
    extraction_runs: DataFrame
    resolution_runs: DataFrame
    schema_versions: DataFrame
    kv: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(**{f.name: spark.createDataFrame([], TABLES[f.name]) for f in fields(cls)})

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)
