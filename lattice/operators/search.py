"""Vector search and the similarity self-join."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.functions.vectors import l2, literal
from lattice.plans.materialize import bounded_broadcast, materialize
from lattice.schemas import Graph

#: Vectors in one block of the self-join; two blocks meet in a task.
BLOCK_ROWS = 4096
#: Similarities that a task holds at once, 8 MB: two blocks meet in strips of so many.
STRIP = 1 << 20


def nearest(vectors: DataFrame, key: str, query: Sequence[float], k: int, vector_col: str = "embedding") -> DataFrame:
    """(key, distance): the ``k`` rows nearest by L2 distance, ties by key; each task keeps only its own best ``k``."""
    return vectors.select(key, l2(F.col(vector_col), literal(query)).alias("distance")).orderBy("distance", key).limit(k)


def search_chunks(graph: Graph, query: Sequence[float], k: int = 10) -> DataFrame:
    """The ``k`` chunks nearest to a vector, with document path and the distinct entities mentioned in each."""
    hits = F.broadcast(nearest(graph.chunk_vectors, "chunk_id", query, k))
    texts = graph.chunks.select(F.col("id").alias("chunk_id"), "document_id", F.col("content").alias("chunk_text"), "char_start", "char_end")
    paths = graph.documents.select(F.col("id").alias("document_id"), F.col("path").alias("document_path"))
    named = graph.entities.select(F.col("id").alias("entity_id"), F.struct(F.col("canonical_name").alias("name"), F.col("entity_type").alias("type")).alias("entity"))
    mine = graph.mentions.join(hits.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "entity_id").distinct().join(named, "entity_id")
    entities = mine.groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    out = texts.join(hits, "chunk_id").join(F.broadcast(paths.join(texts.join(hits, "chunk_id").select("document_id"), "document_id", "left_semi")), "document_id").join(entities, "chunk_id", "left")
    empty = F.array().cast("array<struct<name:string,type:string>>")
    return out.select("chunk_id", "chunk_text", "char_start", "char_end", "document_path", "distance", F.coalesce("entities", empty).alias("entities")).orderBy("distance", "chunk_id")


class _Pairs:
    """Rows (part key, side, id, vector), sorted by part: pairs of a part's sides with cosine at or above the threshold."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            cuts = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1
            for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
                if (key := keys[a].as_py()) != now:
                    yield from self.pairs(held)
                    now, held = key, []
                held.append(batch.slice(a, b - a))
        yield from self.pairs(held)

    def pairs(self, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        side, ids, unit = (np.concatenate(x) for x in zip(*((p.column(1).to_numpy(), p.column(2).to_numpy(), _unit(p.column(3))) for p in parts), strict=True))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left):
            return
        within = not len(right)
        right = left if within else right
        others, rows = unit[right].T, max(1, STRIP // len(right))
        for strip in (left[at : at + rows] for at in range(0, len(left), rows)):
            sims = unit[strip] @ others
            i, j = np.nonzero(sims >= self.threshold)
            a, b = ids[strip][i], ids[right][j]
            ok = (a < b) if within else np.ones(len(a), bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok]), pa.array(sims[i, j][ok])], ["a", "b", "similarity"])


def _unit(vectors: pa.ListArray) -> np.ndarray:
    """The vectors of a column, of one length, scaled to length 1; zero vectors stay zero."""
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def similar_links(vectors: DataFrame, key: str, threshold: float, block_col: str, vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, similarity): links with the components of :func:`similar_pairs` at the threshold and at every higher one.

    Equal vectors of a block value are linked to the least id of theirs, with similarity 1, and only that one is compared; a million
    repeats of a vector are a million links and not their square. A zero vector is like nothing, itself included.
    """
    rows = vectors.select(F.col(block_col).cast("string").alias("value"), F.col(key).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("value is not null")
    least = materialize(rows.groupBy("value", "vector").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    pairs = similar_pairs(least, "least", threshold, "value", "vector", block_rows)
    again = least.filter((F.col("n") > 1) & F.exists("vector", lambda x: x != 0)).select("value", "vector", "least")
    repeats = rows.join(bounded_broadcast(again), ["value", "vector"]).filter("id != least")
    linked = repeats.select(F.col("least").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(linked.filter(F.col("similarity") >= threshold))


def similar_pairs(vectors: DataFrame, key: str, threshold: float, block_col: str | None = None, vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, similarity): all pairs a < b of one block value with cosine similarity at or above the threshold.

    Exact. Vectors of a block value are dealt into blocks of about ``block_rows``; each pair of blocks is one bounded
    task that multiplies matrices and returns only the pairs found, so no value, however frequent, lands in one task.
    """
    value = F.col(block_col).cast("string") if block_col else F.lit("")
    rows = vectors.select(value.alias("value"), F.col(key).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("value is not null")
    cuts = materialize(rows.groupBy("value").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("cuts")))
    cut = rows.join(bounded_broadcast(cuts), "value").withColumn("own", F.pmod(F.xxhash64("id"), "cuts").cast("int"))
    left = cut.select("value", F.explode(F.expr("transform(sequence(own, cuts - 1), j -> own * cuts + j)")).alias("part"), F.lit(0).alias("side"), "id", "vector")
    right = cut.filter("own > 0").select("value", F.explode(F.expr("transform(sequence(0, own - 1), i -> i * cuts + own)")).alias("part"), F.lit(1).alias("side"), "id", "vector")
    dealt = left.unionByName(right).repartition("value", "part").sortWithinPartitions("value", "part")
    return dealt.select(F.concat_ws(":", "part", "value").alias("key"), "side", "id", "vector").mapInArrow(_Pairs(threshold), "a long, b long, similarity double")
