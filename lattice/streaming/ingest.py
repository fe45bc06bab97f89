"""Continuous ingest: new Markdown files of a folder flow into the store as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattice.plans.build import ingest_scan
from lattice.sources.markdown import as_text, qualified, with_hash
from lattice.sources.store import Store


def stream_ingest(store: Store, corpus: str, config: dict, checkpoint: str, once: bool = False) -> StreamingQuery:
    """A streaming query over the ``*.md`` files of a folder; each micro-batch is one commit of changed documents.

    A batch that is replayed after a failure finds its documents unchanged and does nothing. ``once`` stops when all files are read.
    """
    _, base = qualified(store.spark, corpus)
    source = store.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    rows = as_text(source.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(base.toString()), base.toString())

    def commit(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("content", "mtime"), "mtime").alias("r")).select("path", "r.content", "r.mtime")
        ingest_scan(store, with_hash(last), config)

    out = rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
