"""Line de-duplication by site-relative frequency.

A line's frequency is the number of a host's pages that contain it over the number of the host's pages; lines whose frequency
exceeds a ratio are boilerplate and go. Lines are compared by a 128-bit hash of host and trimmed text, counted in the workers
before the shuffle. The keys of boilerplate lines are sent to the workers when counted to be few, else each line
meets them in a join whose hot keys are broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.words import map_docs, raw, sliced
from lattice.plans.materialize import bounded_broadcast, heavy_keys, lookup_join, materialize

RATIO = 0.1
#: A line on fewer pages of a host is never boilerplate there: a line that doesn't repeat says nothing of its host.
LEAST_PAGES = 2
#: Most boilerplate lines whose keys are sent to every worker; some 100 bytes each as Python objects.
SENT = 250_000
LINES = "array<struct<at:int,key:binary,line:binary>>"


def line_key(host: bytes, bare: bytes) -> bytes:
    return xxhash.xxh3_128_digest(host + b"\n" + bare)


class _Count:
    """(host, key, n_pages) over rows (host, text): each line once a page, summed over a batch."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts: Counter[tuple[bytes, bytes]] = Counter()
            for host, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.update((host, line_key(host, x)) for x in set(map(bytes.strip, text.split(b"\n"))) if x)
            hosts, keys = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.binary()), pa.array(keys, pa.binary()), pa.array(counts.values(), pa.int64())], ["host", "key", "n"])


def boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, key, n_pages, frequency): the boilerplate lines of every host by their hashes; host is in UTF-8 bytes."""
    host = raw(host_col)
    totals = materialize(docs.groupBy(host.alias("host")).agg(F.count("*").alias("total")))
    counts = docs.select(host, raw(text_col)).mapInArrow(_Count(), "host binary, key binary, n long")
    found = counts.groupBy("host", "key").agg(F.sum("n").alias("n_pages")).filter(F.col("n_pages") >= least_pages)
    found = found.join(bounded_broadcast(totals), "host").select("host", "key", "n_pages", (F.col("n_pages") / F.col("total")).alias("frequency"))
    return found.filter(F.col("frequency") > ratio)


def drop_lines(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", sent: int = SENT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every row of ``docs`` with its boilerplate lines removed.

    n_lines counts the lines with a word. Other lines stay in order and unchanged; blank lines stay. A null text is empty, null hosts form
    one host; very long texts are taken whole. A line is boilerplate of a host when it is on at least ``least_pages`` of its
    pages and on more than ``ratio`` of them. Repeated rows count as pages of their own, ids may be null. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    found = materialize(boilerplate(docs, ratio, least_pages, text_col, host_col).select("key", "n_pages"))
    rows = [F.col(id_col).cast("long"), raw(host_col), raw(text_col)]
    if found.limit(sent + 1).count() <= sent:
        known = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r["key"]) for r in found.select("key").collect()))

        def each(doc: int | None, host: bytes, text: bytes) -> tuple:
            bad, kept, n = known.value, [], 0
            lines = text.split(b"\n")
            for x in lines:
                bare = x.strip()
                n += bool(bare)
                if not bare or line_key(host, bare) not in bad:
                    kept.append(x)
            return doc, n, len(lines) - len(kept), text if len(kept) == len(lines) else b"\n".join(kept)

        out = map_docs(docs, rows, "doc_id long, n_lines long, n_dropped long, text binary", each)
    else:
        out = _by_join(docs.select(*(c.alias(n) for c, n in zip(rows, ("doc_id", "host", "text"), strict=True))), found)
    return out.withColumn("text", F.col("text").cast("string"))


def _by_join(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The same by a join of all lines with the boilerplate keys; a row's lines, which are its text, meet again by its number."""

    def split(row: int, doc: int | None, host: bytes, text: bytes) -> tuple:
        return row, doc, [{"at": i, "key": line_key(host, bare) if (bare := x.strip()) else None, "line": x} for i, x in enumerate(text.split(b"\n"))]

    numbered = materialize(pages.select(F.monotonically_increasing_id().alias("row"), "doc_id", "host", "text"))
    lines = map_docs(numbered, [F.col(c) for c in numbered.columns], f"row long, doc_id long, lines {LINES}", split).select("row", "doc_id", F.inline("lines"))
    marked = lookup_join(lines, found.select("key", F.lit(True).alias("bad")), "key", heavy_keys(found, "key", "n_pages"))
    stays = F.array_sort(F.collect_list(F.when(F.col("bad").isNull(), F.struct("at", F.col("line").cast("string").alias("line")))))
    return marked.groupBy("row", "doc_id").agg(F.count("key").alias("n_lines"), F.count("bad").alias("n_dropped"), F.array_join(F.transform(stays, lambda x: x["line"]), "\n").cast("binary").alias("text")).drop("row")
