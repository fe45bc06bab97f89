"""Shared text handling of the operators: bytes in, words out.

``bytes.split()`` cuts at exactly the bytes 09-0D and 20, and ``bytes.lower()`` changes exactly A-Z; no byte
of a multi-byte UTF-8 character is below 80, so both work on encoded text without decoding it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every byte outside 0-9, a-z and 80-FF into a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Bytes of text that are Python objects at once; an Arrow batch may hold far more.
SLICE = 1 << 22


def raw(name: str) -> Column:
    """A text column as bytes; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def map_docs(docs: DataFrame, columns: list[Column], schema: str, each: Callable[..., tuple | None]) -> DataFrame:
    """Apply ``each`` to every row of ``columns`` in Arrow batches; a None result gives no row."""
    return docs.select(*columns).mapInArrow(_Rows(each, schema), schema)


class _Rows:
    def __init__(self, each: Callable, schema: str):
        self.each, self.schema = each, schema

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = arrow_schema(self.schema)
        for batch in sliced(batches):
            rows = [r for r in map(self.each, *(c.to_pylist() for c in batch.columns)) if r is not None]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kinds, strict=True)], schema=kinds)


def sliced(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
                size += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string as this package writes them."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    fields = lambda spec: [(n, kinds[k]) for n, k in (x.split(":") for x in spec.split(","))]
    of = lambda kind: pa.list_(pa.struct(fields(kind[13:-2]))) if kind.startswith("array<struct<") else kinds[kind]
    return pa.schema([(name, of(kind)) for name, kind in (x.split() for x in ddl.split(", "))])


def drop_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not in ``ids``, all columns as they were; rows with a null key stay.

    The ids are broadcast when counted to be few, else the join shuffles all rows but those with a null key, which would meet in one task.
    """
    from lattice.plans.materialize import BROADCAST_ROWS

    named = ids.select(key).distinct()
    if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(named), key, "left_anti").select(*docs.columns)
    some = docs.filter(F.col(key).isNotNull()).join(named, key, "left_anti").select(*docs.columns)
    return some.unionByName(docs.filter(F.col(key).isNull()))
