"""Written intermediate tables, size-checked broadcasts and skew-aware joins.

Every iterative or multi-pass operator cuts its lineage here: the intermediate is written as Parquet
below the cluster's ``spark.checkpoint.dir`` and read back, so a lost executor costs a re-read of a
shared file and never a re-computation of the whole history.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Rows a size-checked broadcast may have; at two longs a row this is some 40 MB of hash table.
BROADCAST_ROWS = 1_000_000

#: Bytes it may have, counted over its text, binary and array columns.
BROADCAST_BYTES = 1 << 27

#: Bytes of input for which :func:`spread` makes a partition.
SPREAD_BYTES = 1 << 22

#: A key is heavy when it has over 1/HEAVY of all rows, so there are fewer than HEAVY heavy keys.
HEAVY = 1_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattice-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a plan without history."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._lattice_path = path
    return out


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself if it only reads, picks and filters the rows of files, else written, so that reading it again computes nothing again."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return materialize(df) if any(x in plan for x in ("Join", "Aggregate", "Union", "Generate", "Window", "MapInArrow", "LocalRelation")) else df


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that no plan reads any more."""
    if path := getattr(df, "_lattice_path", None):
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end the tables that :func:`materialize` wrote inside; their rows must have been read by then."""
    before = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[before:]:
            _delete(spark, path)
        del _written[before:]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone; the cluster then empties its own folder
            _delete(spark, path)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows and ``most`` bytes, else as it is."""
    few = df.limit(rows + 1)
    wide = {f.name: F.octet_length(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (StringType, BinaryType))}
    wide |= {f.name: F.size(f"`{f.name}`") * 16 for f in df.schema.fields if isinstance(f.dataType, ArrayType)}
    size = F.coalesce(F.sum(sum((F.coalesce(c, F.lit(0)).cast("long") for c in wide.values()), F.lit(16))), F.lit(0))
    n, held = few.agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= rows and held <= most else df


def spread(df: DataFrame, *keys: str, most: int = SPREAD_BYTES) -> DataFrame:
    """``df`` dealt by the keys into a partition for every ``most`` bytes of the files that it reads, if these are more than the session's partitions.

    What a task sorts then stays the same when the files grow. Leaves of unknown size count nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    n = sum(x for x in sizes if x < 1 << 50) // most
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def heavy_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Keys with over 1/HEAVY of the sum of ``n``: fewer than HEAVY rows, whatever the data."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("_total")).first()["_total"]
    return counts.filter(F.col(n) * HEAVY > F.lit(total)).select(key)


def lookup_join(rows: DataFrame, table: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Left join of ``rows`` with ``table`` (unique in ``key``), heavy keys by broadcast, others by shuffle.

    A key that holds a third of all rows then never meets in one task: its rows stay where they are.
    """
    mark = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    tagged = rows.join(mark, key, "left")
    hot = tagged.filter(F.col("_heavy")).drop("_heavy").join(F.broadcast(table.join(mark.drop("_heavy"), key, "left_semi")), key, "left")
    cold = tagged.filter(F.col("_heavy").isNull()).drop("_heavy").join(table, key, "left")
    return hot.unionByName(cold)
