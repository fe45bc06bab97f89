"""A versioned store of the graph's tables.

Each commit writes the changed tables, or only the rows added to them, to new folders and then replaces one small pointer file by
a rename. Readers keep the version they opened. The pointer also holds the next free id of each table, so ids are never used again.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.schemas import TABLES, Graph


#: Most folders of one table.
FOLDERS = 64


def _folders(pointer: dict, table: str) -> list[str]:
    """Where a table's rows are."""
    found = pointer["tables"].get(table, [])
    return [found] if isinstance(found, str) else found


class Store:
    """The store at a path of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def exists(self) -> bool:
        fs, where = self._fs(f"{self.path}/CURRENT")
        return fs.exists(where)

    def pointer(self) -> dict:
        if not self.exists():
            raise FileNotFoundError(f"no graph at {self.path}")
        fs, where = self._fs(f"{self.path}/CURRENT")
        stream = fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, pointer: dict) -> None:
        fs, where = self._fs(f"{self.path}/CURRENT")
        _, new = self._fs(f"{self.path}/CURRENT-{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        try:
            stream.write(json.dumps(pointer).encode())
        finally:
            stream.close()
        jvm = self.spark.sparkContext._jvm
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri() if where.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(where), overwrite)

    def init(self, dim: int = 384, model: str = "") -> None:
        """Create the empty store; one that is there stays as it is."""
        if not self.exists():
            self._point({"version": 0, "tables": {}, "next": {}, "kv": {"embedding_dim": str(dim), "embedding_model": model, "schema_version": "1"}})

    def read(self) -> Graph:
        pointer = self.pointer()
        made = {t: self.spark.read.schema(ddl).parquet(*_folders(pointer, t)) if t in pointer["tables"] else self.spark.createDataFrame([], ddl) for t, ddl in TABLES.items() if t != "kv"}
        return Graph(kv=self.spark.createDataFrame(sorted(pointer["kv"].items()), TABLES["kv"]), **made)

    def next_id(self, table: str) -> int:
        return self.pointer()["next"].get(table, 1)

    def commit(self, kv: dict | None = None, append: dict[str, DataFrame] | None = None, **tables: DataFrame) -> None:
        """Write the given tables, and the rows of ``append`` beside those that are there, and point to them.

        A table of ``FOLDERS`` folders is written as a whole again when rows are added.
        """
        pointer = self.pointer()
        version = pointer["version"] + 1
        for name, df, kept in [*((n, df, []) for n, df in tables.items()), *((n, df, _folders(pointer, n)) for n, df in (append or {}).items())]:
            where = f"{self.path}/tables/{name}/v={version}-{uuid.uuid4().hex[:8]}"
            columns = self.spark.createDataFrame([], TABLES[name]).schema
            rows = df.select(*(F.col(c.name).cast(c.dataType) for c in columns))
            if len(kept) >= FOLDERS:
                rows, kept = self.spark.read.schema(columns).parquet(*kept).unionByName(rows), []
            rows.write.parquet(where)
            pointer["tables"][name] = [*kept, where]
            if "id" in columns.names:
                most = self.spark.read.parquet(where).agg(F.max("id")).first()[0]
                pointer["next"][name] = max(pointer["next"].get(name, 1), (most or 0) + 1)
        pointer["version"] = version
        pointer["kv"] |= kv or {}
        self._point(pointer)

    def vacuum(self) -> int:
        """Delete the written tables that the present version doesn't point to, and return how many; older versions can't be read after it."""
        fs, top = self._fs(f"{self.path}/tables")
        pointer = self.pointer()
        kept = {self._fs(p)[1].getName() for t in pointer["tables"] for p in _folders(pointer, t)}
        old = [v.getPath() for t in (fs.listStatus(top) if fs.exists(top) else []) for v in fs.listStatus(t.getPath()) if v.getPath().getName() not in kept]
        for path in old:
            fs.delete(path, True)
        return len(old)

    def reset(self, hard: bool = False) -> None:
        """Empty the graph's tables and forget what was extracted; ``hard`` empties documents, chunks and their vectors too."""
        graph = self.read()
        gone = ["entities", "mentions", "relations", "mention_vectors", "extraction_runs", "resolution_runs", "schema_versions"]
        empty = Graph.empty(self.spark)
        tables = {t: getattr(empty, t) for t in gone + ["documents", "chunks", "chunk_vectors"] * hard}
        if not hard:
            tables["documents"] = graph.documents.withColumn("last_extracted_hash", F.lit(None).cast("string"))
        self.commit(**tables)

    def check_model(self, model: str, dim: int) -> None:
        """Record the embedding model at its first use; another one later is an error."""
        kv = self.pointer()["kv"]
        if not kv.get("embedding_model"):
            self.commit(kv={"embedding_model": model, "embedding_dim": str(dim)})
        elif kv["embedding_model"] != model:
            raise ValueError(f"the graph was embedded with {kv['embedding_model']}, not {model}")


@contextlib.contextmanager
def build_lock(folder: str) -> Iterator[None]:
    """Only one build of a corpus at a time, on the driver; the lock goes with its process."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    with open(Path(folder, "build.lock"), "a+") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            f.seek(0)
            raise RuntimeError(f"another build is running (process {f.read().strip() or 'unknown'})") from None
        f.truncate(0)
        f.write(str(os.getpid()))
        f.flush()
        yield
