"""Markdown files of a folder, as a table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions.text import content_hash, normalize_newlines

SCAN = "path string, content string, content_hash string, size_bytes bigint, mtime double"


def qualified(spark: SparkSession, root: str):
    """The file system of a folder and its full path; a path without a scheme is a local one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root if "://" in root else str(Path(root).resolve()))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, files.makeQualified(path)


def as_text(files: DataFrame, base: str) -> DataFrame:
    """(path, content, mtime) of rows of binary files below a folder, dot-files and dot-folders left out; paths are relative.

    CRLF and CR become LF. Text that isn't UTF-8 is an error.
    """
    text = normalize_newlines(F.decode("content", "UTF-8"))
    out = files.select(F.substring("path", len(base.rstrip("/")) + 2, 1 << 20).alias("path"), text.alias("content"), F.col("modificationTime").cast("double").alias("mtime"))
    return out.filter(~F.col("path").rlike(r"(^|/)\."))


def with_hash(texts: DataFrame) -> DataFrame:
    """(path, content, content_hash, size_bytes, mtime) of texts."""
    return texts.select("path", "content", content_hash(F.col("content")).alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes"), "mtime")


def scan_markdown(spark: SparkSession, root: str, include: list[str] | None = None) -> DataFrame:
    """(path, content, content_hash, size_bytes, mtime) of all ``*.md`` below a folder, as :func:`as_text` has them.

    The folder is on any file system that Spark reads; only Spark's readers list and read the files. ``include`` names folders or
    files below the root; missing ones are ignored.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files, base = qualified(spark, root)
    wanted = [base] if not include else [path(base, x) for x in sorted(set(include))]
    places = [p.toString() for p in wanted if files.exists(p) and (files.getFileStatus(p).isDirectory() or p.getName().endswith(".md"))]
    if not places:
        return spark.createDataFrame([], SCAN)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(places)
    return with_hash(as_text(found, base.toString()).dropDuplicates(["path"]))
