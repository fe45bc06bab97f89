"""Dense, increasing ids without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattice.plans.materialize import materialize


def dense_ids(df: DataFrame, order: list[str], start: int, column: str = "id") -> DataFrame:
    """``df`` with ids start, start + 1, ... in the order given; ties are numbered as the input has them.

    Rows are dealt by range and counted; a range's first id is the count of the rows before it.
    """
    ranged = materialize(df.withColumn("_id_at", F.monotonically_increasing_id()).repartitionByRange(*order, "_id_at").withColumn("_id_range", F.spark_partition_id()))
    counts = ranged.groupBy("_id_range").agg(F.count("*").alias("_id_n"))  # a row for each range
    first = counts.select("_id_range", (F.sum("_id_n").over(Window.orderBy("_id_range")) - F.col("_id_n")).alias("_id_first"))
    within = F.row_number().over(Window.partitionBy("_id_range").orderBy(*order, "_id_at")) - 1
    out = ranged.withColumn("_id_within", within).join(F.broadcast(first), "_id_range")
    return out.withColumn(column, (F.col("_id_first") + F.col("_id_within") + start).cast("long")).drop("_id_at", "_id_range", "_id_within", "_id_first")
