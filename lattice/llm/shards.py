"""Sharding by weighted rendezvous hashing: every record goes to the shard with its highest score.

A record's score for a shard depends on its key and that shard only, so one more shard takes records into itself
and moves no other. Scores are weight / -ln(u), u from the MD5 of key and shard number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattice.plans.materialize import bounded_broadcast, discard, materialize

#: Rows that one task numbers.
SLOT_ROWS = 50_000


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The rendezvous score of a key (string) for a shard."""
    u = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return F.lit(float(weight)) / -F.log((u + 0.5) / 2.0**52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key, among shards 0 to len(weights) - 1; of equal scores, the higher number."""
    best = [F.struct(score(key, k, w).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    return (F.greatest(*best) if len(best) > 1 else best[0])["shard"]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * 24, grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): a row for each row of ``docs``.

    size is UTF-8 bytes plus 8. grown_shard is the shard with one more of ``grown_weight``. Slots number each shard's rows from
    0 without a gap, by doc_id (nulls first), CRC and size. A null text is empty, a very long one is read once; null ids share one key.
    Rows that repeat an id share its shard. Other columns are ignored; an empty table gives no rows.

    Rows are dealt by range over (shard, id, CRC, size, input position), so neither a shard nor a repeated id lands in
    one task, and numbered in the order of their partition; a shard's first slot in a partition is the count of its rows in
    the partitions before it.
    """
    text, n = F.coalesce(F.col(text_col).cast("string"), F.lit("")), len(weights)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    scores = [F.struct(score(key, k, w).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate([*weights, grown_weight]) if w > 0]
    slim = slim.withColumn("_all", F.array(*scores))
    slim = slim.withColumn("grown_shard", F.array_max("_all")["shard"]).withColumn("shard", F.array_max(F.filter("_all", lambda s: s["shard"] < n))["shard"]).drop("_all")
    placed = materialize(slim)
    parts = max(1, placed.count() // SLOT_ROWS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["shard", "doc_id", "text_crc32", "size", "_at"]
    dealt = placed.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = materialize(dealt.drop("_at").withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    discard(placed)
    counts = ranged.groupBy("shard", "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_start"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_n")
    first = bounded_broadcast(materialize(counts.select("shard", "_range", (before - F.col("_start")).alias("_first"))))
    slot = (F.col("_place") + F.col("_first")).cast("long").alias("slot")
    return ranged.join(first, ["shard", "_range"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
