"""The star-schema tables seen as a knowledge graph.

Entities are regions, nations, customers, suppliers and parts; ids are an offset per type plus the key. Relations link
nations to regions, customers and suppliers to nations, suppliers to parts and customers to parts. A mention is a lineitem that
names its part; chunks are orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Number of each entity type and relation kind; ids are number * 10 ** 12 + key and kind * 10 ** 18 + a * 10 ** 9 + b.
TYPES = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5}
KINDS = {"located_in": 1, "customer based_in": 2, "supplier based_in": 3, "supplies": 4, "ordered": 5}


#: Schemas of the files that were read before, by path; a view over ten files then opens none of them to be planned.
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def entity_id(kind: str, key: Column) -> Column:
    return F.lit(TYPES[kind] * 10**12) + key.cast("long")


def _relation_id(kind: str, a: Column, b: Column | None = None) -> Column:
    return F.lit(KINDS[kind] * 10**18) + a.cast("long") * F.lit(10**9) + (F.lit(0) if b is None else b.cast("long"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, canonical_name, entity_type, attributes)."""

    def one(kind: str, key: str, name: str, attributes: Column) -> DataFrame:
        return table(spark, sf_dir, kind).select(entity_id(kind, F.col(key)).alias("id"), F.col(name).alias("canonical_name"), F.lit(kind).alias("entity_type"), attributes.alias("attributes"))

    part = F.concat(F.lit('{"brand":"'), "p_brand", F.lit('"'), F.when(F.col("p_size") > 25, F.concat(F.lit(',"size":'), F.col("p_size").cast("string"))).otherwise(""), F.lit("}"))
    customer = F.concat(F.lit('{"segment":"'), "c_mktsegment", F.lit('"}'))
    supplier = F.when(F.col("s_acctbal") > 0, '{"in_credit":true}').otherwise("{}")
    out = one("region", "r_regionkey", "r_name", F.lit("{}")).unionByName(one("nation", "n_nationkey", "n_name", F.lit("{}")))
    out = out.unionByName(one("customer", "c_custkey", "c_name", customer)).unionByName(one("supplier", "s_suppkey", "s_name", supplier))
    return out.unionByName(one("part", "p_partkey", "p_name", part))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, subject_id, predicate, object_id, evidence_chunk_id, confidence, attributes)."""
    none, empty = F.lit(None).cast("long"), F.lit("{}")

    def row(df: DataFrame, kind: str, subject: Column, predicate: str, obj: Column, rid: Column, evidence: Column, confidence: float | None) -> DataFrame:
        return df.select(rid.alias("id"), subject.alias("subject_id"), F.lit(predicate).alias("predicate"), obj.alias("object_id"), evidence.alias("evidence_chunk_id"), F.lit(confidence).cast("double").alias("confidence"), empty.alias("attributes"))

    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    supplies = lines.groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("evidence"))
    ordered = lines.join(orders.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.min("l_orderkey").alias("evidence"))
    c, e = F.col, entity_id
    out = row(nation, "located_in", e("nation", c("n_nationkey")), "located_in", e("region", c("n_regionkey")), _relation_id("located_in", c("n_nationkey")), none, 1.0)
    out = out.unionByName(row(customer, "customer", e("customer", c("c_custkey")), "based_in", e("nation", c("c_nationkey")), _relation_id("customer based_in", c("c_custkey")), none, 0.9))
    out = out.unionByName(row(supplier, "supplier", e("supplier", c("s_suppkey")), "based_in", e("nation", c("s_nationkey")), _relation_id("supplier based_in", c("s_suppkey")), none, 0.9))
    out = out.unionByName(row(supplies, "supplies", e("supplier", c("l_suppkey")), "supplies", e("part", c("l_partkey")), _relation_id("supplies", c("l_suppkey"), c("l_partkey")), c("evidence"), 0.8))
    return out.unionByName(row(ordered, "ordered", e("customer", c("o_custkey")), "ordered", e("part", c("l_partkey")), _relation_id("ordered", c("o_custkey"), c("l_partkey")), c("evidence"), None))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity_id, surface_form, chunk_id, confidence): a row for each lineitem."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    form = F.when(F.col("l_returnflag") == "N", F.col("p_name")).when(F.col("l_returnflag") == "A", F.upper("p_name")).otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    joined = lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_discount").join(part, F.col("l_partkey") == F.col("p_partkey"))
    rid = F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")
    return joined.select(rid.alias("id"), entity_id("part", F.col("l_partkey")).alias("entity_id"), form.alias("surface_form"), F.col("l_orderkey").cast("long").alias("chunk_id"), (F.lit(1.0) - F.col("l_discount")).alias("confidence"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, document_id, content): a row for each order; its document is the customer."""
    orders = table(spark, sf_dir, "orders")
    content = F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    return orders.select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("document_id"), content.alias("content"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path): a row for each customer."""
    customer = table(spark, sf_dir, "customer")
    return customer.select(F.col("c_custkey").cast("long").alias("id"), F.concat(F.lit("customers/"), "c_name", F.lit(".md")).alias("path"))
