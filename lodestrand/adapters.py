"""The star-schema tables as a property graph, a file registry, chunks and vectors."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.store import Tables

#: Where each type's ids begin.
BASE = {"REGION": 1_000_000_000, "NATION": 2_000_000_000, "CUSTOMER": 3_000_000_000, "SUPPLIER": 4_000_000_000, "PART": 5_000_000_000, "ORDER": 6_000_000_000}
SOURCES = {"REGION": ("region", "r_regionkey", "r_name"), "NATION": ("nation", "n_nationkey", "n_name"), "CUSTOMER": ("customer", "c_custkey", "c_name"), "SUPPLIER": ("supplier", "s_suppkey", "s_name"), "PART": ("part", "p_partkey", "p_name"), "ORDER": ("orders", "o_orderkey", None)}
#: What keeps the trade graph sparse.
TRADE_QUANTITY, TRADE_PRICE = 49, 480_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_id(kind: str, key: str | Column) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("long") + F.lit(BASE[kind])


def graph(spark: SparkSession, sf_dir: str) -> Tables:
    """entities, edges, chunks, files and state over a data directory.

    Plans only: of each table the columns that a query needs are read, and the number
    of documents, from which chunk ids come, is read off the files' metadata.
    """
    t = lru_cache(None)(lambda name: load(spark, sf_dir, name))
    docs = t("documents")
    n = max(1, docs.count())
    union = lambda frames: reduce(DataFrame.unionByName, frames)

    def nodes(kind: str) -> DataFrame:
        table, key, name = SOURCES[kind]
        label = F.col(name) if name else F.concat(F.lit("ORDER"), F.col(key).cast("string"))
        return t(table).select(node_id(kind, key).alias("id"), label.alias("name"), F.lit(kind).alias("entity_type"), F.pmod(F.col(key).cast("long"), F.lit(n)).alias("chunk_id"))

    def edges(rows: DataFrame, relation: str, a: str, source: str, b: str, target: str) -> DataFrame:
        return rows.select(node_id(a, source).alias("source_entity_id"), node_id(b, target).alias("target_entity_id"), F.lit(relation).alias("relation_type"), F.pmod(F.col(source).cast("long"), F.lit(n)).alias("chunk_id"), F.lit(1.0).alias("weight"))

    def all_relations() -> DataFrame:
        lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
        sold = lines.filter(F.col("l_quantity") >= TRADE_QUANTITY).join(t("orders").filter(F.col("o_totalprice") > TRADE_PRICE).select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        sold = sold.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        all_edges = [
            edges(t("nation"), "within", "NATION", "n_nationkey", "REGION", "n_regionkey"),
            edges(t("customer"), "livesin", "CUSTOMER", "c_custkey", "NATION", "c_nationkey"),
            edges(t("supplier"), "basedin", "SUPPLIER", "s_suppkey", "NATION", "s_nationkey"),
            edges(t("orders"), "places", "CUSTOMER", "o_custkey", "ORDER", "o_orderkey"),
            edges(lines.select("l_orderkey", "l_partkey").distinct(), "contains", "ORDER", "l_orderkey", "PART", "l_partkey"),
            edges(lines.select("l_suppkey", "l_partkey").distinct(), "supplies", "SUPPLIER", "l_suppkey", "PART", "l_partkey"),
            edges(sold.select("s_nationkey", "c_nationkey").distinct(), "trades", "NATION", "s_nationkey", "NATION", "c_nationkey"),
        ]
        return union(all_edges)

    files = lambda: docs.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("n_chars").alias("last_mod_time"),
        F.sha2("text", 256).alias("content_hash"),
        F.lit(None).cast("timestamp").alias("indexed_at"),
        F.element_at(F.array(*map(F.lit, ("indexed", "pending", "processing", "failed"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")).alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.pmod("doc_id", F.lit(3)).cast("int").alias("retry_count"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("doc_id") * 7919, F.lit(100_003))).alias("queued_at"),
    )
    chunks = lambda: docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), F.col("text").alias("content_snippet"), F.lit(1).alias("start_line"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int").alias("end_line"))
    vectors = lambda: t("embeddings").select(F.col("vec_id").alias("chunk_id"), F.pmod("vec_id", F.lit(n)).alias("file_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("content_snippet"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "embedding")
    state = lambda: docs.filter(F.pmod("doc_id", F.lit(3)) != 0).select(F.col("doc_id").alias("chunk_id"), (F.pmod("doc_id", F.lit(3)) == 1).alias("graph_extracted"), F.lit(None).cast("timestamp").alias("extracted_at"))
    return Tables(entities=lambda: union([nodes(k) for k in BASE]), edges=all_relations, files=files, chunks=chunks, vectors=vectors, state=state)


def conversations(spark: SparkSession, sf_dir: str) -> Tables:
    """Turns as entities, each followed by the next: chains without cycles."""
    turns = load(spark, sf_dir, "conversations")
    key = lambda shift: F.col("conv_id") * 1000 + F.col("turn") + shift
    entities = turns.select(key(0).alias("id"), F.col("role").alias("name"), F.upper("role").alias("entity_type"), F.col("conv_id").alias("chunk_id"))
    edges = turns.filter("turn > 0").select(key(-1).alias("source_entity_id"), key(0).alias("target_entity_id"), F.lit("follows").alias("relation_type"), F.col("conv_id").alias("chunk_id"), F.lit(1.0).alias("weight"))
    return Tables(entities=entities, edges=edges)
