"""Lookups, semi and anti joins, and counts over the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = 100
PLAIN_CHUNK = ("chunk_id", "file_id", "content_snippet", "start_line", "end_line")


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def file_by_id(files: DataFrame, file_id: int) -> DataFrame:
    return files.filter(F.col("id") == file_id)


def list_files(files: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of files in order of path; a limit of 0 or less is 100."""
    return files.orderBy("path").offset(max(0, offset)).limit(limit if limit > 0 else PAGE)


def pending_files(files: DataFrame, limit: int) -> DataFrame:
    """The files that wait longest."""
    return files.filter(F.col("status") == "pending").orderBy("queued_at", "id").limit(limit)


def chunk(chunks: DataFrame, chunk_id: int) -> DataFrame:
    return chunks.select(*PLAIN_CHUNK).filter(F.col("chunk_id") == chunk_id)


def chunks_of_file(chunks: DataFrame, file_id: int) -> DataFrame:
    return chunks.select(*PLAIN_CHUNK).filter(F.col("file_id") == file_id).orderBy("chunk_id")


def all_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select(*PLAIN_CHUNK).orderBy("chunk_id")


def chunks_with_paths(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.select(*PLAIN_CHUNK).join(files.select(F.col("id").alias("file_id"), "path"), "file_id").orderBy("chunk_id")


def chunks_by_ids(chunks: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks whose id is among ids (chunk_id), with paths, in order of id."""
    wanted = chunks.select(*PLAIN_CHUNK).join(ids.select("chunk_id"), "chunk_id", "left_semi")
    return chunks_with_paths(wanted, files)


def entities_by_name(entities: DataFrame, name: str) -> DataFrame:
    return entities.filter(F.col("name") == name)


def entities_by_type(entities: DataFrame, entity_type: str) -> DataFrame:
    return entities.filter(F.col("entity_type") == entity_type).orderBy("name", "id")


def entity_edges(edges: DataFrame, entity_id: int) -> DataFrame:
    """Edges at an entity, either way, the heaviest first."""
    at = (F.col("source_entity_id") == entity_id) | (F.col("target_entity_id") == entity_id)
    return edges.filter(at).orderBy(F.col("weight").desc(), "source_entity_id", "target_entity_id", "chunk_id")


def related_entities(entities: DataFrame, edges: DataFrame, of: DataFrame, relation: str | None = None) -> DataFrame:
    """Distinct entities one edge, in either direction, from those in of (id), but
    themselves; of_id names which.  Two equi-joins in place of one join with OR."""
    kept = edges if relation is None else edges.filter(F.col("relation_type") == relation)
    a = kept.select(F.col("source_entity_id").alias("of_id"), F.col("target_entity_id").alias("id"))
    b = kept.select(F.col("target_entity_id").alias("of_id"), F.col("source_entity_id").alias("id"))
    near = a.union(b).filter("of_id <> id").join(of.select(F.col("id").alias("of_id")), "of_id", "left_semi").distinct()
    return near.join(entities, "id").select("of_id", *entities.columns)


def needing_extraction(chunks: DataFrame, state: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks that aren't marked as extracted, in order of id."""
    done = state.filter("graph_extracted").select("chunk_id")
    rows = chunks.select(*PLAIN_CHUNK).join(done, "chunk_id", "left_anti").orderBy("chunk_id")
    return rows if limit is None else rows.limit(limit)


def count_rows(rows: DataFrame, name: str = "n") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias(name))


def count_by_status(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def extraction_stats(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """total, extracted (marks of chunks that are gone count too), pending (never under 0)."""
    total = chunks.agg(F.count(F.lit(1)).alias("total"))
    done = state.filter("graph_extracted").agg(F.count(F.lit(1)).alias("extracted"))
    both = total.withColumn("k", F.lit(1)).join(done.withColumn("k", F.lit(1)), "k")
    return both.select("total", "extracted", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("extracted")).alias("pending"))


def symbol_links(entities: DataFrame) -> DataFrame:
    """Extension: entities of one name and type in different chunks, linked to the first of them."""
    first = entities.groupBy("name", "entity_type").agg(F.min_by("id", F.struct("chunk_id", "id")).alias("first_id"), F.count_distinct("chunk_id").alias("n")).filter("n > 1")
    return entities.join(first.drop("n"), ["name", "entity_type"]).filter("id <> first_id").select("first_id", "id")
