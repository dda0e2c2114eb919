"""Keyed upserts, state changes and deletes, each over whole tables of changes.

A column `seq` of the changes gives the order in which they come; of one key the last
wins.  New ids follow the greatest there is, in the order of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.storage import settled

MAX_RETRIES = 3
#: What a failure is noted by that has no message.
NO_MESSAGE = "unknown error"


def last_of(changes: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last change of each key."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def with_ids(rows: DataFrame, keys: list[str], greatest: Column | int = 0, name: str = "id") -> DataFrame:
    """Consecutive ids after `greatest`, in the order of the keys, without one task that
    sees all rows: rows are numbered within the ranges of a sort, and each range starts
    after those before it."""
    rows = settled(rows.orderBy(*keys).withColumn("_part", F.spark_partition_id()), "ids")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_part").alias("_p"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    base = F.lit(greatest) if isinstance(greatest, int) else greatest
    return rows.join(F.broadcast(sizes), F.col("_part") == F.col("_p")).withColumn(name, (base + F.col("_before") + inside).cast("long")).drop("_part", "_p", "_before")


def greatest_id(rows: DataFrame, name: str = "id") -> int:
    return rows.agg(F.max(name)).collect()[0][0] or 0


def upsert_files(files: DataFrame, changes: DataFrame, now: Column, greatest: int | None = None) -> DataFrame:
    """changes (path, last_mod_time, content_hash, seq) put into files: ids and states
    of known paths stay, new paths are `indexed`.  `greatest`: the greatest id there is,
    where `files` are only those of the changes."""
    last = last_of(changes.select("path", "last_mod_time", "content_hash", "seq"), ["path"]).drop("seq")
    new = {c: f"_{c}" for c in ("last_mod_time", "content_hash")}
    joined = files.join(last.withColumnsRenamed(new).withColumn("_hit", F.lit(True)), "path", "left")
    updated = joined.select("id", "path", *[F.coalesce(f"_{c}", c).alias(c) for c in new], F.when(F.col("_hit"), now).otherwise(F.col("indexed_at")).alias("indexed_at"), "status", "error_message", "retry_count", "queued_at")
    fresh = with_ids(last.join(files.select("path"), "path", "left_anti"), ["path"], greatest_id(files) if greatest is None else greatest)
    fresh = fresh.select("id", "path", "last_mod_time", "content_hash", now.alias("indexed_at"), F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("retry_count"), F.lit(None).cast("timestamp").alias("queued_at"))
    return updated.unionByName(fresh)


def mark_pending(files: DataFrame, changes: DataFrame, now: Column, greatest: int | None = None) -> DataFrame:
    """changes (path, last_mod_time, content_hash, seq) put into files as pending, with
    no error and no retries."""
    after = upsert_files(files, changes, F.lit(None).cast("timestamp"), greatest)
    stamps = files.select(F.col("path").alias("_p"), F.col("indexed_at").alias("_at"))
    marked = changes.select("path").distinct().withColumn("_hit", F.lit(True))
    rows = after.join(marked, "path", "left").join(stamps, F.col("path") == F.col("_p"), "left")
    hit = F.col("_hit").isNotNull()
    return rows.select("id", "path", "last_mod_time", "content_hash", F.when(hit, F.col("_at")).otherwise(F.col("indexed_at")).alias("indexed_at"), F.when(hit, F.lit("pending")).otherwise(F.col("status")).alias("status"), F.when(~hit, F.col("error_message")).alias("error_message"), F.when(hit, F.lit(0)).otherwise(F.col("retry_count")).alias("retry_count"), F.when(hit, now).otherwise(F.col("queued_at")).alias("queued_at"))


def _changed(files: DataFrame, ids: DataFrame, **columns: Column) -> DataFrame:
    """files with columns replaced in the rows whose id is among ids."""
    hit = F.col("_hit").isNotNull()
    rows = files.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return rows.select(*[F.when(hit, columns[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in files.columns])


def mark_processing(files: DataFrame, ids: DataFrame) -> DataFrame:
    return _changed(files, ids, status=F.lit("processing"))


def mark_indexed(files: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return _changed(files, ids, status=F.lit("indexed"), error_message=F.lit(None).cast("string"), retry_count=F.lit(0), indexed_at=now)


def _failed(files: DataFrame, failures: DataFrame) -> tuple[DataFrame, Column]:
    """files with the failure's message (_m) and whether there is one: a failure without
    a message is one too.  Of a file's messages the least counts."""
    told = failures.groupBy("id").agg(F.coalesce(F.min("message"), F.lit(NO_MESSAGE)).alias("_m"))
    return files.join(told, "id", "left"), F.col("_m").isNotNull()


def mark_failed(files: DataFrame, failures: DataFrame) -> DataFrame:
    """failures (id, message): the files fail, with one more retry counted."""
    rows, hit = _failed(files, failures)
    return rows.select(*[{"status": F.when(hit, F.lit("failed")).otherwise(F.col("status")), "error_message": F.coalesce("_m", "error_message"), "retry_count": F.col("retry_count") + hit.cast("int")}.get(c, F.col(c)).alias(c) for c in files.columns])


def retry_or_fail(files: DataFrame, failures: DataFrame, now: Column, max_retries: int = MAX_RETRIES) -> DataFrame:
    """failures (id, message): a file goes back to the queue until it has failed
    max_retries times.  The count stays over the queue, so it does end."""
    rows, hit = _failed(files, failures)
    over = F.col("retry_count") + 1 >= max_retries
    made = {"status": F.when(hit & over, F.lit("failed")).when(hit, F.lit("pending")).otherwise(F.col("status")), "error_message": F.coalesce("_m", "error_message"), "retry_count": F.col("retry_count") + hit.cast("int"), "queued_at": F.when(hit & ~over, now).otherwise(F.col("queued_at"))}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in files.columns])


def reset_stuck(files: DataFrame) -> DataFrame:
    """Files left in `processing` are pending again."""
    return files.withColumn("status", F.when(F.col("status") == "processing", F.lit("pending")).otherwise(F.col("status")))


def upsert_entities(entities: DataFrame, changes: DataFrame, greatest: int | None = None) -> DataFrame:
    """changes (name, entity_type, chunk_id): what isn't there yet is added."""
    keys = ["name", "entity_type", "chunk_id"]
    fresh = changes.select(*keys).distinct().join(entities.select(*keys), keys, "left_anti")
    return entities.select("id", *keys).unionByName(with_ids(fresh, keys, greatest_id(entities) if greatest is None else greatest).select("id", *keys))


def upsert_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (source_entity_id, target_entity_id, relation_type, chunk_id, seq): of a
    source, target and chunk the last relation stands, with weight 1."""
    keys = ["source_entity_id", "target_entity_id", "chunk_id"]
    last = last_of(changes.select(*keys, "relation_type", "seq"), keys).select("source_entity_id", "target_entity_id", "relation_type", "chunk_id", F.lit(1.0).alias("weight"))
    return edges.select(*last.columns).join(last.select(*keys), keys, "left_anti").select(*last.columns).unionByName(last)


def mark_extracted(state: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """chunks (chunk_id) are marked as extracted."""
    ids = chunks.select("chunk_id").distinct()
    return state.join(ids, "chunk_id", "left_anti").unionByName(ids.select("chunk_id", F.lit(True).alias("graph_extracted"), now.alias("extracted_at")))


def delete_file(files: DataFrame, path: str) -> DataFrame:
    """files without a path; an error if it isn't there.  Chunks stay."""
    if files.filter(F.col("path") == path).isEmpty():
        raise KeyError(path)
    return files.filter(F.col("path") != path)


def delete_chunks(chunks: DataFrame, file_ids: DataFrame) -> DataFrame:
    """chunks without those of some files (file_id); entities, edges and states stay."""
    return chunks.join(file_ids.select("file_id").distinct(), "file_id", "left_anti").select(chunks.columns)


def delete_edges(edges: DataFrame, chunk_id: int) -> DataFrame:
    return edges.filter(F.col("chunk_id") != chunk_id)


def cascade(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities, edges or states of chunks that exist."""
    return rows.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select(rows.columns)


def delete_entities(entities: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without some entities (id) and what hangs on them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids, edges.source_entity_id == ids.id, "left_anti").join(ids, F.col("target_entity_id") == ids.id, "left_anti")
    return entities.join(ids, "id", "left_anti").select(entities.columns), left


def changed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """seen (path, last_mod_time, content_hash) with changed: whether it is new or differs."""
    known = files.select("path", F.col("last_mod_time").alias("_t"), F.col("content_hash").alias("_h"))
    same = F.col("_t").eqNullSafe(F.col("last_mod_time")) & F.col("_h").eqNullSafe(F.col("content_hash"))
    return seen.join(known.withColumn("_known", F.lit(True)), "path", "left").select("path", "last_mod_time", "content_hash", (F.col("_known").isNull() | ~same).alias("changed"))
