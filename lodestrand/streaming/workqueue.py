"""The persistent work queue: files wait in a table, and each trigger takes some.

The stages speak to each other through tables alone, so a stopped job goes on where it
was: what was being worked on is pending again, and a batch that runs twice writes the
same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lodestrand.operators import lookups, registry
from lodestrand.operators.vectors import DimensionError
from lodestrand.storage import settled
from lodestrand.store import GraphStore

INDEX_BATCH, GRAPH_BATCH, POLL = 5, 150, "5 seconds"


def enqueue(store: GraphStore, changes: DataFrame) -> None:
    """changes (path, last_mod_time, content_hash, seq) join the queue."""
    changes = settled(changes, "changes")
    if changes.isEmpty():
        return
    known = store.files.join(changes.select("path").distinct(), "path", "left_semi")
    store.merge("files", registry.mark_pending(known, changes, F.current_timestamp(), store.greatest("files")))


def recover(store: GraphStore) -> None:
    """What was being worked on when the last run stopped is pending again."""
    store.merge("files", registry.reset_stuck(store.files.filter("status = 'processing'")))


def index_once(store: GraphStore, index: Callable[[DataFrame], tuple[DataFrame, DataFrame]], limit: int = INDEX_BATCH) -> int:
    """Takes the files that wait longest through `index`, which returns their chunks
    (file_id and the rest but chunk_id) and failures (id, message); how many it took.
    Only rows of these files are written."""
    taken = lookups.pending_files(store.files, limit).select("id", "path")
    ids = [r["id"] for r in taken.collect()]  # at most `limit`
    if not ids:
        return 0
    batch = store.spark.createDataFrame([(i,) for i in ids], "id long")
    store.merge("files", registry.mark_processing(store.files.join(F.broadcast(batch), "id", "left_semi"), batch))
    mine = settled(store.files.join(F.broadcast(batch), "id", "left_semi"), "batch")
    chunks, failures = index(mine)
    failures = settled(failures.select("id", F.col("message").cast("string").alias("message")), "failures")
    done = batch.join(failures, "id", "left_anti")
    fresh = chunks.join(done.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    put_chunks(store, fresh, ["file_id", "start_line", "end_line", "content_snippet"], done.select(F.col("id").alias("file_id")))
    after = registry.mark_indexed(mine, done, F.current_timestamp())
    store.merge("files", registry.retry_or_fail(after, failures, F.current_timestamp()))
    return len(ids)


def put_chunks(store: GraphStore, chunks: DataFrame, order: list[str], file_ids: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Puts chunks in place of those of some files (file_id); ids follow `order`, and
    vectors are made after that, so that sorting moves none.  An error, and nothing
    stored, if a vector hasn't the store's dimension."""
    rows = registry.with_ids(chunks, order, store.greatest("chunks"), "chunk_id")
    rows = settled(rows if embed is None else embed(rows), "chunks")
    wrong = rows.filter(F.col("embedding").isNull() | (F.size("embedding") != store.dim)).select(F.size("embedding").alias("n")).take(1)
    if wrong:
        raise DimensionError(f"a chunk's vector has {max(0, wrong[0]['n'] or 0)} dimensions, the store {store.dim}")
    store.merge("chunks", rows, file_ids)


def extract_once(store: GraphStore, extract: Callable[[DataFrame], DataFrame], limit: int = GRAPH_BATCH) -> int:
    """Takes the first unextracted chunks through `extract`, which returns raw edges (and
    rows with `error` for chunks of which it got nothing), and marks those that went
    well; how many did."""
    chunks = lookups.needing_extraction(store.chunks, store.state, limit)
    return process_chunks(store, chunks, extract)[0]


def process_chunks(store: GraphStore, chunks: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> tuple[int, int, DataFrame]:
    """Takes chunks through `extract`: how many went well, how many edges they gave
    (repeats counted), and the failures (chunk_id, message), whose chunks stay unmarked."""
    from lodestrand.sources.extract import store_edges

    chunks = settled(chunks.join(store.files.select(F.col("id").alias("file_id"), "path"), "file_id"), "chunks")
    none = store.spark.createDataFrame([], "chunk_id long, message string")
    if chunks.isEmpty():
        return 0, 0, none
    raw = extract(chunks)
    for column, kind, value in (("seq", "bigint", F.monotonically_increasing_id()), ("error", "string", F.lit(None))):
        if column not in raw.columns:
            raw = raw.withColumn(column, value.cast(kind))
    raw = settled(raw, "edges")
    failures = raw.filter("error IS NOT NULL").groupBy("chunk_id").agg(F.min("error").alias("message"))
    raw, good = raw.filter("error IS NULL").drop("error"), chunks.select("chunk_id").distinct().join(failures, "chunk_id", "left_anti")
    good = settled(good, "good")
    # An edge's ends belong to its chunk, so only the chunks' own entities and edges matter.
    mine = lambda rows: rows.join(good, "chunk_id", "left_semi").select(rows.columns)
    entities, edges = store_edges(mine(store.entities), mine(store.edges), mine(raw), store.greatest("entities"))
    edges = settled(edges, "edges")
    store.merge("entities", entities)
    store.merge("edges", edges)
    store.merge("state", registry.mark_extracted(mine(store.state), good, F.current_timestamp()))
    return good.count(), mine(raw).count(), failures


def run_queue(store: GraphStore, changes: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Puts a stream of changes (path, last_mod_time, content_hash) into the queue."""

    def batch(rows: DataFrame, number: int) -> None:
        enqueue(store, rows.withColumn("seq", F.lit(number)))

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


class StatusListener(StreamingQueryListener):
    """Tells of every batch: its number, its rows and their rate."""

    def __init__(self, tell: Callable[[str], None] = print):
        self.tell = tell

    def onQueryStarted(self, event):
        self.tell(f"started {event.name or event.id}")

    def onQueryProgress(self, event):
        p = event.progress
        self.tell(f"batch {p.batchId}: {p.numInputRows} rows, {p.processedRowsPerSecond:.1f} a second")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.tell(f"ended {event.id}")
