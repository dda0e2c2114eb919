"""One object for what a user does: index folders, search, query the graph, see the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import lookups, registry, vectors
from lodestrand.plans.compiler import run_query
from lodestrand.render import markdown_report, status_report
from lodestrand.sources import chunker, extract, files
from lodestrand.storage import cleared, settled
from lodestrand.store import GraphStore
from lodestrand.streaming import workqueue


class Engine:
    """A store with the models that fill it.

    The embedder gives vectors of the store's dimension; without an extractor the graph
    is what the store has.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: extract.Embedder | None = None, extractor: extract.Extractor | None = None, dim: int = 768, windows: chunker.Windows | None = None):
        self.spark, self.store = spark, GraphStore.open(spark, path, dim)
        self.embedder, self.extractor = embedder or extract.HashEmbedder(dim), extractor
        self.windows = windows or chunker.Windows()

    def index_folder(self, folder: str, blacklist: list[str] | None = None, whitelist: list[str] | None = None) -> int:
        """Registers, cuts and embeds the files that are new, changed or left unfinished; how many.

        All of them are one job, however many they are, and only their rows are written.  A
        binary file is registered and has no chunks.  A file that changed has its chunks
        replaced, with new ids; files that are gone stay, as nothing says that they were
        removed for good.  Files that can't be read are left out: see unreadable().
        """
        with cleared(self.spark):
            return self._index(files.walk(self.spark, folder, blacklist, whitelist))

    def _index(self, found: DataFrame) -> int:
        store, now = self.store, F.current_timestamp()
        # A run that was cut short left files that aren't indexed: those are taken again.
        left = store.files.filter("status <> 'indexed'").select("path", F.lit(True).alias("_left"))
        changed = registry.changed_files(store.files, found).join(left, "path", "left").filter("changed OR _left")
        changed = settled(changed.select("path", "last_mod_time", "content_hash", F.lit(0).alias("seq")), "changed")
        count = changed.count()
        if not count:
            return 0
        # Ids are given first; the rows stay pending until the chunks are there.
        workqueue.enqueue(store, changed)
        mine = settled(store.files.join(changed.select("path"), "path", "left_semi"), "mine")
        ids = mine.select("id", "path")
        texts = files.texts(found).join(ids, "path").select(F.col("id").alias("file_id"), "text")
        cut = chunker.chunks(texts, "file_id", "text", self.windows).withColumnRenamed("content", "content_snippet")
        workqueue.put_chunks(store, cut, ["file_id", "start_byte"], ids.select(F.col("id").alias("file_id")), self._embed)
        store.merge("files", registry.mark_indexed(mine, ids, now))
        return count

    def _embed(self, rows: DataFrame) -> DataFrame:
        return extract.embed(rows, "content_snippet", self.embedder)

    def queue(self, path: str, blacklist: list[str] | None = None, whitelist: list[str] | None = None) -> dict[str, int]:
        """Puts the files under a folder, or one file, into the queue: how many were queued,
        how many the patterns left out, and how many can't be read."""
        with cleared(self.spark):
            found = settled(files.walk(self.spark, path, blacklist, whitelist).select("path", "last_mod_time", "content_hash"), "found")
            errors = files.unreadable(self.spark, path, blacklist, whitelist).count()
            queued, there = found.count(), files.listing(self.spark, path).count()
            workqueue.enqueue(self.store, found.withColumn("seq", F.lit(0)))
        return {"queued": queued, "skipped": there - queued - errors, "errors": errors}

    def index_batch(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Chunks with vectors of some files of the registry, and failures (id, message):
        what the work queue's index_once() takes.  A file that is gone or can't be read fails."""
        paths = [r["path"] for r in batch.select("path").collect()]  # one batch of the queue
        found = settled(files.some(self.spark, paths).join(batch.select("id", "path"), "path"), "read")
        failures = batch.join(found.select("id"), "id", "left_anti").select("id", F.lit("the file can't be read").alias("message"))
        texts = files.texts(found).select(F.col("id").alias("file_id"), "text")
        cut = chunker.chunks(texts, "file_id", "text", self.windows).withColumnRenamed("content", "content_snippet")
        return self._embed(cut), failures

    def index_once(self, limit: int = workqueue.INDEX_BATCH) -> int:
        """Indexes the files that wait longest; how many it took."""
        with cleared(self.spark):
            return workqueue.index_once(self.store, self.index_batch, limit)

    def extract_graph(self, limit: int | None = None) -> int:
        """Entities and edges of all chunks that have none yet (the first `limit`); of how
        many chunks it got them.  Chunks whose prompt fails stay for the next time."""
        if self.extractor is None:
            raise ValueError("the engine has no extractor")
        with cleared(self.spark):
            return workqueue.extract_once(self.store, lambda chunks: extract.extract(chunks, self.extractor), limit)

    def search(self, text: str, k: int = vectors.TOP, under: str | None = None, prefilter: bool = False) -> DataFrame:
        """The chunks nearest to a text."""
        return vectors.search(self.store.chunks, self.store.files, self._vector(text), k, under, prefilter, self.store.dim)

    def graph_search(self, text: str, k: int = vectors.TOP, depth: int = 1, under: str | None = None, limit: int = 10, min_weight: float = 0.5) -> DataFrame:
        """search(), each hit with up to `limit` chunks that `depth` edges or fewer lead to
        from its entities, the heaviest first."""
        store = self.store
        return vectors.search_with_relations(store.chunks, store.files, self._vector(text), k, under, store.entities, store.edges, limit, min_weight, depth)

    def hybrid_search(self, text: str, k: int = vectors.TOP, under: str | None = None, limit: int = 10, min_weight: float = 0.5) -> DataFrame:
        """graph_search() over two edges."""
        return self.graph_search(text, k, 2, under, limit, min_weight)

    def report(self, text: str, hits: DataFrame) -> str:
        """A Markdown report of hits, with their related chunks if they have any."""
        rows = hits.collect()  # `k` of them
        wanted = sorted({r["chunk_id"] for hit in rows for r in (hit["related"] if "related" in hits.columns else ())})
        ids = self.spark.createDataFrame([(i,) for i in wanted], "chunk_id long")
        known = {r["chunk_id"]: r for r in lookups.chunks_by_ids(self.store.chunks, self.store.files, ids).collect()} if wanted else {}
        return markdown_report(text, rows, known)

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.embedder.embed([text])[0]]

    def query(self, text: str, extended: bool = False, scope: str | None = None) -> DataFrame:
        """A query of the graph language."""
        return run_query(self.store, text, extended=extended, scope=scope)

    def sql(self, text: str, **args) -> DataFrame:
        """SQL over the store's tables, named in braces ({files}), and named values (:name)."""
        from lodestrand.schemas import TABLES

        tables = {name: self.store.table(name) for name in TABLES if f"{{{name}}}" in text}
        return self.spark.sql(text, args=args or None, **tables)

    def status(self) -> str:
        """Counts of all tables and of files by state."""
        store = self.store
        states = {r["status"]: r["n"] for r in lookups.count_by_status(store.files).collect()}
        return status_report(store.files.count(), store.chunks.count(), store.entities.count(), store.edges.count(), states)
