"""The loop that keeps a store up to date: watched folders, the queue, both stages.

A poll reads of the watched folders what was modified since the poll before, so a file
that is rewritten is seen again.  A file must have been quiet for the debounce time; one
that isn't waits for a later poll.  All state is in the store, so a stopped daemon goes on
where it was.
"""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import registry
from lodestrand.sources import files
from lodestrand.sources.filters import daemon_filter
from lodestrand.storage import cleared, settled
from lodestrand.streaming import workqueue

#: Seconds without a change, and seconds that clocks and stamps may differ by.
DEBOUNCE, SLACK = 1.0, 2


class Watcher:
    """Folders whose new and rewritten files are told."""

    def __init__(self, spark: SparkSession, debounce: float = DEBOUNCE):
        self.spark, self.debounce, self._seen = spark, debounce, {}

    def watch(self, folder: str) -> None:
        """From the next poll on; a second call does nothing."""
        self._seen.setdefault(os.path.abspath(folder) if "://" not in folder else folder, None)

    def unwatch(self, folder: str) -> None:
        self._seen.pop(os.path.abspath(folder) if "://" not in folder else folder, None)

    def watched(self) -> list[str]:
        return sorted(self._seen)

    def close(self) -> None:
        """Watches nothing any more; a second call does no harm."""
        self._seen.clear()

    def poll(self) -> DataFrame | None:
        """path, last_mod_time, content_hash of files that were modified since the poll
        before and are quiet by now; None where nothing is watched.  A file may be told
        twice, and is never missed."""
        out, now = None, time.time()
        quiet = F.unix_millis("modificationTime") <= int((now - self.debounce) * 1000)
        for folder in self.watched():
            source = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
            if self._seen[folder] is not None:
                after = datetime.fromtimestamp(self._seen[folder] - SLACK - self.debounce, timezone.utc)
                source = source.option("modifiedAfter", f"{after:%Y-%m-%dT%H:%M:%S}").option("timeZone", "UTC")
            found = files._rows(source.load(folder).filter(quiet & (F.col("length") <= files.MOST_BYTES))).select("path", "last_mod_time", "content_hash")
            found = settled(found, "changes")
            self._seen[folder] = now
            out = found if out is None else out.unionByName(found)
        return out


class Daemon:
    """An engine whose store follows folders.

    include: the folders; exclude: folders within them, by name, glob or path; blacklist
    and whitelist: patterns of files' paths.
    """

    def __init__(self, engine, include: list[str], exclude: list[str] = (), blacklist: list[str] = (), whitelist: list[str] = (), debounce: float = DEBOUNCE, tell: Callable[[str], None] = lambda line: None):
        self.engine, self.tell = engine, tell
        self.include, self.exclude = [os.path.abspath(p) for p in include], list(exclude)
        self.blacklist, self.whitelist = list(blacklist), list(whitelist)
        self.watcher = Watcher(engine.spark, debounce)
        for folder in self.include:
            self.watcher.watch(folder)
        workqueue.recover(engine.store)

    def changes(self) -> int:
        """Puts what has changed into the queue; how many files."""
        with cleared(self.engine.spark):
            return self._queue(self.watcher.poll())

    def _queue(self, found: DataFrame | None) -> int:
        if found is None:
            return 0
        wanted = found.filter(daemon_filter(F.col("path"), self.include, self.exclude, self.blacklist, self.whitelist))
        changed = registry.changed_files(self.engine.store.files, wanted.distinct()).filter("changed").drop("changed")
        changed = settled(changed.withColumn("seq", F.col("last_mod_time")), "queued")
        workqueue.enqueue(self.engine.store, changed)
        return changed.count()

    def step(self) -> dict[str, int]:
        """One poll: files queued, files taken from the queue, chunks whose relations were read."""
        done = {"queued": self.changes(), "indexed": self.engine.index_once(workqueue.INDEX_BATCH)}
        done["extracted"] = self.engine.extract_graph(workqueue.GRAPH_BATCH) if self.engine.extractor is not None else 0
        return done

    def run(self, stop: threading.Event, poll: float = 5.0) -> None:
        """Polls until it is told to stop.  A poll that fails is told and the next one tries again."""
        while not stop.is_set():
            try:
                done = self.step()
                if any(done.values()):
                    self.tell(", ".join(f"{k} {n}" for k, n in done.items()))
            except Exception as e:
                self.tell(f"failed: {e}")
            stop.wait(poll)
        self.watcher.close()
