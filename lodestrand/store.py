"""A store: the engine's tables in one folder, each table in immutable versions.

A version is a whole table, or a change: some rows, and the keys that they replace.  A
batch of work writes changes, so it costs what it changes and not what the store has.
Readers lay the changes since the last whole version over it; after MERGES of them the
next write is whole again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand import schemas


class StoreError(ValueError):
    """A store that can't be opened, or one that isn't sound."""


class Tables:
    """Tables by name, from anywhere: what queries and operators run on.

    A table may be given as a function, which is called when the table is first asked for.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__["_tables"]
        if name not in tables:
            raise AttributeError(name)
        if not isinstance(tables[name], DataFrame):
            tables[name] = tables[name]()
        return tables[name]


class GraphStore:
    """A folder with a subfolder for every table and, in it, one for every version.

    A write makes a new version next to the old ones, v and its number or, for a change,
    d and its number.  One counts once Spark has marked it as complete; what a failed
    writer leaves isn't read.  A store has one writer at a time: of two that take the
    same number the second fails, as the folder is there.
    """

    #: Changes that may lie over a whole version.
    MERGES = 16

    def __init__(self, spark: SparkSession, path: str, dim: int):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim

    @staticmethod
    def _check(path: str, dim: int) -> None:
        if not path:
            raise StoreError("a store needs a path")
        if dim <= 0:
            raise StoreError(f"the embedding dimension must be positive, not {dim}")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _hadoop(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def exists(self) -> bool:
        return self._fs().exists(self._hadoop("meta"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int = 768) -> GraphStore:
        """A new, empty store; an error if there is one already."""
        cls._check(path, dim)
        store = cls(spark, path, dim)
        if store.exists():
            raise StoreError(f"there is a store at {path} already")
        for name, schema in schemas.TABLES.items():
            if name != "meta":
                store.write(name, spark.createDataFrame([], schema))
        store.write("meta", spark.createDataFrame([("schema_version", schemas.SCHEMA_VERSION), ("embedding_dim", str(dim)), ("created_by", "lodestrand")], schemas.META))
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int = 768) -> GraphStore:
        """The store at a path, made if there is none; its dimension must be `dim`."""
        cls._check(path, dim)
        store = cls(spark, path, dim)
        if not store.exists():
            return cls.create(spark, path, dim)
        stored = store.get_meta("embedding_dim")
        if int(stored) != dim:
            raise StoreError(f"the store has dimension {stored}, not {dim}")
        return store

    def _versions(self, name: str) -> list[tuple[int, str]]:
        """(number, v or d) of the complete versions from the last whole one on."""
        fs, folder = self._fs(), self._hadoop(name)
        if not fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = sorted((int(d[1:]), d[0]) for d in found if d[:1] in ("v", "d") and fs.exists(self._hadoop(name, d, *(["keys"] if d[0] == "d" else []), "_SUCCESS")))
        whole = max((k for k, (_, kind) in enumerate(done) if kind == "v"), default=0)
        return done[whole:]

    def _next(self, name: str) -> int:
        """A number after all that are there, those that failed writers left included."""
        fs, folder = self._fs(), self._hadoop(name)
        found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(d[1:]) for d in found if d[:1] in ("v", "d") and d[1:].isdigit()), default=0) + 1

    def write(self, name: str, rows: DataFrame) -> None:
        """A new whole version of a table; rows may come from the version before."""
        rows.write.parquet(f"{self.path}/{name}/v{self._next(name)}")

    def merge(self, name: str, rows: DataFrame, replaced: DataFrame | None = None) -> None:
        """A change of a table: rows in place of those with the keys `replaced` (columns
        schemas.KEYS; where it isn't given, the keys of the rows themselves)."""
        keys = schemas.KEYS[name]
        path = f"{self.path}/{name}/d{self._next(name)}"
        columns = [c.strip().split(" ")[0] for c in schemas.TABLES[name].split(", ")]
        rows.select(*columns).write.parquet(f"{path}/rows")
        written = self.spark.read.parquet(f"{path}/rows") if replaced is None else replaced
        written.select(*keys).distinct().write.parquet(f"{path}/keys")  # last: its mark completes the change
        if len(self._versions(name)) > self.MERGES:
            self.write(name, self.table(name))

    def table(self, name: str) -> DataFrame:
        versions = self._versions(name)
        whole, changes = versions[0], versions[1:]
        rows = self.spark.read.parquet(f"{self.path}/{name}/v{whole[0]}")
        if changes:
            keys, on = schemas.KEYS[name], [F.col(f"_{k}") for k in schemas.KEYS[name]]
            paths = [f"{self.path}/{name}/d{n}" for n, _ in changes]
            # Of the changes that name a key the last one has its rows.
            number = F.regexp_extract(F.col("_metadata.file_path"), r"/d([0-9]+)/(?:rows|keys)/[^/]*$", 1).cast("int")
            last = self.spark.read.parquet(*[f"{p}/keys" for p in paths]).select(*[F.col(k).alias(f"_{k}") for k in keys], number.alias("_n")).groupBy(*on).agg(F.max("_n").alias("_n"))
            same = lambda left: [left[k].eqNullSafe(c) for k, c in zip(keys, on, strict=True)]
            fresh = self.spark.read.parquet(*[f"{p}/rows" for p in paths]).select("*", number.alias("_own"))
            fresh = fresh.join(last, [*same(fresh), F.col("_own") == F.col("_n")], "left_semi").drop("_own")
            rows = rows.join(last, same(rows), "left_anti").unionByName(fresh, allowMissingColumns=True)
        if name == "files":  # stores of older schemas
            for column, (kind, value) in schemas.QUEUE_COLUMNS.items():
                if column not in rows.columns:
                    rows = rows.withColumn(column, F.lit(value).cast(kind))
        return rows

    def __getattr__(self, name: str) -> DataFrame:
        if name in schemas.TABLES:
            return self.table(name)
        raise AttributeError(name)

    def vacuum(self, keep: int = 1) -> None:
        """Makes every table whole and removes all but its last versions."""
        for name in schemas.TABLES:
            if len(self._versions(name)) > 1:
                self.write(name, self.table(name))
            last = self._next(name) - keep
            for status in self._fs().listStatus(self._hadoop(name)):
                found = status.getPath().getName()
                if found[:1] in ("v", "d") and found[1:].isdigit() and int(found[1:]) < last:
                    self._fs().delete(status.getPath(), True)

    def greatest(self, name: str) -> int:
        """The greatest id that a table has, 0 if none: read off the files' statistics,
        so that giving ids doesn't read the table."""
        column = "chunk_id" if name == "chunks" else "id"
        found = 0
        for n, kind in self._versions(name):
            path = f"{self.path}/{name}/v{n}" if kind == "v" else f"{self.path}/{name}/d{n}/rows"
            found = max(found, self.spark.read.parquet(path).agg(F.max(column).alias("n")).collect()[0]["n"] or 0)
        return found

    def get_meta(self, key: str) -> str:
        found = self.meta.filter(F.col("key") == key).take(1)
        if not found:
            raise KeyError(key)
        return found[0]["value"]

    def set_meta(self, key: str, value: str) -> None:
        self.merge("meta", self.spark.createDataFrame([(key, value)], schemas.META))

    def health_check(self) -> None:
        """An error unless the version is ours and every table has its columns."""
        version = self.get_meta("schema_version")
        if version != schemas.SCHEMA_VERSION:
            raise StoreError(f"the store's schema is {version}, not {schemas.SCHEMA_VERSION}")
        for name, schema in schemas.TABLES.items():
            wanted = dict(f.strip().split(" ", 1) for f in schema.split(", "))
            missing = set(wanted) - set(self.table(name).columns)
            if missing:
                raise StoreError(f"{name} lacks {sorted(missing)}")

    def close(self) -> None:
        """Nothing is held open; a second call does no harm."""
