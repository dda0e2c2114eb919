"""Files of a folder as rows, and their change stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.sources.filters import index_file
from lodestrand.sources.sniff import binary


#: A longer file isn't read as one row; it counts as unreadable.
MOST_BYTES = (1 << 31) - 1024


def _plain(path) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _rows(found: DataFrame) -> DataFrame:
    return found.select(_plain(F.col("path")).alias("path"), F.unix_timestamp("modificationTime").alias("last_mod_time"), F.sha2("content", 256).alias("content_hash"), "length", "content")


def _source(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # A file that goes or fails while it is read gives no row; unreadable() tells of it.
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(path)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is that of one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def _kept(found: DataFrame, spark: SparkSession, folder: str, blacklist: list[str] | None, whitelist: list[str] | None) -> DataFrame:
    if (blacklist or whitelist) and not is_file(spark, folder):
        found = found.filter(index_file(F.col("path"), blacklist or [], whitelist or []))
    return found


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and last_mod_time of every file under a folder; none is opened."""
    return _source(spark, folder).select(_plain(F.col("path")).alias("path"), "length", F.unix_timestamp("modificationTime").alias("last_mod_time"))


def walk(spark: SparkSession, folder: str, blacklist: list[str] | None = None, whitelist: list[str] | None = None) -> DataFrame:
    """Every file under a folder: path, last_mod_time (seconds), content_hash (SHA-256),
    length, content.  A path of one file isn't filtered.  Files that can't be read are
    left out, and the others aren't touched by that."""
    return _kept(_rows(_source(spark, folder).filter(F.col("length") <= MOST_BYTES)), spark, folder, blacklist, whitelist)


def unreadable(spark: SparkSession, folder: str, blacklist: list[str] | None = None, whitelist: list[str] | None = None) -> DataFrame:
    """path and message of the files that walk() can't give."""
    read = walk(spark, folder, blacklist, whitelist).select("path")
    there = _kept(listing(spark, folder), spark, folder, blacklist, whitelist)
    why = F.when(F.col("length") > MOST_BYTES, F.lit("the file is too long")).otherwise(F.lit("the file can't be read"))
    return there.join(read, "path", "left_anti").select("path", why.alias("message"))


def some(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As walk(), of a few files by name; those that are gone give no row."""
    there = [p for p in paths if is_file(spark, p)]
    if not there:
        return _rows(spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary"))
    return _rows(_source(spark, there).filter(F.col("length") <= MOST_BYTES))


def texts(files: DataFrame) -> DataFrame:
    """Those of walk() that aren't binary, with text; bytes that aren't UTF-8 become U+FFFD."""
    return files.filter(~binary(F.col("content"))).withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))


def watch(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 5) -> DataFrame:
    """A stream of new files under a folder, a few at each trigger."""
    schema = spark.read.format("binaryFile").load(folder).schema
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger)
    return _rows(stream.load(folder))
