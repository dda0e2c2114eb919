"""The corpus pipeline: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents; the last returns the mix.  A stage's table goes to the shared folder, so a
lost executor costs no more than its own tasks, and a failed stage can run again from
the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm import decontaminate, mixing, quality_rules, secrets, similar
from lodestrand.llm.common import free_name, table
from lodestrand.storage import cleared, remove, settled_at

#: Near duplicates in the pipeline: sets of five-word shingles with a similarity of 0.8
#: or more; the radius is that of the search for candidates.
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, similar.RADIUS
#: What the last stage tells of each document besides its own columns.
MIXED = ("size", "source_size", "target", "taken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trusted ones are those labelled 1.

    Null, empty and short texts go, as they have too few words; a long text is judged
    whole, repeated rows and null ids each by their text.  Other columns, whatever their
    names, come along unread; of an empty table nothing is left, and without labels no
    ratio is low.
    """
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"))
    model = quality_rules.fit(docs, trusted)
    threshold = quality_rules.calibrate(docs, trusted, model)
    judged = quality_rules.assess(docs.select(F.struct("*").alias("doc"), "text"), model, threshold=threshold)
    return judged.filter("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the least id, then the least text hash.

    Null and empty texts are one group; a long text is compared whole.  Other columns,
    whatever their names, come along; an empty table stays empty.  Rows are told apart by their own numbers, so those that share an id count each by
    its text.  Rows without an id are deduplicated among themselves: a group keeps one
    with an id and one without.
    """
    rows, groups, row = similar.grouped(docs, size=SHINGLE, similarity=SIMILARITY, radius=RADIUS)
    of_rows = rows.select(F.col(row).alias("_id"), "doc_id", F.xxhash64("text").alias("_hash")).join(groups, F.col("_id") == F.col("_r"))
    first = of_rows.groupBy("_g", F.isnull("doc_id")).agg(F.min(F.struct("doc_id", "_hash", "_id")).alias("_first")).select(F.col("_first._id").alias("_id"))
    return rows.join(first, F.col(row) == F.col("_id"), "left_semi").drop(row)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none and stay, a long text is searched whole, repeated rows
    and null ids go or stay each by their text.  Other columns come along; an empty table
    stays empty, and without items all stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text.

    A null text stays null and an empty one empty, with their n_chars; a long text is
    scanned whole, repeated rows and null ids each by their text.  Other columns, whatever
    their names, come along; an empty table stays empty.
    """
    marked = secrets.redact_docs(docs)
    if "n_chars" in marked.columns:
        kind = docs.schema["n_chars"].dataType
        marked = marked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars"))).select(docs.columns)
    return marked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the documents that it takes words of, with their texts, size, source_size,
    target, taken, epochs (whole passes) and rest_words (words of the last, cut pass).

    Documents without words are never taken, null and repeated ids count row by row, and
    of an empty table the mix is empty.  Columns with one of these names are replaced.
    """
    (row,) = free_name(docs, "_row")
    # The stage before is a written table, whose rows are numbered alike at each read.
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    mixed = mixing.mix(rows, row=row)
    return mixing.take(rows, mixed, row, MIXED).drop(row)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scan", secret),
    ("source mix", mix),
]

#: XXH64, suffix decoding and SimHash have no SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  What a stage has written goes once the next has run."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with cleared(spark) as keep:
            docs, path = settled_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.add(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
