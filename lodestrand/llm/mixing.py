"""Mixing sources to target weights.

Each document gets a key from a hash of its id.  Documents are range-sorted by source and
key, about ``per_range`` to a range whatever a source's or a key's share; a prefix sum over
ranges and one within each give every document the number of words before it.  A source's
budget is a number of whole epochs and a rest, and the rest is cut off exactly in the
document where it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import WORD, free_name, settled, whole_text

#: Weights of the sources in order of name, again and again.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
PER_RANGE = 50_000


def word_count(text: str) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def prefix_sums(rows: DataFrame, order: list[Column], sums: dict[str, str], per_range: int = PER_RANGE) -> DataFrame:
    """rows with a column for each of `sums` (new name: column): its sum over the rows
    before, in an order that tells rows apart or where it doesn't matter.

    Rows are dealt to ranges by a sort that samples them, so ranges hold about as many
    rows, however often a value comes; one task sees one range, or one row of each range.
    """
    rows = settled(rows, "rows")
    n = max(1, -(-rows.count() // per_range))
    part, other = free_name(rows, "_part", "_other")
    rows = settled(rows.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranges")
    whole = rows.groupBy(F.col(part).alias(other)).agg(*[F.sum(c).alias(f"{name}_all") for name, c in sums.items()])
    earlier = Window.orderBy(other).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    whole = whole.select(other, *[F.coalesce(F.sum(f"{name}_all").over(earlier), F.lit(0)).alias(f"{name}_all") for name in sums])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(whole, F.col(part) == F.col(other)).drop(other)
    found = [(F.col(f"{name}_all") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for name, c in sums.items()]
    return rows.select("*", *found).drop(part, *[f"{name}_all" for name in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, per_range: int = PER_RANGE) -> DataFrame:
    """sizes (source, source_size, n_docs; one row a source) with its target, and
    words_before, the words of the sources before it in order of name (null first).

    The targets share the sum of all sizes by weight.  A target stops at
    max_epochs times its source's size, and what it can't take goes to the others
    by weight: the sources that stop are those with the least cap for their
    weight, so one pass in that order finds them.  Of no sources there are no targets.
    """
    named = prefix_sums(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"place": "one"}, per_range)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int") + 1).cast("long")
    ranked = named.select("source", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    ranked = prefix_sums(ranked, [F.col("source").asc_nulls_first()], {"words_before": "source_size"}, per_range)
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    ranked = settled(prefix_sums(ranked, order, {"cap_before": "cap", "weight_before": "weight"}, per_range), "sources")
    total = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).collect()[0]
    rest, share = F.lit(total["words"] or 0) - F.col("cap_before"), F.lit(total["weight"] or 0) - F.col("weight_before")
    ranked = ranked.select("*", rest.alias("rest"), share.alias("share"), (F.col("cap") * share <= rest * F.col("weight")).alias("stops"))
    # All that don't stop see the rest and the weights that the first of them sees.
    open_ = ranked.filter("NOT stops").agg(F.max("rest").alias("rest"), F.max("share").alias("share")).collect()[0]
    going = F.col("weight") * F.lit(float(open_["rest"] or 0)) / F.lit(open_["share"] or 1)
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(going)
    return ranked.select("source", "source_size", "n_docs", target.alias("target"), "words_before")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, per_range: int = PER_RANGE, seed: str = "mix", row: str | None = None) -> DataFrame:
    """One row a document: its key and source (under their names), size, source_size
    (long), target (double), taken (long; the words the mix takes, repeats counted), and
    the column `row`, if one is named that tells rows apart.

    A null text has size 0, a text however long is counted whole; a null source is a
    source of its own, the last; a null id is keyed like any other value, and however
    many rows share an id, no task gathers them.  Rows that agree in key and id follow
    each other by size and by a hash of the text, so that a rerun takes the same words.
    An empty table gives an empty table.  Other columns aren't read, whatever their
    names; take() brings the mix back to the documents.
    """
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("long")
    own = [] if row is None else [F.col(f"`{row}`").alias("_row")]
    rows = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{source}`").alias("_source"), word_count(text).alias("size"), hashed.alias("_key"), F.xxhash64(f"`{text}`").alias("_tie"), *own)
    rows = settled(rows, "mix")  # texts are read once

    sizes = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = targets(sizes, weights, max_epochs, per_range).withColumnRenamed("source", "_s").drop("n_docs")
    order = [F.col("_source").asc_nulls_first(), *map(F.col, ("_key", "_id", "size", "_tie"))]
    rows = prefix_sums(rows, order, {"_before": "size"}, per_range)
    # One row a source; Spark picks the join by its size.
    rows = rows.join(plan, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")

    budget = F.floor(F.col("target")).cast("long")
    start = F.col("_before") - F.col("words_before")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    found = [F.col("_id").alias(key), F.col("_source").alias(source), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")]
    return rows.select(*found, *([] if row is None else [F.col("_row").alias(row)]))


def take(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents that the mix takes words of, with epochs (whole passes) and
    rest_words (words from the text's start that the last, cut pass takes), and columns
    of the mix to keep.

    `key` must tell rows apart, here and in the mix; rows without one aren't found again.
    Columns of docs with one of these names are replaced, others stay as they are; null
    and empty texts have no words and are never taken; of an empty table nothing is.
    """
    new = ["epochs", "rest_words", *keep]
    old = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in new} and c != key])
    (k,) = free_name(old, "_k")
    part = mixed.filter("taken > 0").select(F.col(f"`{key}`").alias(k), F.floor(F.col("taken") / F.col("size")).cast("long").alias("epochs"), (F.col("taken") % F.col("size")).alias("rest_words"), *keep)
    return old.join(part, F.col(f"`{key}`") == F.col(k)).drop(k)
