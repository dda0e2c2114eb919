"""Quality rules: a trusted-target against raw-corpus n-gram likelihood ratio.

Every document gets counts of simple faults, and the mean, over its hashed
n-grams (single words and pairs), of log(p_target / p_raw).  Both multinomials are over hashed n-grams:
p_raw counts every n-gram of every document, p_target those of every trusted one.  Only DataFrame functions run; the model is ``buckets`` numbers.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import free_name, settled, whole_text, words_of

BUCKETS = 1 << 16
#: Trusted ids that are sent to every task at most; of more, rows and ids are dealt out.
SENT = 1_000_000
SMOOTHING = 0.5
#: The threshold is this quantile of the trusted documents' ratios, times SLACK.
QUANTILE, SLACK = 0.002, 2.0
#: Words of an n-gram: pairs tell the order of words.
ORDERS = (1, 2)
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8


def _after(hashes: str, steps: int, join) -> Column:
    """Joins each number with the one so many places on."""
    return F.transform(hashes, lambda h, i: join(h, F.get(F.col(hashes), i + steps)))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(words: str, pairs: str, order: int) -> Column:
    """Hashes of the n-grams of one order (1 or 2), from those of the words, and of each
    word and the one after it (the last has none)."""
    if order == 1:
        return F.col(words)
    if order == 2:
        return F.slice(pairs, 1, F.greatest(F.lit(0), F.size(pairs) - 1))
    raise ValueError("n-grams have one or two words")


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(value, F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all rows of quality 1."""
    return labels.filter(F.col("quality") == 1).select("doc_id")


def _marked(rows: DataFrame, trusted: DataFrame, key: str, how: str, sent: int = SENT) -> DataFrame:
    """rows (with _id) joined to the known ids, each once; up to `sent` of them go to all
    tasks, of more Spark deals out ids and rows."""
    ids = trusted.select(F.col(f"`{key}`").alias("_id"), F.lit(1).alias("_trusted")).filter(F.col("_id").isNotNull()).distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= sent else ids, "_id", how)


def _quantile(values: DataFrame, column: str, quantile: float, accuracy: int = 10_000) -> float | None:
    """The exact quantile, interpolated; None of no values.

    A sketch names a value just past it, so that only those below, a part of
    `quantile` and a little more, go to the driver.
    """
    n = values.count()
    if not n:
        return None
    place = quantile * (n - 1)
    past = values.agg(F.percentile_approx(column, F.lit(min(1.0, (place + 2) / n + 2 / accuracy)), accuracy).alias("p")).collect()[0]["p"]
    below = sorted(r[column] for r in values.filter(F.col(column) < past).select(column).collect())
    low, high = ((below[k] if k < len(below) else past) for k in (math.floor(place), math.ceil(place)))
    return low + (high - low) * (place - math.floor(place))


def fit(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, smoothing: float = SMOOTHING, orders: tuple[int, ...] = ORDERS) -> list[float]:
    """log(p_target / p_raw) for each bucket; all zero where nothing is trusted.

    ``trusted`` has the column ``key``, and all its ids count, repeated ones once.  A null
    or empty text has no n-grams, a long one counts whole; repeated rows count each, null
    ids aren't trusted, and other columns aren't read.  An empty table gives the model
    that nothing is known of.
    """
    rows = _marked(docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text")), trusted, key, "left")
    rows = rows.select("_trusted", word_hashes(words_of(whole_text("_text"))).alias("_hashes"))
    rows = rows.select("*", (_after("_hashes", 1, F.xxhash64) if 2 in orders else F.lit(None)).alias("_pairs"))
    grams = [gram_hashes("_hashes", "_pairs", n) for n in orders]
    grams = F.concat(*grams) if len(grams) > 1 else grams[0]
    rows = rows.select("_trusted", F.explode(grams).alias("_gram"))
    found = rows.select("_trusted", _bucket(F.col("_gram"), buckets).alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target")).collect()  # at most `buckets` rows
    raw, target = [0] * buckets, [0] * buckets
    for row in found:
        raw[row["_bucket"]], target[row["_bucket"]] = row["raw"], row["target"]
    if not sum(target):
        return [0.0] * buckets
    all_raw, all_target = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    return [math.log((t + smoothing) / all_target) - math.log((r + smoothing) / all_raw) for r, t in zip(raw, target, strict=True)]


def calibrate(docs: DataFrame, trusted: DataFrame, model: list[float], text: str = "text", key: str = "doc_id", orders: tuple[int, ...] = ORDERS) -> float:
    """The threshold that all trusted documents give: what nearly all of them pass,
    with slack.  0 where there are none: then every ratio is 0 and passes.  Ids and texts
    count as in fit()."""
    rows = _marked(docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text")), trusted, key, "left_semi")
    ratios = settled(assess(rows, model, "_text", orders=orders).select("llr"), "ratios")
    return SLACK * min(0.0, _quantile(ratios, "llr", QUANTILE) or 0.0)


def assess(docs: DataFrame, model: list[float], text: str = "text", threshold: float = 0.0, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    llr (double), base_failed and kept (boolean).

    No row is dropped and none is shuffled.  A null or empty text has no word: its
    counts are 0, llr is 0, and base_failed holds; a long one is judged whole.  A ratio
    at the threshold passes.  Columns of docs with one of the result's names are
    replaced; repeated rows are judged each, and an empty table stays empty.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
    kept_columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    t, w, lines, h1, h2, h4, windows, starts = free_name(docs, "_t", "_w", "_lines", "_h1", "_h2", "_h4", "_windows", "_starts")
    buckets = len(model)
    # A subquery, which the optimiser puts where it is read: a literal would be written out in
    # every plan and its descriptions, which the driver keeps, and a join would copy it to each row.
    table = pa.table({"w": pa.array([model], pa.list_(pa.float64()))})
    weights = docs.sparkSession.createDataFrame(table).scalar()

    out = docs.select(*kept_columns, whole_text(text).alias(t))
    out = out.select("*", words_of(F.col(t)).alias(w), F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines))
    n = F.size(w)
    # A window of eight words is four hashed pairs; equal windows have equal hashes, and
    # two others of one text meet with a chance of 2**-61. Hashes are compared within a text only.
    shifted = lambda by: lambda a, b: F.shiftleft(a, by).bitwiseXOR(b)
    out = out.select("*", word_hashes(F.col(w)).alias(h1))
    out = out.select("*", _after(h1, 1, F.xxhash64).alias(h2))
    out = out.select("*", _after(h2, 2, shifted(1)).alias(h4))
    out = out.select("*", F.slice(_after(h4, 4, shifted(2)), 1, F.greatest(F.lit(0), n - (WINDOW - 1))).alias(windows))
    order = F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda a: F.filter(  # noqa: E731  the neighbours of an equal hash in sorted order
        F.transform(a, lambda x, k: F.when((F.get(a, k - 1)["h"] == x["h"]) | (F.get(a, k + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull()
    )
    plain = F.size(F.array_distinct(windows)) == F.size(windows)
    (ordered,) = free_name(out, "_ordered")
    out = out.select("*", F.when(~plain, order).alias(ordered))
    out = out.select("*", F.when(F.col(ordered).isNotNull(), F.sort_array(twice(F.col(ordered)))).alias(starts))
    covered = F.aggregate(
        F.transform(F.col(starts), lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(starts), k + 1) - x, F.lit(WINDOW))).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    model_, grams, repeated = free_name(out, "_model", "_grams", "_repeated")
    passed = out.columns
    found = [gram_hashes(h1, h2, order) for order in orders]
    out = out.select("*", F.concat(*found).alias(grams), F.coalesce(covered, F.lit(0)).cast("long").alias(repeated), weights.alias(model_))
    # Below, all that is new above is read once, so the optimiser merges the two steps; else
    # the model would be a column, with a copy in each row.
    ratio = F.aggregate(F.col(grams), F.lit(0.0), lambda a, g: a + F.element_at(F.col(model_), _bucket(g, buckets) + 1))
    n_grams = sum((F.greatest(F.lit(0), n - (order - 1)) for order in orders), F.lit(0))
    out = out.select(
        *[F.col(f"`{c}`") for c in passed],
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.col(repeated).alias("n_repeat_words"),
        F.when(n > 0, ratio / F.greatest(F.lit(1), n_grams)).otherwise(0.0).alias("llr"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.select("*", failed.alias("base_failed"))
    # Always true, but not to the optimiser: a filter on `kept` stays above, where each
    # column is computed once, and isn't written out in terms of the text.
    barrier = F.monotonically_increasing_id() >= 0
    out = out.select("*", (barrier & ~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"))
    return out.drop(t, w, lines, h1, h2, h4, windows, ordered, starts)
