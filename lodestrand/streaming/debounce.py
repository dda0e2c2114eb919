"""Trailing-edge debouncing by event time.

Each event of a key restarts its quiet period; one row comes out when the period has
passed.  That is a session window whose gap is the period: events exactly a period
apart still belong together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Only these events lead to indexing; nothing follows from removals and renames.
OPERATIONS = ("write", "create")


def relevant(events: DataFrame, op: str = "op", operations: tuple[str, ...] = OPERATIONS) -> DataFrame:
    return events.filter(F.col(op).isin(*operations))


def sessions(events: DataFrame, key: str = "path", ts: str = "ts", gap: str = "1 second", watermark: str | None = None) -> DataFrame:
    """key, first_ts, fire_ts, n of each burst.  A stream needs a watermark of the gap or
    more; rows later than that are dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark is not None:
        rows = rows.withWatermark(ts, watermark)
    grouped = rows.groupBy(F.col(key), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("fire_ts"), "n")


def batch_sessions(events: DataFrame, key: str = "path", ts: str = "ts", gap_seconds: float = 1.0) -> DataFrame:
    """As sessions(), of a table and by windows: a burst starts after more than a gap.

    Events of a key within one slot as long as the gap belong together, so slots are summed
    up before anything is shuffled: a key weighs as much as it has slots, not events.
    """
    gap = int(gap_seconds * 1e6)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = events.groupBy(key, F.floor(us / F.lit(max(1, gap))).alias("_slot")).agg(F.min(us).alias("_a"), F.max(us).alias("_b"), F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(key).orderBy("_slot")
    rows = slots.withColumn("_new", F.coalesce((F.col("_a") - F.lag("_b").over(by) > gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("_s", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(key, "_s").agg(F.min("_a").alias("first"), F.max("_b").alias("last"), F.sum("n").alias("n"))
    return found.select(key, F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros(F.col("last") + gap).alias("fire_ts"), "n")
