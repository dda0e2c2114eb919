"""Cuts text into windows of bytes that begin and end with lines."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.shipping import ship


@dataclass(frozen=True)
class Windows:
    """Bytes of a window, of the overlap of two, and of the least and greatest chunk."""

    size: int = 512
    overlap: int = 64
    least: int = 10
    most: int = 4096


def cut(data: bytes, w: Windows = Windows()) -> list[tuple[int, int, int, int]]:  # noqa: B008
    """(start byte, end byte, first line, last line) of each chunk.

    A window that doesn't start the text starts after the next line end, even where it
    starts a line already; one that doesn't reach the end of the text ends with its last
    whole line.  A line longer than a window is in none.
    """
    n = len(data)
    if n < w.least:
        return []
    ends = [i for i, b in enumerate(data) if b == 10]
    if n <= w.size:
        return [(0, n, 1, len(ends))]
    stride = w.size - w.overlap if w.size > w.overlap else w.size
    out, start = [], 0
    while start < n:
        end = min(start + w.size, n, start + w.most)
        if start > 0:
            k = bisect_left(ends, start)
            start = ends[k] + 1 if k < len(ends) else n
        if end < n:
            k = bisect_left(ends, end)
            end = ends[k - 1] + 1 if k and ends[k - 1] >= start else min(start, end)
        if end <= start:
            start += min(stride, 100)
            continue
        if end - start >= w.least:
            out.append((start, end, bisect_left(ends, start) + 1, bisect_left(ends, end)))
        if end >= n:
            break
        start += stride
    return out


def chunks(files: DataFrame, key: str, text: str, w: Windows = Windows()) -> DataFrame:  # noqa: B008
    """key, start_byte, end_byte, start_line, end_line, content of every chunk; a null
    text has none."""
    ship(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch["key"], batch["text"], strict=True):
                data = t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace")
                rows += [(k, a, b, lo, hi, data[a:b].decode("utf-8", "replace")) for a, b, lo, hi in cut(data, w)]
            yield pd.DataFrame(rows, columns=["key", "start_byte", "end_byte", "start_line", "end_line", "content"])

    rows = files.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key IS NOT NULL")
    schema = f"key {kind}, start_byte long, end_byte long, start_line int, end_line int, content string"
    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)


def truncate(text, n: int):
    """A text's first n bytes and an ellipsis, or all of a text that has no more."""
    cut_off = F.concat(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"), F.lit("..."))
    return F.when(F.octet_length(text) > n, cut_off).otherwise(text)
