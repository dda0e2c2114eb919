"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.storage import partitions, settled, shared_path  # noqa: F401  for the operators

#: A word: a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id in join keys; such rows rank after all others.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its letters' case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def arrow_rows(batch, *columns: str) -> Iterator[tuple]:
    """Rows of an Arrow batch as Python values, one at a time."""
    return zip(*(batch.column(c) for c in columns), strict=True)
