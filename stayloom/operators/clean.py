"""Cleaning text-typed extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.functions.scalar import rate


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows carrying the latest ``time`` of their key; ties all stay.

    The maximum is a partial aggregate and the join key includes the time itself, so the rows of one very frequent key
    are neither gathered in one window nor hashed to one task.
    """
    latest = df.groupBy(*keys).agg(F.max(time).alias(time))
    return df.join(latest, [*keys, time], "left_semi")


def paired_ratio(first: DataFrame, second: DataFrame, *, keys: Sequence[str], value: str) -> DataFrame:
    """Two measurements taken at the same instant side by side, with their ratio (NULL for a zero denominator)."""
    a = first.select(*keys, F.col(value).alias("first"))
    b = second.select(*keys, F.col(value).alias("second"))
    return a.join(b, list(keys), "left").withColumn("ratio", rate(F.col("first"), F.col("second")))


def fill_missing(df: DataFrame, computed: DataFrame, *, key: str, columns: Sequence[str]) -> DataFrame:
    """Replace only the missing cells of ``columns`` by the values of ``computed`` (unique on ``key``)."""
    side = computed.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    filled = df.join(side, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns})
    return filled.select(*df.columns)
