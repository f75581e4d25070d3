"""Accuracy and confusion tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy_percent(truth: Column, predicted: Column) -> Column:
    """Aggregate: percentage of rows predicted correctly."""
    return F.avg((truth == predicted).cast("double")) * 100


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Counts by true class (rows) and predicted class (columns ``predicted_<class>``), zero where empty."""
    cells = {(t, p): f"_{t}_{p}" for t in classes for p in classes}
    counts = df.agg(*[F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias(n) for (t, p), n in cells.items()])
    rows = [F.struct(F.lit(t).alias("truth"), *[F.col(cells[t, p]).alias(f"predicted_{p}") for p in classes])
            for t in classes]
    return counts.select(F.inline(F.array(*rows)))


def mean_accuracy(runs: DataFrame) -> DataFrame:
    """Mean accuracy per model over repeated runs (columns ``model``, ``accuracy``)."""
    return runs.groupBy("model").agg(F.avg("accuracy").alias("accuracy"))
