"""Per-stay statistics of an event log: windowed, per item, and spread into feature columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayloom.functions.scalar import hours
from stayloom.operators.windows import Window, interval_join, mean, windowed_aggregate

__all__ = ["ADMISSION_KEYS", "STAY_KEYS", "Window", "attribute_stats", "combine_items", "event_stats", "horizon_window",
           "interval_join", "keep_all_stays", "multi_window_column_stats", "multi_window_stats", "spread_items",
           "stay_window", "windowed_column_stats"]

STAY_KEYS = ("subject_id", "hadm_id", "stay_id")
ADMISSION_KEYS = ("subject_id", "hadm_id")


def horizon_window(before: int = 6, after: int = 24) -> Window:
    """From ``before`` hours ahead of admission to ``after`` hours past it."""
    return F.col("intime") - hours(before), F.col("intime") + hours(after)


def stay_window(before: int = 6) -> Window:
    """From ``before`` hours ahead of admission to the end of the stay."""
    return F.col("intime") - hours(before), F.col("outtime")


def _items(events: DataFrame, item: str, items: Sequence | None) -> DataFrame:
    return events if items is None else events.filter(F.col(item).isin(list(items)))


def event_stats(stays: DataFrame, events: DataFrame, *, window: Window, items: Sequence | None = None,
                keys: Sequence[str] = ADMISSION_KEYS, tag: str | None = None, item: str = "itemid",
                value: str = "valuenum", time: str = "charttime") -> DataFrame:
    """min / max / avg of each item inside the window, one row per stay and item that has an event there.

    ``items`` restricts the log before the join (the filter reaches the scan). ``tag`` adds the constant ``t_name``.
    With ``stay_id`` among the keys this is the bedside variant.
    """
    stats = windowed_aggregate(stays, _items(events, item, items), rows=STAY_KEYS, keys=keys, windows={"w": window},
                               values=[value], by=[item], time=time)
    out = stats.select(*STAY_KEYS, item, F.col(f"w_{value}_min").alias("min_value"),
                       F.col(f"w_{value}_max").alias("max_value"), mean(f"w_{value}").alias("avg_value"))
    return out.withColumn("t_name", F.lit(tag)) if tag is not None else out


def multi_window_stats(stays: DataFrame, events: DataFrame, *, windows: Mapping[str, Window], items: Sequence | None = None,
                       keys: Sequence[str] = ADMISSION_KEYS, item: str = "itemid", value: str = "valuenum",
                       time: str = "charttime") -> DataFrame:
    """``event_stats`` for several windows in one scan and one join of the log.

    Columns are ``<window>_n`` (events seen) and ``<window>_{min,max,avg}_value``; a stay and item without an event in
    some window has 0 and NULLs there.
    """
    stats = windowed_aggregate(stays, _items(events, item, items), rows=STAY_KEYS, keys=keys, windows=windows,
                               values=[value], by=[item], time=time)
    columns = []
    for w in windows:
        columns += [F.col(f"{w}_rows").alias(f"{w}_n"), F.col(f"{w}_{value}_min").alias(f"{w}_min_value"),
                    F.col(f"{w}_{value}_max").alias(f"{w}_max_value"), mean(f"{w}_{value}").alias(f"{w}_avg_value")]
    return stats.select(*STAY_KEYS, item, *columns)


def column_stats(columns: Sequence[str]) -> list[Column]:
    """min / max / avg of several columns, named ``<column>_{min,max,avg}``."""
    return [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]


def multi_window_column_stats(stays: DataFrame, events: DataFrame, columns: Sequence[str], *,
                              windows: Mapping[str, Window], keys: Sequence[str] = ADMISSION_KEYS,
                              time: str = "charttime") -> DataFrame:
    """min / max / avg of several columns of one table per stay in each window, in one scan.

    Names are ``<window>_<column>_{min,max,avg}``, with ``<window>_rows`` for the rows seen.
    """
    stats = windowed_aggregate(stays, events, rows=STAY_KEYS, keys=keys, windows=windows, values=columns, time=time)
    out = []
    for w in windows:
        out.append(F.col(f"{w}_rows"))
        for c in columns:
            out += [F.col(f"{w}_{c}_min"), F.col(f"{w}_{c}_max"), mean(f"{w}_{c}").alias(f"{w}_{c}_avg")]
    return stats.select(*STAY_KEYS, *out)


def windowed_column_stats(stays: DataFrame, events: DataFrame, columns: Sequence[str], *, window: Window,
                          keys: Sequence[str] = ADMISSION_KEYS, time: str = "charttime") -> DataFrame:
    """min / max / avg of several columns of one table per stay, over the rows inside the window."""
    stats = multi_window_column_stats(stays, events, columns, windows={"w": window}, keys=keys, time=time)
    return stats.select(*STAY_KEYS, *[F.col(f"w_{c}_{s}").alias(f"{c}_{s}") for c in columns for s in ("min", "max", "avg")])


def attribute_stats(stays: DataFrame, table: DataFrame, columns: Sequence[str], *,
                    keys: Sequence[str] = ADMISSION_KEYS) -> DataFrame:
    """min / max / avg of attributes without a time per stay; every stay is kept.

    The attribute is aggregated per key first, so a hot key meets its stays as a single row.
    """
    per_key = table.groupBy(*keys).agg(*column_stats(columns))
    return stays.select(*STAY_KEYS).join(per_key, list(keys), "left").select(
        *STAY_KEYS, *[f"{c}_{s}" for c in columns for s in ("min", "max", "avg")])


def keep_all_stays(stays: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left side of an outer interval join: stays without events come back with NULL statistics.

    ``stats`` is unique on ``keys`` because it was grouped by them, so this cannot fan out.
    """
    return stays.select(*keys).join(stats, list(keys), "left")


def combine_items(stats: DataFrame, *, avg_of: str = "min_value", keys: Sequence[str] = STAY_KEYS) -> DataFrame:
    """Second level over several items of one measurement: min of min, max of max, and the mean of ``avg_of``.

    The default averages the per-item minima, as the study definition does; ``avg_value`` gives the mean of means.
    """
    return stats.groupBy(*keys).agg(
        F.min("min_value").alias("g_min_value"),
        F.max("max_value").alias("g_max_value"),
        F.avg(avg_of).alias("g_avg_value"),
    )


def spread_items(stats: DataFrame, features: Mapping[str, Sequence], *, item: str = "itemid", prefix: str = "",
                 avg_of: str = "min_value", avg_of_feature: Mapping[str, str] | None = None,
                 keys: Sequence[str] = STAY_KEYS) -> DataFrame:
    """Turn per-item statistics into one row per stay with ``<feature>_{min,max,avg}`` columns.

    A feature with one item keeps that item's mean; one with several items is combined as in ``combine_items``
    (``avg_of_feature`` overrides the averaged statistic by feature). The input already holds one row per stay and item,
    so this second pass is small however long the log was.
    """
    aggregates = []
    for feature, ids in features.items():
        mine = F.col(item).isin(list(ids))
        averaged = "avg_value" if len(ids) == 1 else (avg_of_feature or {}).get(feature, avg_of)
        aggregates += [
            F.min(F.when(mine, F.col(f"{prefix}min_value"))).alias(f"{feature}_min"),
            F.max(F.when(mine, F.col(f"{prefix}max_value"))).alias(f"{feature}_max"),
            F.avg(F.when(mine, F.col(f"{prefix}{averaged}"))).alias(f"{feature}_avg"),
        ]
    return stats.groupBy(*keys).agg(*aggregates)
