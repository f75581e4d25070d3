"""Aggregates of an event log inside time windows, linear in the log however crowded a patient is.

The window of a stay is unrolled into calendar days and joined on the equality keys *plus the day*, with the exact bounds as
a residual. A patient who owns a large part of the log is spread over as many tasks as the log has days, no event is copied,
and because the day is no grouping key the aggregate always combines inside the join tasks before anything is shuffled. One
very hot day is left to AQE's skew join, which can split it for the same reason.

What that join emits is one pair per event and overlapping stay. Stays of one patient hardly overlap, but a key shared by
many stays would multiply the log. Days with more than ``CROWDED`` windows of one key therefore take another exact way: the
events of such a day are summed into nested blocks of 1, 16, 256, ... microseconds, and each window is covered by at most thirty
blocks per level, so the work is ``levels x (events + windows)`` and never their product. Whether any day is crowded is
found from the stays alone, the small side, by one aggregate job per call.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayloom.session import cut_lineage

Window = tuple[Column, Column]

CROWDED = 64
RADIX_BITS = 4
LEVELS = 10  # 16**10 microseconds are more than a day
MICROS_PER_DAY = 86_400_000_000


def day_number(ts: Column) -> Column:
    return F.unix_date(ts.cast("date"))


def time_of_day(ts: Column) -> Column:
    """Microseconds since midnight."""
    return F.timestamp_diff("MICROSECOND", ts.cast("date").cast("timestamp_ntz"), ts)


def by_day(stays: DataFrame, window: Window) -> DataFrame:
    """One row per stay and day of its window, with ``_low``, ``_high`` and ``_day``."""
    low, high = window
    return (
        stays.withColumns({"_low": low, "_high": high})
        .filter(F.col("_low") <= F.col("_high"))
        .withColumn("_day", F.explode(F.sequence(day_number(F.col("_low")), day_number(F.col("_high")))))
    )


def interval_join(stays: DataFrame, events: DataFrame, *, keys: Sequence[str], window: Window, time: str = "charttime",
                  strict: bool = False) -> DataFrame:
    """Every (stay, event) pair with equal keys and the event inside the stay's window.

    Bounds are inclusive unless ``strict``. Apart from ``keys`` the two sides must not share column names. To aggregate the
    pairs use ``windowed_aggregate``, which does not need all of them.
    """
    dated = events.withColumn("_day", day_number(F.col(time)))
    at = F.col(time)
    inside = (at > F.col("_low")) & (at < F.col("_high")) if strict else at.between(F.col("_low"), F.col("_high"))
    return by_day(stays, window).join(dated, [*keys, "_day"]).filter(inside).drop("_day", "_low", "_high")


def open_window(window: Window) -> Window:
    """The inclusive window that excludes both bounds (times have microseconds)."""
    tick = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001).cast("decimal(18,6)"))
    return window[0] + tick, window[1] - tick


def windowed_aggregate(stays: DataFrame, events: DataFrame, *, rows: Sequence[str], keys: Sequence[str],
                       windows: Mapping[str, Window], values: Sequence[str], by: Sequence[str] = (),
                       time: str = "charttime", crowded: int = CROWDED) -> DataFrame:
    """Statistics of ``values`` per stay (its ``rows`` columns), per ``by`` column of the log, in each window.

    Columns are ``<window>_rows`` and ``<window>_<value>_{min,max,sum,n}``; groups without an event in any window are absent.
    ``windows`` are expressions over ``stays``. Looks for crowded days first (a job over the stays).
    """
    names = list(windows)
    lows = {f"_lo{i}": w[0] for i, w in enumerate(windows.values())}
    highs = {f"_hi{i}": w[1] for i, w in enumerate(windows.values())}
    base = stays.select(*dict.fromkeys([*rows, *keys]), *[c.alias(n) for n, c in {**lows, **highs}.items()])
    outer = (F.least(*lows), F.greatest(*highs)) if len(names) > 1 else (F.col("_lo0"), F.col("_hi0"))
    spans = by_day(base, outer)
    log = events.select(*keys, *by, F.col(time).alias("_at"), *values).withColumn("_day", day_number(F.col("_at")))
    cell = [*keys, "_day"]
    full = spans.groupBy(*cell).count().filter(F.col("count") > crowded).select(*cell)
    groups = [*rows, *by]
    if not _any_crowded(full):
        return _direct(spans, log, cell, groups, names, values)
    full = cut_lineage(full, "crowded")
    few = _direct(spans.join(full, cell, "left_anti"), log, cell, groups, names, values)
    many = _nested(spans.join(full, cell, "left_semi"), log.join(full, cell, "left_semi"), cell, groups, by, names, values)
    return few.unionByName(many).groupBy(*groups).agg(*_merged(names, values))


_known_uncrowded: set[tuple[str, int]] = set()


def _any_crowded(full: DataFrame) -> bool:
    """Whether the frame of crowded days has a row.

    A negative answer is remembered for the same stays, keys and windows in this application, so a study that aggregates many
    tables over one set of stays asks once. Both ways are exact: a stale answer could cost time but no correctness.
    """
    question = (full.sparkSession.sparkContext.applicationId, full.semanticHash())
    if question in _known_uncrowded:
        return False
    if full.isEmpty():
        _known_uncrowded.add(question)
        return False
    return True


def _direct(spans: DataFrame, log: DataFrame, cell: Sequence[str], groups: Sequence[str], names: Sequence[str],
            values: Sequence[str]) -> DataFrame:
    at = F.col("_at")
    pairs = spans.join(log, list(cell)).filter(at.between(F.col("_low"), F.col("_high")))
    out = []
    for i, w in enumerate(names):
        inside = at.between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) if len(names) > 1 else None
        out.append((F.count("*") if inside is None else F.count_if(inside)).alias(f"{w}_rows"))
        for v in values:
            shown = F.col(v) if inside is None else F.when(inside, F.col(v))
            out += [F.min(shown).alias(f"{w}_{v}_min"), F.max(shown).alias(f"{w}_{v}_max"),
                    F.sum(shown).alias(f"{w}_{v}_sum"), F.count(shown).alias(f"{w}_{v}_n")]
    return pairs.groupBy(*groups).agg(*out)


def _merged(names: Sequence[str], values: Sequence[str]) -> list[Column]:
    out = []
    for w in names:
        out.append(F.sum(f"{w}_rows").alias(f"{w}_rows"))
        for v in values:
            p = f"{w}_{v}"
            out += [F.min(f"{p}_min").alias(f"{p}_min"), F.max(f"{p}_max").alias(f"{p}_max"),
                    F.sum(f"{p}_sum").alias(f"{p}_sum"), F.sum(f"{p}_n").alias(f"{p}_n")]
    return out


def _shift(col: Column, level: Column) -> Column:
    return F.call_function("shiftright", col, level)


def _covering_blocks(start: Column, end: Column) -> Column:
    """Blocks ``(level, block)`` that together cover ``[start, end)`` once: at most 30 per level.

    At each level these are the whole blocks inside, without those that a whole block of the next level holds.
    """
    none = F.array().cast("array<bigint>")

    def between(low: Column, high: Column) -> Column:
        return F.when(low < high, F.sequence(low, high - 1)).otherwise(none)

    def at(level: Column) -> Column:
        bits = level * RADIX_BITS
        first = _shift(start + F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1, bits)
        last = _shift(end, bits)
        up, down = _shift(first + (1 << RADIX_BITS) - 1, F.lit(RADIX_BITS)) * (1 << RADIX_BITS), _shift(last, F.lit(RADIX_BITS)) * (1 << RADIX_BITS)
        ends = (up > down) | (level == LEVELS - 1)
        blocks = F.when(ends, between(first, last)).otherwise(F.concat(between(first, up), between(down, last)))
        return F.transform(blocks, lambda block: F.struct(level.alias("level"), block.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at))


def _nested(spans: DataFrame, log: DataFrame, cell: Sequence[str], groups: Sequence[str], by: Sequence[str],
            names: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The same statistics by way of nested blocks of each day."""
    midnight = F.date_from_unix_date("_day").cast("timestamp_ntz")

    def offset(ts: Column) -> Column:
        return F.timestamp_diff("MICROSECOND", midnight, ts)

    windows = F.array(*[
        F.struct(F.lit(i).alias("w"), F.greatest(offset(F.col(f"_lo{i}")), F.lit(0)).alias("start"),
                 F.least(offset(F.col(f"_hi{i}")) + 1, F.lit(MICROS_PER_DAY)).alias("end")) for i in range(len(names))])
    own = list(dict.fromkeys([*cell, *[g for g in groups if g not in by]]))
    parts = spans.select(*own, F.inline(windows)).filter(F.col("start") < F.col("end"))
    parts = parts.select(*own, "w", F.inline(_covering_blocks(F.col("start"), F.col("end"))))
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    leveled = log.withColumn("_time", time_of_day(F.col("_at"))).withColumn("level", F.explode(levels))
    leveled = leveled.withColumn("block", _shift(F.col("_time"), F.col("level") * RADIX_BITS))
    stats = [F.count("*").alias("_rows")]
    for v in values:
        stats += [F.min(v).alias(f"_{v}_min"), F.max(v).alias(f"_{v}_max"), F.sum(v).alias(f"_{v}_sum"),
                  F.count(v).alias(f"_{v}_n")]
    blocks = leveled.groupBy(*cell, "level", "block", *by).agg(*stats)
    pairs = parts.join(blocks, [*cell, "level", "block"])
    out = []
    for i, w in enumerate(names):
        mine = F.col("w") == i
        out.append(F.coalesce(F.sum(F.when(mine, F.col("_rows"))), F.lit(0)).alias(f"{w}_rows"))
        for v in values:
            p = f"{w}_{v}"
            out += [F.min(F.when(mine, F.col(f"_{v}_min"))).alias(f"{p}_min"),
                    F.max(F.when(mine, F.col(f"_{v}_max"))).alias(f"{p}_max"),
                    F.sum(F.when(mine, F.col(f"_{v}_sum"))).alias(f"{p}_sum"),
                    F.coalesce(F.sum(F.when(mine, F.col(f"_{v}_n"))), F.lit(0)).alias(f"{p}_n")]
    return pairs.groupBy(*groups).agg(*out)


def mean(prefix: str) -> Column:
    """Mean of a value from its sum and count; NULL without any."""
    return F.try_divide(F.col(f"{prefix}_sum").cast("double"), F.col(f"{prefix}_n"))
