"""Preparing a modelling table: column selection, row filters, alignment, splitting and balancing."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayloom.functions.scalar import or_false
from stayloom.operators.ranks import rank_cut
from stayloom.session import cut_lineage

SAMPLING_BOUNDS = (0, 2**60 - 1)


def column_range(columns: Sequence[str], first: str, last: str, allowed: Collection[str] | None = None) -> list[str]:
    """Names from ``first`` to ``last`` in table order, restricted to ``allowed``."""
    names = list(columns)
    span = names[names.index(first): names.index(last) + 1]
    return span if allowed is None else [c for c in span if c in allowed]


def add_missing_columns(df: DataFrame, names: Sequence[str], value: str = "") -> DataFrame:
    """Add each absent column with a constant."""
    absent = {c: F.lit(value) for c in names if c not in df.columns}
    return df.withColumns(absent) if absent else df


def number_rows(df: DataFrame, order: Sequence[str], name: str, *, first: int = 0) -> DataFrame:
    """Add consecutive numbers from ``first`` in ascending order of ``order``, NULL before values (runs two jobs).

    Rows are dealt by ranges, sorted and written once with their place in the task, so later reads and retried tasks find the
    same numbers; rows equal in ``order`` are dealt by chance and spread over tasks. One count per range passes the driver.
    """
    salted = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.rand(0).alias("salt"))
    keys = [*[F.col(f"row.`{c}`") for c in order], F.col("salt")]
    dealt = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", F.monotonically_increasing_id().alias("id"))
    dealt = cut_lineage(dealt, "numbered").select("row", F.shiftright("id", 33).cast("int").alias("part"), (F.col("id") % (1 << 33)).alias("at"))
    before, counts = [], sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    for part, count in counts:
        before.append((part, first))
        first += count
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "part int, start long"))
    return dealt.join(starts, "part").select("row.*", (F.col("start") + F.col("at")).alias(name))


def present(df: DataFrame, column: str) -> Column:
    """Whether a cell holds a value; NaN is missing, like NULL."""
    known = F.col(column).isNotNull()
    return known & ~F.isnan(column) if df.schema[column].dataType.typeName() in ("double", "float") else known


def filled_share(df: DataFrame, columns: Sequence[str]) -> Column:
    """Share of the columns that hold a value in this row."""
    filled = reduce(lambda a, b: a + b, [present(df, c).cast("int") for c in columns])
    return filled / F.lit(float(len(columns)))


def filter_complete_rows(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """Rows whose share of filled columns reaches the threshold."""
    return df.filter(filled_share(df, columns) >= threshold)


def filter_target_cohort(df: DataFrame, target: str, *, sepsis: str = "sepsis", lung: str = "sepsis_ali") -> DataFrame:
    """Rows eligible for predicting ``target``: it must be known; other targets than sepsis need a septic stay, and
    28-day mortality also a lung injury."""
    known = present(df, target)
    if target == "sepsis":
        return df.filter(known)
    if target == "death28":
        return df.filter(known & (F.col(sepsis) == 1) & (F.col(lung) == 1))
    return df.filter(known & (F.col(sepsis) == 1))


def sampling_order(key: str, seed: int) -> list[Column]:
    """A reproducible random order of rows: the md5 of key and seed, as two 60-bit numbers."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary"))
    return [F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint") for start in (1, 16)]


def split_exact(df: DataFrame, *, key: str, fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Random split with exactly ``round(fraction * n)`` rows in the first part (runs a few counting jobs).

    The parts are the rows up to, and past, one position of the sampling order. The position is found by counting, so no
    row is sorted, moved or joined, and the two filters are complements.
    """
    order = sampling_order(key, seed)
    cut = rank_cut(df, order, rows=lambda n: round(fraction * n), bounds=SAMPLING_BOUNDS)
    return df.filter(cut.upto(order)), df.filter(~cut.upto(order))


def balance_undersample(df: DataFrame, target: str, *, key: str, seed: int = 0) -> DataFrame:
    """Sample the larger of the two classes (target above 0.5 or not; NULL and NaN count as not) down to the smaller."""
    order = sampling_order(key, seed)
    positive = or_false(present(df, target) & (F.col(target) > 0.5))
    sizes = df.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")).first()
    if sizes["p"] == sizes["n"]:
        return df
    larger = ~positive if sizes["n"] > sizes["p"] else positive
    smaller = min(sizes["p"], sizes["n"])
    cut = rank_cut(df.filter(larger), order, rows=lambda _: smaller, bounds=SAMPLING_BOUNDS)
    return df.filter(~larger | cut.upto(order))


def concat_flagged(train: DataFrame, verify: DataFrame, flag: str = "model") -> DataFrame:
    """Rows of both frames with a source flag: 1 for the first, 0 for the second."""
    return train.withColumn(flag, F.lit(1)).unionByName(verify.withColumn(flag, F.lit(0)))

