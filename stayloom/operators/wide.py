"""Assembling one wide row per stay."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.functions.scalar import clean_numeric, hours, parse_timestamp
from stayloom.operators.windows import mean, windowed_aggregate


def join_features(cohort: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left-join feature frames, each unique on its keys, to the cohort.

    Frames grouped by their keys are unique by construction; check base tables with ``duplicate_keys`` first.
    """
    return reduce(lambda wide, part: wide.join(part[0], list(part[1]), "left"), parts, cohort)


def duplicate_keys(parts: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """One row (table, groups, rows) per table that has more than one row for some key; empty when all are unique."""
    checks = []
    for name, (df, keys) in parts.items():
        repeated = df.groupBy(*keys).count().filter(F.col("count") > 1)
        checks.append(repeated.agg(F.count("*").alias("groups"), F.sum("count").alias("rows")).select(
            F.lit(name).alias("table"), "groups", "rows"))
    return reduce(DataFrame.unionByName, checks).filter(F.col("groups") > 0)


def require_unique(parts: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> None:
    """Fail if any table would fan out the wide row (runs one job over all tables)."""
    found = duplicate_keys(parts).collect()
    if found:
        raise ValueError("not unique on the join key: " + ", ".join(f"{r['table']} ({r['groups']} keys)" for r in found))


def analyte_features(stays: DataFrame, samples: DataFrame, *, analytes: Sequence[str], capped: Sequence[str] = (),
                     patient_key: str, row_keys: Sequence[str], junk: Sequence[str], cap_hours: int = 24,
                     start: str = "intime", end: str = "outtime") -> DataFrame:
    """``<analyte>_{max,min,avg}`` per stay from one tagged log of text results taken during the stay.

    ``samples`` has ``analyte``, ``sample_time`` (text), ``result`` (text) and the patient key. Analytes in ``capped``
    count only up to ``cap_hours`` after the start. Stays without any sample keep a row of NULLs.
    """
    log = samples.filter(F.col("analyte").isin(list(analytes))).select(
        patient_key, "analyte", parse_timestamp(F.col("sample_time")).alias("charttime"),
        clean_numeric(F.col("result"), junk).alias("res"))
    # Both windows of a stay are answered by one pass over the log.
    begin, finish = F.col(start), F.col(end)
    windows = {"whole": (begin, finish), "early": (begin, F.least(finish, begin + hours(cap_hours)))}
    stats = windowed_aggregate(stays, log, rows=row_keys, keys=[patient_key], windows=windows, values=["res"], by=["analyte"])
    columns = []
    for a in analytes:
        w = "early" if a in capped else "whole"
        shown = {"max": F.col(f"{w}_res_max"), "min": F.col(f"{w}_res_min"), "avg": mean(f"{w}_res")}
        columns += [F.max(F.when(F.col("analyte") == a, c)).alias(f"{a}_{s}") for s, c in shown.items()]
    spread = stats.groupBy(*row_keys).agg(*columns)
    return stays.select(*row_keys).join(spread, list(row_keys), "left")
