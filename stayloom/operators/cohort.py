"""Cohort building and cohort slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayloom.functions.scalar import days_between, hours_between, or_false, prefix
from stayloom.operators.events import ADMISSION_KEYS, STAY_KEYS


def build_cohort(stays: DataFrame, sepsis: DataFrame, age: DataFrame, *, min_age: int = 18, max_age: int = 89,
                 min_hours: float = 48) -> DataFrame:
    """Stays of patients from ``min_age`` to below ``max_age`` lasting longer than ``min_hours``.

    Both limits act before the sepsis join. An age outside the range (or unknown) drops the stay, hence the inner join.
    """
    long_enough = stays.filter(hours_between(F.col("intime"), F.col("outtime")) > min_hours)
    of_age = age.select(*ADMISSION_KEYS, "age").filter((F.col("age") >= min_age) & (F.col("age") < max_age))
    flags = sepsis.select("subject_id", "stay_id", "sepsis3")
    return (
        long_enough.join(of_age, list(ADMISSION_KEYS))
        .join(flags, ["subject_id", "stay_id"], "left")
        .select(*STAY_KEYS, "age", "outtime", "intime",
                days_between(F.col("intime"), F.col("outtime")).alias("stay_day"),
                or_false(F.col("sepsis3")).alias("sepsis"))
    )


def collect_attributes(stays: DataFrame, sepsis: DataFrame, age: DataFrame, comorbidity: DataFrame,
                       flags: Sequence[str]) -> DataFrame:
    """Every stay with its sepsis record, age and the named comorbidity flags; nothing is filtered."""
    found = sepsis.select("subject_id", "stay_id", F.col("stay_id").alias("sepsis3_stay_id"), "sepsis3")
    return (
        stays.select(*STAY_KEYS)
        .join(found, ["subject_id", "stay_id"], "left")
        .join(age.select(*ADMISSION_KEYS, "age"), list(ADMISSION_KEYS), "left")
        .join(comorbidity.select(*ADMISSION_KEYS, *flags), list(ADMISSION_KEYS), "left")
        .select(*STAY_KEYS, "sepsis3_stay_id", "sepsis3", "age", or_false(F.col("sepsis3")).alias("sepsis"), *flags)
    )


def left_join_wildcard_key(left: DataFrame, right: DataFrame, keys: Sequence[str], optional: str) -> DataFrame:
    """Inner join on ``keys`` where the right side's ``optional`` key matches itself or, when NULL, every left row.

    Written as two equality joins: the exact part keeps ``optional`` in the hash key, so a hot ``keys`` group is never
    compared all against all, and the wildcard part meets only the NULL rows. Right columns other than the keys are
    appended.
    """
    extra = [c for c in right.columns if c not in (*keys, optional)]
    exact = left.join(right.filter(F.col(optional).isNotNull()), [*keys, optional])
    wildcard = left.join(right.filter(F.col(optional).isNull()).drop(optional), list(keys))
    columns = [*left.columns, *extra]
    return exact.select(*columns).unionByName(wildcard.select(*columns))


def diagnosis_slice(frame: DataFrame, diagnoses: DataFrame, prefixes: Sequence[str], length: int = 3) -> DataFrame:
    """Rows of ``frame`` with a diagnosis code of the given prefixes, one row per matching code."""
    kind = prefix(F.col("icd_code"), length)
    codes = diagnoses.filter(kind.isin(list(prefixes))).select(*ADMISSION_KEYS, "icd_code", kind.alias("x_type"))
    return frame.join(codes, list(ADMISSION_KEYS)).select(*frame.columns, "icd_code", "x_type")


def diagnosis_slice_counts(frame: DataFrame, diagnoses: DataFrame, prefixes: Sequence[str], length: int = 3) -> DataFrame:
    """Rows of ``diagnosis_slice`` by prefix, as products of counts per admission: the fan-out itself is never built."""
    kind = prefix(F.col("icd_code"), length)
    codes = diagnoses.filter(kind.isin(list(prefixes))).groupBy(*ADMISSION_KEYS, kind.alias("x_type")).agg(
        F.count("*").alias("codes"))
    stays = frame.groupBy(*ADMISSION_KEYS).agg(F.count("*").alias("stays"))
    return stays.join(codes, list(ADMISSION_KEYS)).groupBy("x_type").agg(
        F.sum(F.col("stays") * F.col("codes")).alias("count"))


def specimen_slice(cohort: DataFrame, suspicion: DataFrame, specimens: Sequence[str]) -> DataFrame:
    """Septic stays with at least one infection record of the given specimens."""
    wanted = suspicion.filter(F.col("specimen").isin(list(specimens))).select(*STAY_KEYS)
    return cohort.filter(F.col("sepsis")).join(wanted, list(STAY_KEYS), "left_semi")


def flag_slice(frame: DataFrame, flags: DataFrame, keep: Column) -> DataFrame:
    """Rows joined with their flag rows (a NULL stay id in ``flags`` covers the whole admission) where ``keep`` holds."""
    return left_join_wildcard_key(frame, flags, ADMISSION_KEYS, "stay_id").filter(keep)
