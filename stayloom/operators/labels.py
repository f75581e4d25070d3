"""Scores and outcome labels, with exact NULL logic.

Every function takes small per-stay frames; the log has already been reduced to them by ``operators.events``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayloom.functions.scalar import days_between, larger_of, or_false, prefix, threshold_score
from stayloom.operators.events import ADMISSION_KEYS, STAY_KEYS
from stayloom.operators.windows import open_window, windowed_aggregate

# The cuts of the coagulation and organ scores.
LOW_COUNT_CUTS = ((100, 2), (150, 1))
RATIO_REFERENCE = 12.0
RATIO_CUTS = ((1.4, 2), (1.2, 1))
GRADE_CUTS = ((2, 2), (1, 1))


def low_count_score(stats: DataFrame, name: str, cuts: Sequence[tuple[float, int]] = LOW_COUNT_CUTS) -> DataFrame:
    """Score the lowest value of a stay; a stay whose values are all NULL scores 0."""
    return stats.select(*STAY_KEYS, threshold_score(F.col("min_value"), cuts, when="lt", missing=0).alias(name))


def ratio_score(stats: DataFrame, name: str, ratio_name: str, reference: float = RATIO_REFERENCE,
                cuts: Sequence[tuple[float, int]] = RATIO_CUTS) -> DataFrame:
    """Score the highest value relative to a reference value; unknown stays unknown."""
    ratio = F.col("max_value") / F.lit(reference)
    return stats.select(*STAY_KEYS, ratio.alias(ratio_name),
                        threshold_score(ratio, cuts, when="gt", missing=None).alias(name))


def grade_score(grades: DataFrame, grade: str, name: str, keys: Sequence[str] = ("stay_id",),
                cuts: Sequence[tuple[float, int]] = GRADE_CUTS) -> DataFrame:
    """Score the highest grade of each key."""
    top = grades.groupBy(*keys).agg(F.max(grade).alias(grade))
    return top.withColumn(name, threshold_score(F.col(grade), cuts, when="ge", missing=0))


def combine_scores(first: DataFrame, second: DataFrame, names: tuple[str, str], name: str) -> DataFrame:
    """The larger of two scores per stay; the first frame decides which stays exist."""
    return first.join(second, list(STAY_KEYS), "left").withColumn(name, larger_of(F.col(names[0]), F.col(names[1])))


def prefix_flag(diagnoses: DataFrame, prefixes: Sequence[str], name: str = "match_icd_code") -> DataFrame:
    """1 for admissions with any diagnosis of the given prefixes, 0 for the other admissions."""
    hit = or_false(prefix(F.col("icd_code")).isin(list(prefixes)))
    return diagnoses.groupBy(*ADMISSION_KEYS).agg(F.max(F.when(hit, 1).otherwise(0)).alias(name))


def sum_of_scores_label(base: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]], scores: Sequence[str],
                        excluded: DataFrame, name: str, minimum: int = 4, flag: str = "match_icd_code") -> DataFrame:
    """Whether the scores add up to ``minimum`` (unknown when any is missing), for admissions with ``flag`` 0."""
    allowed = excluded.filter(F.col(flag) == 0).select(*ADMISSION_KEYS)
    frame = reduce(lambda df, p: df.join(p[0], list(p[1]), "left"), parts, base.join(allowed, list(ADMISSION_KEYS)))
    total = reduce(lambda a, b: a + b, [F.col(s) for s in scores])
    return frame.select(*STAY_KEYS, *scores, (total >= minimum).alias(name))


def stage_label(stages: DataFrame, comorbidity: DataFrame, name: str = "sepsis_aki", stage: str = "aki_stage",
                minimum: int = 2, without: str = "renal_disease") -> DataFrame:
    """Highest and lowest stage per stay and whether the highest reaches ``minimum``; comorbid admissions drop out."""
    healthy = comorbidity.filter(F.col(without) == 0).select(*ADMISSION_KEYS)
    # Stages are reduced per stay before the join: the log of one hot admission shrinks inside the scan tasks.
    per_stay = stages.groupBy(*STAY_KEYS).agg(F.max(stage).alias(f"max_{stage}"), F.min(stage).alias(f"min_{stage}"))
    return per_stay.join(healthy, list(ADMISSION_KEYS)).select(
        *STAY_KEYS, f"max_{stage}", f"min_{stage}", (F.col(f"max_{stage}") >= minimum).alias(name))


def multi_threshold_label(measured: DataFrame, comorbidity: DataFrame, *, values: Mapping[str, str],
                          rule: Column, name: str, without: Sequence[str]) -> DataFrame:
    """Label stays by a rule over several maxima; unknown counts as false, comorbid admissions drop out.

    ``measured`` has one row per stay with at least one relevant measurement; ``values`` maps its columns to output names.
    """
    healthy = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in without])
    allowed = comorbidity.filter(healthy).select(*ADMISSION_KEYS, *without)
    named = measured.select(*STAY_KEYS, *[F.col(c).alias(n) for c, n in values.items()])
    return named.join(allowed, list(ADMISSION_KEYS)).select(
        *STAY_KEYS, *without, *values.values(), or_false(rule).alias(name))


def evidence_collection(suspicion: DataFrame, ventilation: DataFrame, ratios: DataFrame, stays: DataFrame, *,
                        statuses: Sequence[str], window: tuple[Column, Column], value: str, below: float) -> DataFrame:
    """Admissions with suspected infection and either invasive ventilation of that stay or a low ratio in a stay window.

    One row per admission with the highest qualifying stay id, 0 when no stay is known.
    """
    suspected = suspicion.select(*STAY_KEYS).distinct()
    ventilated = ventilation.filter(F.col("ventilation_status").isin(list(statuses))).select(
        "stay_id", F.lit(True).alias("ventilated")).distinct()
    low = ratios.filter(F.col(value) < below)
    impaired = windowed_aggregate(stays, low, rows=ADMISSION_KEYS, keys=ADMISSION_KEYS, windows={"w": window},
                                  values=[value]).select(*ADMISSION_KEYS, F.col(f"w_{value}_max").alias("impaired"))
    # A third of the suspicions know no stay: they can't be ventilated by stay, so they skip the join instead of meeting in one task.
    staying = suspected.where(F.col("stay_id").isNotNull()).join(ventilated, "stay_id", "left").select(*suspected.columns, "ventilated")
    homeless = suspected.where(F.col("stay_id").isNull()).withColumn("ventilated", F.lit(None).cast("boolean"))
    evidence = staying.unionByName(homeless).join(impaired, list(ADMISSION_KEYS), "left")
    return evidence.filter(F.col("ventilated").isNotNull() | F.col("impaired").isNotNull()).groupBy(
        *ADMISSION_KEYS).agg(F.max(F.coalesce("stay_id", F.lit(0))).alias("stay_id"))


def membership_label(cohort: DataFrame, collection: DataFrame, comorbidity: DataFrame, name: str = "sepsis_ali",
                     without: Sequence[str] = ("chronic_pulmonary_disease", "congestive_heart_failure"),
                     keep: bool = False) -> DataFrame:
    """Whether the stay belongs to the collection (stay id 0 there covers every stay); NULL for comorbid admissions.

    The collection has one row per admission, so the sentinel is a test on a single matched row.
    """
    found = collection.select(*ADMISSION_KEYS, F.col("stay_id").alias("_found"))
    status = comorbidity.select(*ADMISSION_KEYS, *without)
    healthy = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in without])
    member = or_false((F.col("_found") == F.col("stay_id")) | (F.col("_found") == 0))
    return (cohort.join(found, list(ADMISSION_KEYS), "left").join(status, list(ADMISSION_KEYS), "left")
            .select(*STAY_KEYS, *(without if keep else ()), F.when(healthy, member).alias(name)))


def mortality_label(detail: DataFrame, days: int = 28) -> DataFrame:
    """Length of stay, days to death, and death within ``days`` of admission (a death before it counts too)."""
    survived = days_between(F.col("admittime"), F.col("dod"))
    return detail.select(
        *STAY_KEYS, "dod", "dischtime", "admittime",
        days_between(F.col("admittime"), F.col("dischtime")).alias("los"), survived.alias("cl"),
        or_false(survived <= days).alias("death28"))


def site_flags(suspicion: DataFrame, stays: DataFrame, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Infection-site flags per (admission, stay id or NULL) from infections suspected strictly inside a stay.

    A record with a stay id keeps it in the join key; one without meets every stay of its admission. The flags are summed
    like any other value of a windowed log, so neither a hot admission nor many overlapping stays are compared all with all.
    """
    marks = {f"f{i}": F.col("specimen").isin(list(names)).cast("int") for i, names in enumerate(categories.values())}
    window = {"w": open_window((F.col("intime"), F.col("outtime")))}
    infections = suspicion.select(*STAY_KEYS, "suspected_infection_time", *[c.alias(n) for n, c in marks.items()])

    def counted(records: DataFrame, keys: Sequence[str]) -> DataFrame:
        return windowed_aggregate(stays, records, rows=keys, keys=keys, windows=window, values=list(marks),
                                  time="suspected_infection_time")

    exact = counted(infections.filter(F.col("stay_id").isNotNull()), STAY_KEYS)
    wildcard = counted(infections.filter(F.col("stay_id").isNull()), ADMISSION_KEYS)
    found = exact.unionByName(wildcard.withColumn("stay_id", F.lit(None).cast(suspicion.schema["stay_id"].dataType)))
    flags = [(F.col(f"w_{n}_max") == 1).alias(category) for n, category in zip(marks, categories)]
    return found.select(*STAY_KEYS, F.col("w_rows").alias("count"), *flags)


def flag_totals(flags: DataFrame, names: Sequence[str], suffix: str = "_t") -> DataFrame:
    """How many rows carry each flag, in one row."""
    return flags.agg(*[F.count_if(F.col(f"`{n}`")).alias(f"{n}{suffix}") for n in names])
