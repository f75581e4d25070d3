"""The external hospital extract: text-typed tables to the same wide row."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayloom.functions.scalar import (
    as_double,
    clean_numeric,
    mean_arterial_pressure,
    midpoint,
    parse_timestamp,
    sum_flags,
)
from stayloom.operators.clean import latest_per_key, paired_ratio
from stayloom.operators.wide import analyte_features
from stayloom.plans import fixed_values as V

MEASURED = (*V.ANALYTES, V.RATIO_ANALYTE)


def with_comorbidity_index(patients: DataFrame) -> DataFrame:
    """Set the comorbidity index to the sum of the comorbidity flags."""
    return patients.withColumn("charlson_comorbidity_index_max", sum_flags(V.COMORBIDITY_FLAGS))


def latest_admissions(patients: DataFrame) -> DataFrame:
    """The latest admission of each patient (the time is ISO text, so its order is the order in time)."""
    return latest_per_key(patients, [V.PATIENT_KEY], V.ADMITTED).select(
        "*", parse_timestamp(F.col(V.ADMITTED)).alias("in_time"), parse_timestamp(F.col(V.DISCHARGED)).alias("out_time"))


def tagged_samples(analytes: Mapping[str, DataFrame]) -> DataFrame:
    """The analyte tables as one log with a tag column: (patient key, analyte, sample_time, result)."""
    parts = [df.select(F.col(V.SAMPLE_PATIENT).alias(V.PATIENT_KEY), F.lit(name).alias("analyte"),
                       F.col(V.SAMPLE_TIME).alias("sample_time"), F.col(V.SAMPLE_RESULT).alias("result"))
             for name, df in analytes.items()]
    return reduce(DataFrame.unionByName, parts)


def oxygenation_ratio(samples: DataFrame) -> DataFrame:
    """Oxygen pressure over inspired fraction where both were sampled at the same instant."""
    def of(analyte: str) -> DataFrame:
        return samples.filter(F.col("analyte") == analyte).withColumn("value", as_double(F.col("result")))

    return paired_ratio(of("pao2"), of("fio2"), keys=(V.PATIENT_KEY, "sample_time"), value="value").select(
        V.PATIENT_KEY, "sample_time", F.col("first").alias("po2"), F.col("second").alias("fio2"),
        F.col("ratio").alias(V.RATIO_ANALYTE))


def analyte_table(admissions: DataFrame, samples: DataFrame) -> DataFrame:
    """``<analyte>_{max,min,avg}`` per patient for the twelve analytes and the oxygenation ratio."""
    ratio = oxygenation_ratio(samples).select(
        V.PATIENT_KEY, F.lit(V.RATIO_ANALYTE).alias("analyte"), "sample_time",
        F.col(V.RATIO_ANALYTE).cast("string").alias("result"))
    return analyte_features(admissions, samples.unionByName(ratio), analytes=MEASURED, capped=V.CAPPED_ANALYTES,
                            patient_key=V.PATIENT_KEY, row_keys=[V.PATIENT_KEY], junk=(), start="in_time", end="out_time")


def _text_triple(name: str, low: Column, high: Column, vital: bool = False) -> list[Column]:
    parts = {"min": low, "max": high, "avg": midpoint(low, high)}
    return [c.alias(f"{s}_{name}" if vital else f"{name}_{s}") for s, c in parts.items()]


def external_columns(fix_chloride: bool = True) -> list[Column]:
    """The wide row's columns over an admission joined with its analyte table.

    The source fills the mean chloride from another analyte; ``fix_chloride=False`` keeps that.
    """
    out = [F.col(V.NAME_COLUMN).alias("name"), F.col(V.AGE_COLUMN).alias("age"), F.col(V.PATIENT_KEY).alias("subject_id"),
           F.col("in_time"), F.col("out_time"), F.col("sepsis")]
    for feature, analyte in V.EXTERNAL_ANALYTE_FEATURES.items():
        for stat in ("min", "max", "avg"):
            source = "ag" if (feature, stat) == ("chloride", "avg") and not fix_chloride else analyte
            value = F.col(f"{source}_{stat}")
            out.append((value * V.GLUCOSE_FACTOR if feature == "glucose" else value).alias(f"{feature}_{stat}"))
    out.append(F.col("charlson_comorbidity_index_max"))
    for feature, stem in V.EXTERNAL_TEXT_FEATURES.items():
        out += _text_triple(feature, as_double(F.col(f"{stem}_min")), as_double(F.col(f"{stem}_max")))
    out.append(as_double(F.col(V.URINE_COLUMN)).alias("urineoutput_max"))

    def vital(stem: str, suffix: str) -> Column:
        return as_double(F.col(stem + suffix))

    bounds = {v: (vital(stem, V.VITAL_MIN_SUFFIX), vital(stem, V.VITAL_MAX_SUFFIX)) for v, stem in V.EXTERNAL_VITALS.items()}
    bounds["mbp"] = tuple(mean_arterial_pressure(s, d) for s, d in zip(bounds["sbp"], bounds["dbp"]))
    for name, (low, high) in bounds.items():
        out += _text_triple(name, low, high, vital=True)
    out.append(F.when(F.col(V.MALE_COLUMN) == "1", "M").otherwise("F").alias("gender"))
    for name, stem in V.CLOTTING_TEXT.items():
        junk = (V.UNDETECTED, "-") if name == "inr" else (V.UNDETECTED,)
        out += _text_triple(name, *[clean_numeric(F.col(f"{stem}_{s}"), junk) for s in ("min", "max")])
    out.append(F.when(as_double(F.col(V.DEATH_COLUMN)) == 1, "t").otherwise("f").alias("death28"))
    out += [F.when(F.col(flag) == "1", "t").when(F.col(flag) == "0", "f").alias(flag) for flag in V.OUTCOME_FLAGS]
    return out


def external_wide(patients: DataFrame, analytes: Mapping[str, DataFrame], *, fix_chloride: bool = True) -> DataFrame:
    """One row per latest admission in the internal feature names and types."""
    return external_wide_from(patients, tagged_samples(analytes), fix_chloride=fix_chloride)


def external_wide_from(patients: DataFrame, samples: DataFrame, *, fix_chloride: bool = True) -> DataFrame:
    """``external_wide`` over one tagged log of samples."""
    admissions = latest_admissions(with_comorbidity_index(patients))
    # Tied latest admissions share the patient key: a sample counts once per admission it lies in, and a key has one row.
    features = analyte_table(admissions, samples).distinct()
    return admissions.join(features, V.PATIENT_KEY, "left").select(*external_columns(fix_chloride))
