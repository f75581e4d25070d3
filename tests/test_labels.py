from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayloom.functions import scalar as S
from stayloom.operators import cohort as C
from stayloom.operators import labels as L
from stayloom.operators.clean import latest_per_key, paired_ratio

T0 = datetime(2024, 1, 1)
IDS = "subject_id long, hadm_id long, stay_id long"


@pytest.mark.parametrize("value, low, high, grade", [
    (None, 0, None, 0), (99.9, 2, 2, 2), (100.0, 1, 2, 2), (149.0, 1, 2, 2), (150.0, 0, 2, 2), (16.7, 2, 1, 2),
    (16.9, 2, 2, 2), (14.3, 2, 0, 2), (14.5, 2, 1, 2), (1.0, 2, 0, 1), (0.5, 2, 0, 0)])
def test_threshold_scores(spark, value, low, high, grade):
    stats = spark.createDataFrame([(1, 1, 1, value, value)], f"{IDS}, min_value double, max_value double")
    assert L.low_count_score(stats, "s").first()["s"] == low
    assert L.ratio_score(stats, "s", "r").first()["s"] == high
    assert L.grade_score(stats, "max_value", "s").first()["s"] == grade


def test_sum_is_unknown_when_a_part_is(spark):
    base = spark.createDataFrame([(1, 1, 1, 2), (1, 1, 2, 2), (2, 2, 3, 2), (3, 3, 4, 2), (4, 4, 5, 0)], f"{IDS}, a int")
    part = spark.createDataFrame([(1, 1, 1, 2), (2, 2, 3, 2), (4, 4, 5, 3)], f"{IDS}, b int")
    flags = spark.createDataFrame([(1, 1, 0), (2, 2, 1), (4, 4, 0)], "subject_id long, hadm_id long, match_icd_code int")
    got = {r["stay_id"]: r["y"] for r in L.sum_of_scores_label(
        base, [(part, ["subject_id", "hadm_id", "stay_id"])], ["a", "b"], flags, "y").collect()}
    # admission 2 is excluded by its diagnosis, admission 3 has no diagnosis row at all
    assert got == {1: True, 2: None, 5: False}


def test_combine_scores_keeps_first_source(spark):
    a = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 2, None)], f"{IDS}, a int")
    b = spark.createDataFrame([(1, 1, 1, 2), (1, 1, 3, 2)], f"{IDS}, b int")
    got = {r["stay_id"]: r["s"] for r in L.combine_scores(a, b, ("a", "b"), "s").collect()}
    assert got == {1: 2, 2: 0}


def test_prefix_flag_of_null_code(spark):
    dx = spark.createDataFrame([(1, 1, None), (2, 2, "D689"), (2, 2, "Z"), (3, 3, "Z")],
                               "subject_id long, hadm_id long, icd_code string")
    got = {r["subject_id"]: r["match_icd_code"] for r in L.prefix_flag(dx, ["D68"]).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_membership_truth_table(spark):
    cohort = spark.createDataFrame([(i, i, 10 * i) for i in range(1, 7)], IDS)
    collection = spark.createDataFrame([(1, 1, 10), (2, 2, 0), (3, 3, 99), (5, 5, 50)], IDS)
    sick = spark.createDataFrame(
        [(1, 1, 0, 0), (2, 2, 0, 0), (3, 3, 0, 0), (4, 4, 0, 0), (5, 5, 1, 0)],
        "subject_id long, hadm_id long, chronic_pulmonary_disease int, congestive_heart_failure int")
    got = {r["subject_id"]: r["sepsis_ali"] for r in L.membership_label(cohort, collection, sick).collect()}
    # own stay, unknown stay, another stay, no evidence, comorbid, no comorbidity record
    assert got == {1: True, 2: True, 3: False, 4: False, 5: None, 6: None}


def test_mortality(spark):
    rows = [(1, 1, 1, T0, T0, T0 + timedelta(days=28)), (1, 1, 2, T0, T0, T0 + timedelta(days=28, seconds=1)),
            (1, 1, 3, T0, T0, None), (1, 1, 4, T0, T0, T0 - timedelta(days=3))]
    df = spark.createDataFrame(rows, f"{IDS}, admittime timestamp_ntz, dischtime timestamp_ntz, dod timestamp_ntz")
    assert [r["death28"] for r in L.mortality_label(df).orderBy("stay_id").collect()] == [True, False, False, True]


def test_wildcard_join(spark):
    left = spark.createDataFrame([(1, 1, 10), (1, 1, 11), (2, 2, 20)], IDS)
    right = spark.createDataFrame([(1, 1, 10, "x"), (1, 1, None, "y"), (3, 3, None, "z")], f"{IDS}, v string")
    got = C.left_join_wildcard_key(left, right, ["subject_id", "hadm_id"], "stay_id")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 10, "x"), (1, 1, 10, "y"), (1, 1, 11, "y")]


def test_latest_keeps_ties(spark):
    df = spark.createDataFrame([("a", "2024-01-02", 1), ("a", "2024-01-02", 2), ("a", "2024-01-01", 3), ("b", None, 4)],
                               "k string, t string, v int")
    assert sorted(r["v"] for r in latest_per_key(df, ["k"], "t").collect()) == [1, 2]


def test_ratio_of_zero_is_null(spark):
    a = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, 4.0)], "k int, v double")
    b = spark.createDataFrame([(1, 2.0), (2, 0.0)], "k int, v double")
    got = {r["k"]: r["ratio"] for r in paired_ratio(a, b, keys=["k"], value="v").collect()}
    assert got == {1: 2.0, 2: None, 3: None}


def test_cleaning_and_recoding(spark):
    df = spark.createDataFrame([("测不出", "F", "t", True), ("-", "M", "f", False), ("-1.5", "1", None, None),
                                ("bad", "X", "t", True), (None, None, "t", True)],
                               "x string, gender string, death28 string, sepsis boolean")
    clean = [r[0] for r in df.select(S.clean_numeric(F.col("x"), ("测不出", "-"))).collect()]
    assert clean == [None, None, 1.5, None, None]
    coded = S.recode(df, {"gender": {"F": 1, "M": 0}, "death28": {"t": 1, "f": 0}, "sepsis": {}, "absent": {"t": 1}})
    assert [tuple(r)[1:] for r in coded.collect()] == [(1, 1, 1), (0, 0, 0), (1, None, None), (None, 1, 1), (None, 1, 1)]


def test_rounding_and_decoding(spark):
    df = spark.createDataFrame([(0.5, 0.2, 0.2), (1.5, 0.9, 0.1), (2.5, 0.1, 0.9)], "v double, a double, b double")
    got = df.select(S.round_half_even(F.col("v")), S.nearer_corner(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 1), (2.0, 1), (2.0, 0)]


def test_cohort_bounds(spark):
    stays = spark.createDataFrame(
        [(i, i, i, T0, T0 + timedelta(hours=h)) for i, h in [(1, 48), (2, 49), (3, 49), (4, 49), (5, 49)]],
        f"{IDS}, intime timestamp_ntz, outtime timestamp_ntz")
    age = spark.createDataFrame([(1, 1, 50), (2, 2, 18), (3, 3, 89), (4, 4, 17)], "subject_id long, hadm_id long, age int")
    sepsis = spark.createDataFrame([(2, 2, None)], "subject_id long, stay_id long, sepsis3 boolean")
    assert [(r["stay_id"], r["sepsis"]) for r in C.build_cohort(stays, sepsis, age).collect()] == [(2, False)]
