"""Windowed event statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.operators.events import (
    STAY_KEYS,
    combine_items,
    event_stats,
    horizon_window,
    interval_join,
    keep_all_stays,
    spread_items,
    stay_window,
    windowed_column_stats,
)
from stayloom.operators.windows import windowed_aggregate
from stayloom.sources.roles import Roles
from verification.registry import query, r8_all

ITEMS = ("click", "view", "purchase", "error")
WINDOW_24 = "l.charttime >= s.intime - interval 6 hour and l.charttime <= s.intime + interval 24 hour"
WINDOW_STAY = "l.charttime >= s.intime - interval 6 hour and l.charttime <= s.outtime"
STATS = "min(l.valuenum) min_value, max(l.valuenum) max_value, round(avg(l.valuenum), 8) avg_value"
ADMISSION = "s.subject_id = l.subject_id and s.hadm_id = l.hadm_id"


@query("windowed_event_stats", f"""
    select s.subject_id, s.hadm_id, s.stay_id, l.itemid, {STATS}, 'labs' t_name
    from r_stays s join r_labs l on {ADMISSION} where {WINDOW_24} group by all""")
def windowed_event_stats(r: Roles) -> DataFrame:
    """All items of the log in one scan and one join; the per-item view is a filter on the result."""
    return r8_all(event_stats(r.stays(), r.labs(), window=horizon_window(6, 24), items=ITEMS, tag="labs"), "avg_value")


@query("stay_event_stats", f"""
    select s.subject_id, s.hadm_id, s.stay_id, l.itemid, {STATS}, 'labs' t_name
    from r_stays s join r_labs l on {ADMISSION} where {WINDOW_STAY} group by all""")
def stay_event_stats(r: Roles) -> DataFrame:
    return r8_all(event_stats(r.stays(), r.labs(), window=stay_window(6), items=ITEMS, tag="labs"), "avg_value")


@query("bedside_event_stats", f"""
    select s.subject_id, s.hadm_id, s.stay_id, l.itemid, {STATS}, 'bedside' t_name
    from r_stays s join r_bedside l on {ADMISSION} and s.stay_id = l.stay_id
    where {WINDOW_24} and l.itemid = 'view' group by all""")
def bedside_event_stats(r: Roles) -> DataFrame:
    return r8_all(event_stats(r.stays(), r.bedside(), window=horizon_window(6, 24), keys=STAY_KEYS, items=["view"],
                              tag="bedside"), "avg_value")


@query("interval_join", f"""
    select s.subject_id, s.hadm_id, s.stay_id, l.itemid, l.charttime, l.valuenum
    from r_stays s join r_labs l on {ADMISSION} where {WINDOW_24}""")
def interval_join_query(r: Roles) -> DataFrame:
    return interval_join(r.stays(), r.labs(), keys=("subject_id", "hadm_id"), window=horizon_window(6, 24)).drop(
        "intime", "outtime")


@query("interval_join_open", """
    select s.subject_id, s.hadm_id, s.stay_id, l.itemid, l.charttime, l.valuenum
    from r_stays s join r_labs l on s.subject_id = l.subject_id and s.hadm_id = l.hadm_id
    where l.charttime > s.intime and l.charttime < s.outtime""")
def interval_join_open(r: Roles) -> DataFrame:
    return interval_join(r.stays(), r.labs(), keys=("subject_id", "hadm_id"), strict=True,
                         window=(F.col("intime"), F.col("outtime"))).drop("intime", "outtime")


@query("interval_left_join", """
    select s.subject_id, s.hadm_id, s.stay_id, max(l.valuenum) v_max, min(l.valuenum) v_min,
           round(avg(l.valuenum), 8) v_avg
    from r_stays s left join r_labs l on s.subject_id = l.subject_id and s.hadm_id = l.hadm_id
         and l.itemid = 'purchase' and s.intime <= l.charttime and l.charttime <= s.outtime
         and l.charttime <= s.intime + interval 24 hour
    group by all""")
def interval_left_join(r: Roles) -> DataFrame:
    """Bounds belong to the join: stays without a match keep a row of NULLs."""
    stays = r.stays()
    window = (F.col("intime"), F.least(F.col("outtime"), horizon_window(0, 24)[1]))
    stats = event_stats(stays, r.labs(), window=window, items=["purchase"]).select(
        *STAY_KEYS, F.col("max_value").alias("v_max"), F.col("min_value").alias("v_min"),
        F.col("avg_value").alias("v_avg"))
    return r8_all(keep_all_stays(stays, stats, STAY_KEYS), "v_avg")


@query("windowed_filtered_max", """
    select s.subject_id, s.hadm_id, max(l.valuenum) ok_value
    from r_stays s join r_labs l on s.subject_id = l.subject_id and s.hadm_id = l.hadm_id
    where l.valuenum < 200 and l.charttime >= s.intime - interval 6 hour and l.charttime <= s.outtime
    group by all""")
def windowed_filtered_max(r: Roles) -> DataFrame:
    low = r.labs().filter(F.col("valuenum") < 200)
    return windowed_aggregate(r.stays(), low, rows=("subject_id", "hadm_id"), keys=("subject_id", "hadm_id"),
                              windows={"w": stay_window(6)}, values=["valuenum"]).select(
        "subject_id", "hadm_id", F.col("w_valuenum_max").alias("ok_value"))


@query("two_level_agg", f"""
    select subject_id, hadm_id, stay_id, min(min_value) g_min_value, max(max_value) g_max_value,
           round(avg(min_value), 8) g_avg_value
    from (select s.subject_id, s.hadm_id, s.stay_id, l.itemid, {STATS} from r_stays s join r_labs l on {ADMISSION}
          where {WINDOW_24} and l.itemid in ('click', 'view', 'purchase') group by all)
    group by all""")
def two_level_agg(r: Roles) -> DataFrame:
    stats = event_stats(r.stays(), r.labs(), window=horizon_window(6, 24), items=["click", "view", "purchase"])
    return r8_all(combine_items(stats), "g_avg_value")


@query("multi_column_stats", """
    select s.subject_id, s.hadm_id, s.stay_id, """ + ", ".join(
    f"min({c}) {c}_min, max({c}) {c}_max, round(avg({c}), 8) {c}_avg" for c in ("valuenum", "half", "excess")) + """
    from r_stays s join (select *, valuenum / 2 half, case when valuenum > 50 then valuenum - 50 end excess
         from r_labs) l on s.subject_id = l.subject_id and s.hadm_id = l.hadm_id
    where """ + WINDOW_24 + " group by all")
def multi_column_stats(r: Roles) -> DataFrame:
    value = F.col("valuenum")
    log = r.labs().withColumns({"half": value / 2, "excess": F.when(value > 50, value - 50)})
    columns = ("valuenum", "half", "excess")
    stats = windowed_column_stats(r.stays(), log, columns, window=horizon_window(6, 24))
    return r8_all(stats, *[f"{c}_avg" for c in columns])


@query("analyte_wide", """
    select s.subject_id, s.hadm_id, s.stay_id, """ + ", ".join(
    f"""max(l.res) filter (where l.analyte = '{a}' and {w}) {a}_max,
        min(l.res) filter (where l.analyte = '{a}' and {w}) {a}_min,
        round(avg(l.res) filter (where l.analyte = '{a}' and {w}), 8) {a}_avg"""
    for a, w in (("click", "true"), ("view", "true"), ("purchase", "l.at <= s.intime + interval 24 hour"),
                 ("error", "l.at <= s.intime + interval 24 hour"))) + """
    from r_stays s left join cleaned l on s.subject_id = l.patient_no and s.intime <= l.at and l.at <= s.outtime
    group by all""",
       cleaned="""select patient_no, analyte, cast(sample_time as timestamp) as at,
                  try_cast(nullif(replace(replace(result, '测不出', ''), '-', ''), '') as double) res from r_text""")
def analyte_wide(r: Roles) -> DataFrame:
    """Twelve text tables read as one tagged log: one join, one aggregate, stays without samples kept."""
    from stayloom.operators.wide import analyte_features

    stays = r.stays().select("subject_id", "hadm_id", "stay_id", "intime", "outtime")
    samples = r.text_results().withColumnRenamed("patient_no", "subject_id")
    wide = analyte_features(stays, samples, analytes=ITEMS, capped=("purchase", "error"), patient_key="subject_id",
                            row_keys=STAY_KEYS, junk=("测不出", "-"))
    return r8_all(wide, *[f"{a}_avg" for a in ITEMS])


@query("wide_features", f"""
    select c.*, {", ".join(f"f.{i}_min, f.{i}_max, f.{i}_avg" for i in ITEMS)}, f.grouped_min, f.grouped_max,
           f.grouped_avg, k.charlson_comorbidity_index, d.dod,
           (f.click_min + f.click_max) / 2 click_mid
    from cohort c
    left join (select subject_id, hadm_id, stay_id, {", ".join(
        f"min(case when itemid = '{i}' then min_value end) {i}_min, max(case when itemid = '{i}' then max_value end) "
        f"{i}_max, round(avg(case when itemid = '{i}' then avg_value end), 8) {i}_avg" for i in ITEMS)},
        min(case when itemid in ('click', 'view') then min_value end) grouped_min,
        max(case when itemid in ('click', 'view') then max_value end) grouped_max,
        round(avg(case when itemid in ('click', 'view') then min_value end), 8) grouped_avg
        from item_stats group by all) f using (subject_id, hadm_id, stay_id)
    left join r_comorb k using (subject_id, hadm_id)
    left join r_detail d using (subject_id, hadm_id, stay_id)""",
       item_stats=f"""select s.subject_id, s.hadm_id, s.stay_id, l.itemid, min(l.valuenum) min_value,
                      max(l.valuenum) max_value, avg(l.valuenum) avg_value
                      from r_stays s join r_labs l on {ADMISSION} where {WINDOW_24} group by all""",
       cohort="""select s.subject_id, s.hadm_id, s.stay_id, a.age, s.outtime, s.intime,
                 round(date_diff('microsecond', s.intime, s.outtime) / 3.6e9 / 24, 8) stay_day,
                 coalesce(p.sepsis3, false) sepsis
                 from r_stays s left join r_sepsis3 p using (subject_id, stay_id)
                 left join r_age a using (subject_id, hadm_id)
                 where a.age >= 18 and a.age < 89 and date_diff('microsecond', s.intime, s.outtime) / 3.6e9 > 48""")
def wide_features(r: Roles) -> DataFrame:
    """One row per cohort stay: item features of one pass over the log, joined with per-key attributes."""
    from stayloom.functions.scalar import midpoint
    from stayloom.operators.cohort import build_cohort
    from stayloom.operators.wide import join_features

    cohort = build_cohort(r.stays(), r.sepsis3(), r.age())
    stats = event_stats(r.stays(), r.labs(), window=horizon_window(6, 24), items=ITEMS)
    features = spread_items(stats, {**{i: [i] for i in ITEMS}, "grouped": ["click", "view"]})
    wide = join_features(cohort, [
        (features, STAY_KEYS),
        (r.comorbidity().select("subject_id", "hadm_id", "charlson_comorbidity_index"), ("subject_id", "hadm_id")),
        (r.detail().select(*STAY_KEYS, "dod"), STAY_KEYS),
    ]).withColumn("click_mid", midpoint(F.col("click_min"), F.col("click_max")))
    return r8_all(wide, "stay_day", "grouped_avg", *[f"{i}_avg" for i in ITEMS])
