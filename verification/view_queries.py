"""Every named view of the ICU study and of the external extract, against independently written SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.operators.events import STAY_KEYS
from stayloom.plans import fixed_values as V
from stayloom.plans import hospital
from stayloom.plans.icu import WIDE_COLUMNS, IcuStudy
from stayloom.sources.roles import Roles
from verification.registry import query, r8
from verification.warehouse import CHART_ITEM, HOSPITAL, WAREHOUSE, DerivedTables, duck_ctes

KEYS = "s.subject_id, s.hadm_id, s.stay_id"
IDS = "subject_id, hadm_id, stay_id"
DAY = "l.charttime >= s.intime - interval 6 hour and l.charttime <= s.intime + interval 24 hour"
WHOLE = "l.charttime >= s.intime - interval 6 hour and l.charttime <= s.outtime"
WITHIN = "l.charttime >= s.intime and l.charttime <= s.outtime"
ON = {"admission": "s.subject_id = l.subject_id and s.hadm_id = l.hadm_id",
      "stay": "s.subject_id = l.subject_id and s.stay_id = l.stay_id"}


def stats(column: str = "l.valuenum") -> str:
    return f"min({column}) min_value, max({column}) max_value, avg({column}) avg_value"


def items(ids, window: str) -> str:
    return f"""select {KEYS}, l.itemid, {stats()} from w_icustays s join w_labevents l on {ON["admission"]}
        where {window} and l.itemid in ({", ".join(map(str, ids))}) group by all"""


def measured(table: str, column: str, on: str = "admission") -> str:
    return f"""select {KEYS}, {stats("l." + column)}, '{column}' e_type from w_icustays s join w_{table} l on {ON[on]}
        where {DAY} group by all"""


def attribute(table: str, column: str, on: str) -> str:
    return f"""select {KEYS}, {stats("l." + column)}, '{column}' e_type from w_icustays s left join w_{table} l on {ON[on]}
        group by all"""


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


VIEW_SQL: dict[str, str] = {}
for _name, (_tag, _item) in V.DAY_ITEM_VIEWS.items():
    VIEW_SQL[_name] = f"select *, '{_tag}' t_name from ({items([_item], DAY)})"
for _name, (_tag, _ids) in V.DAY_GROUP_VIEWS.items():
    VIEW_SQL[_name] = f"""select {IDS}, min(min_value) g_min_value, max(max_value) g_max_value, avg(min_value) g_avg_value
        from ({items(_ids, DAY)}) group by all"""
for _item in V.STAY_ITEMS:
    VIEW_SQL[f"self_{_item}"] = f"select *, '{_item}' t_name from ({items([_item], WHOLE)})"

COUNT_STATS = ", ".join(f"min(l.{c}) {c}_min, max(l.{c}) {c}_max, avg(l.{c}) {c}_avg" for c in V.BLOOD_COUNTS)
CLOTTING = "min(l.inr) min_inr, max(l.inr) max_inr, avg(l.inr) avg_inr"
VITAL_STATS = ", ".join(f"min(l.{v}_min) min_{v}, max(l.{v}_max) max_{v}, avg(l.{v}_mean) avg_{v}" for v in V.VITALS)
LOW = "case when min_value < 100 then 2 when min_value < 150 then 1 else 0 end"
HEALTHY_LUNG = "k.chronic_pulmonary_disease = 0 and k.congestive_heart_failure = 0"
SITE_FLAGS = ", ".join(f'bool_or(i.specimen in ({listed(names)})) "{site}"' for site, names in V.SITE_SPECIMENS.items())

VIEW_SQL |= {
    "self_collection_all": f"""select {KEYS}, p.stay_id sepsis3_stay_id, p.sepsis3, a.age, coalesce(p.sepsis3, false) sepsis,
        k.rheumatic_disease, k.malignant_cancer, k.metastatic_solid_tumor, k.aids from w_icustays s
        left join w_sepsis3 p on p.subject_id = s.subject_id and p.stay_id = s.stay_id
        left join w_age a on a.subject_id = s.subject_id and a.hadm_id = s.hadm_id
        left join w_charlson k on k.subject_id = s.subject_id and k.hadm_id = s.hadm_id""",
    "self_collection": f"""select {KEYS}, a.age, s.outtime, s.intime,
        date_diff('microsecond', s.intime, s.outtime) / 3.6e9 / 24 stay_day, coalesce(p.sepsis3, false) sepsis
        from w_icustays s left join w_sepsis3 p on p.subject_id = s.subject_id and p.stay_id = s.stay_id
        left join w_age a on a.subject_id = s.subject_id and a.hadm_id = s.hadm_id
        where a.age between 18 and 88 and date_diff('microsecond', s.intime, s.outtime) / 3.6e9 > 48""",
    "self_blood_differential": f"""select {KEYS}, {COUNT_STATS} from w_icustays s join w_blood_differential l
        on {ON["admission"]} where {DAY} group by all""",
    "self_LactateDehydrogenase": """select subject_id, stay_id, max(lactate_max) max_value, min(lactate_min) min_value
        from w_first_day_bg_art where lactate_max is not null group by all""",
    "self_calcium": measured("chemistry", "calcium"),
    "self_calcium_new": f"select *, 'Free Calcium' t_name from ({items(V.FREE_CALCIUM[1], DAY)})",
    "self_alp": measured("enzyme", "alp"),
    "self_gcs": measured("gcs", "gcs", "stay"),
    "self_charlson_comorbidity_index": attribute("charlson", "charlson_comorbidity_index", "admission"),
    "self_sofa": attribute("first_day_sofa", "sofa", "admission"),
    "self_urineoutput": attribute("first_day_urine_output", "urineoutput", "stay"),
    "self_weight_admit": attribute("first_day_weight", "weight_admit", "stay"),
    "self_hr_mbp_resp_temperature": f"""select {KEYS}, {VITAL_STATS}, 'hr_mbp_resp_temperature' e_type
        from w_icustays s left join w_first_day_vitalsign l on {ON["stay"]} group by all""",
    "self_icp": measured("icp", "icp", "stay"),
    "self_crp": measured("inflammation", "crp"),
    "self_sapsii": f"""select {KEYS}, avg(l.sapsii) sapsii, 'sapsii' e_type from w_icustays s join w_sapsii l
        on {ON["stay"]} and s.hadm_id = l.hadm_id where {DAY.replace("charttime", "starttime")} group by all""",
    "self_pt": measured("coagulation", "pt"),
    "self_inr": f"""select {KEYS}, {CLOTTING}, 'inr' e_type from w_icustays s join w_coagulation l on {ON["admission"]}
        where {DAY} group by all""",
    "self_inr_total": f"""select {KEYS}, {CLOTTING}, 'inr' e_type from w_icustays s join w_coagulation l
        on {ON["admission"]} where {WITHIN} group by all""",
    "self_death_ratio": f"""select {IDS}, dod, dischtime, admittime,
        date_diff('microsecond', admittime, dischtime) / 3.6e9 / 24 los,
        date_diff('microsecond', admittime, dod) / 3.6e9 / 24 cl,
        coalesce(date_diff('microsecond', admittime, dod) / 3.6e9 / 24 <= 28, false) death28 from w_icustay_detail""",
    "self_sepsis_aki": """select g.subject_id, g.hadm_id, g.stay_id, max(aki_stage) max_aki_stage,
        min(aki_stage) min_aki_stage, max(aki_stage) >= 2 sepsis_aki from w_kdigo_stages g
        join w_charlson k on g.subject_id = k.subject_id and g.hadm_id = k.hadm_id and k.renal_disease = 0 group by all""",
    "self_liver_injury_collection": f"select distinct {IDS} from ({items(V.LIVER_ITEMS, WHOLE)})",
    "self_platelet_count_score": f"""select {IDS}, platelet_count_score_51265, platelet_count_score_51704,
        greatest(coalesce(platelet_count_score_51265, 0), coalesce(platelet_count_score_51704, 0)) platelet_count_score
        from (select {IDS}, {LOW} platelet_count_score_51265 from v_self_51265)
        left join (select {IDS}, {LOW} platelet_count_score_51704 from v_self_51704) using ({IDS})""",
    "self_sepsis_li": f"""select {KEYS}, k.mild_liver_disease, k.severe_liver_disease, a.max_value max_50885,
        b.max_value max_53089, i.max_inr,
        coalesce((a.max_value > 2 or b.max_value > 2) and i.max_inr > 1.5, false) sepsis_li
        from v_self_liver_injury_collection s left join v_self_inr_total i using ({IDS})
        left join v_self_50885 a using ({IDS}) left join v_self_53089 b using ({IDS})
        join w_charlson k on k.subject_id = s.subject_id and k.hadm_id = s.hadm_id
        where k.mild_liver_disease = 0 and k.severe_liver_disease = 0""",
    "self_ptr_score": f"""select {IDS}, max_value / 12 max_pt_12, case when max_value is null then null
        when max_value / 12 > 1.4 then 2 when max_value / 12 > 1.2 then 1 else 0 end ptr
        from ({items([V.PROTHROMBIN_ITEM], WHOLE)})""",
    "self_sofa24_score": """select stay_id, top sofa_24hours, case when top >= 2 then 2 when top >= 1 then 1 else 0 end
        sofa24_score from (select stay_id, max(sofa_24hours) top from w_sofa group by 1)""",
    "self_sepsis_co_match": f"""select subject_id, hadm_id, max((coalesce(substr(icd_code, 1, 3) in
        ({listed(V.COAGULATION_CODES)}), false))::int) match_icd_code from w_diagnoses_icd group by all""",
    "self_sepsis_co": f"""select c.subject_id, c.hadm_id, c.stay_id, c.platelet_count_score, p.ptr, g.sofa24_score,
        c.platelet_count_score + p.ptr + g.sofa24_score >= 4 sepsis_co from v_self_platelet_count_score c
        left join v_self_ptr_score p using ({IDS}) left join v_self_sofa24_score g using (stay_id)
        join v_self_sepsis_co_match d on d.subject_id = c.subject_id and d.hadm_id = c.hadm_id where d.match_icd_code = 0""",
    "self_sepsis_ali_collection": f"""select i.subject_id, i.hadm_id, max(coalesce(i.stay_id, 0)) stay_id
        from (select distinct {IDS} from w_suspicion_of_infection) i
        where exists (select 1 from w_ventilation v where v.stay_id = i.stay_id
                      and v.ventilation_status in ({listed(V.INVASIVE_VENTILATION)}))
           or exists (select 1 from w_bg l join w_icustays s on {ON["admission"]} where l.subject_id = i.subject_id
                      and l.hadm_id = i.hadm_id and l.pao2fio2ratio < 200 and {WHOLE})
        group by all""",
    "self_sepsis_ali": f"""select c.subject_id, c.hadm_id, c.stay_id, case when {HEALTHY_LUNG}
        then e.subject_id is not null end sepsis_ali from v_self_collection c
        left join v_self_sepsis_ali_collection e on e.subject_id = c.subject_id and e.hadm_id = c.hadm_id
        and e.stay_id in (c.stay_id, 0)
        left join w_charlson k on k.subject_id = c.subject_id and k.hadm_id = c.hadm_id""",
    "self_icd_code_5x_counts": f"""select substr(d.icd_code, 1, 3) x_type, count(*) count from v_self_collection c
        join w_diagnoses_icd d using (subject_id, hadm_id) where substr(d.icd_code, 1, 3) in ({listed(V.KIDNEY_CODES)})
        group by 1""",
    "respiratory_specimen_stays": f"""select c.subject_id, c.hadm_id, c.stay_id, k.chronic_pulmonary_disease,
        k.congestive_heart_failure, m.sepsis_ali from v_self_collection c join v_self_sepsis_ali m using ({IDS})
        left join w_charlson k on k.subject_id = c.subject_id and k.hadm_id = c.hadm_id
        where c.sepsis and exists (select 1 from w_suspicion_of_infection i where i.subject_id = c.subject_id
        and i.hadm_id = c.hadm_id and i.stay_id = c.stay_id and i.specimen in ({listed(V.RESPIRATORY_SPECIMENS)}))""",
    "self_specimen_count": f"""select i.hadm_id, i.subject_id, i.stay_id, count(*) count, {SITE_FLAGS}
        from w_suspicion_of_infection i join v_self_collection c on i.hadm_id = c.hadm_id and i.subject_id = c.subject_id
        and (i.stay_id is null or i.stay_id = c.stay_id)
        where i.suspected_infection_time > c.intime and i.suspected_infection_time < c.outtime group by 1, 2, 3""",
    "self_specimen_totals": "select " + ", ".join(
        f'coalesce(sum(("{site}")::int), 0)::bigint "{site}_t"' for site in V.SITE_SPECIMENS) + " from v_self_specimen_count",
}

TRIPLE = ("min", "max", "avg")
LAB_COLUMNS = []
for _feature, _ids in V.WIDE_LAB_FEATURES.items():
    _in = f"itemid in ({', '.join(map(str, _ids))})"
    _avg = "min_value" if _feature in ("glucose", "hemoglobin") else "avg_value"
    LAB_COLUMNS += [f"min(min_value) filter ({_in}) {_feature}_min", f"max(max_value) filter ({_in}) {_feature}_max",
                    f"avg({_avg}) filter ({_in}) {_feature}_avg"]
VIEW_SQL["self_sepsis_20230822"] = f"""
    select c.*, {", ".join(f"g.{b}_min, g.{b}_max, (g.{b}_min + g.{b}_max) / 2 {b}_avg" for b in V.BLOOD_GAS)},
        {", ".join(f"bd.{b}_{t}" for b in V.BLOOD_COUNTS for t in TRIPLE)}, ld.max_value lactate_dehydrogenase_max,
        {", ".join(f"labs.{f}_{t}" for f in V.WIDE_LAB_FEATURES for t in TRIPLE)},
        alp.min_value alp_min, alp.max_value alp_max, alp.avg_value alp_avg, h.height,
        cci.max_value charlson_comorbidity_index_max, uo.max_value urineoutput_max, wa.max_value weight_admit_max,
        {", ".join(f"vt.{t}_{v}" for v in V.VITALS for t in TRIPLE)}, dt.gender,
        pt.min_value pt_min, pt.max_value pt_max, pt.avg_value pt_avg, inr.min_inr inr_min, inr.max_inr inr_max,
        inr.avg_inr inr_avg, dr.death28, ak.max_aki_stage aki_stage_max, ak.sepsis_aki, li.sepsis_li, co.sepsis_co,
        ali.sepsis_ali
    from v_self_collection c
    left join w_first_day_bg_art g using (subject_id, stay_id) left join v_self_blood_differential bd using ({IDS})
    left join v_self_LactateDehydrogenase ld using (subject_id, stay_id)
    left join (select {IDS}, {", ".join(LAB_COLUMNS)} from ({items(sorted({i for ids in V.WIDE_LAB_FEATURES.values()
                                                                         for i in ids}), DAY)}) group by all) labs using ({IDS})
    left join v_self_alp alp using ({IDS}) left join w_height h using (subject_id, stay_id)
    left join v_self_charlson_comorbidity_index cci using ({IDS}) left join v_self_urineoutput uo using ({IDS})
    left join v_self_weight_admit wa using ({IDS}) left join v_self_hr_mbp_resp_temperature vt using ({IDS})
    left join w_icustay_detail dt using ({IDS}) left join v_self_pt pt using ({IDS}) left join v_self_inr inr using ({IDS})
    left join v_self_death_ratio dr using ({IDS}) left join v_self_sepsis_aki ak using ({IDS})
    left join v_self_sepsis_li li using ({IDS}) left join v_self_sepsis_co co using ({IDS})
    left join v_self_sepsis_ali ali using ({IDS})"""
VIEW_SQL["self_icd_code_5x"] = f"""select w.*, d.icd_code, substr(d.icd_code, 1, 3) x_type from v_self_sepsis_20230822 w
    join w_diagnoses_icd d on d.subject_id = w.subject_id and d.hadm_id = w.hadm_id
    where substr(d.icd_code, 1, 3) in ({listed(V.KIDNEY_CODES)})"""
VIEW_SQL["self_sepsis_ali_20230824"] = f"""select w.*, {", ".join(f'f."{site}"' for site in V.SITE_SPECIMENS)}
    from v_self_sepsis_20230822 w join v_self_specimen_count f on f.subject_id = w.subject_id and f.hadm_id = w.hadm_id
    and (f.stay_id is null or f.stay_id = w.stay_id) where w.sepsis and not f.pulmonary"""

CTES = {**duck_ctes(), **{f"v_{name}": sql for name, sql in VIEW_SQL.items()}}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r8(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def study(r: Roles) -> IcuStudy:
    return IcuStudy(DerivedTables(r, WAREHOUSE))


DOUBLE_COLUMNS = {
    **{name: ["min_value", "max_value", "avg_value"] for name in
       [*V.DAY_ITEM_VIEWS, *[f"self_{i}" for i in V.STAY_ITEMS], "self_calcium", "self_calcium_new", "self_alp", "self_gcs",
        "self_urineoutput", "self_weight_admit", "self_icp", "self_crp", "self_pt"]},
    **{name: ["g_min_value", "g_max_value", "g_avg_value"] for name in V.DAY_GROUP_VIEWS},
    "self_charlson_comorbidity_index": ["avg_value"], "self_sofa": ["avg_value"], "self_collection": ["stay_day"],
    "self_blood_differential": [f"{c}_{t}" for c in V.BLOOD_COUNTS for t in TRIPLE],
    "self_LactateDehydrogenase": ["max_value", "min_value"],
    "self_hr_mbp_resp_temperature": [f"{t}_{v}" for v in V.VITALS for t in TRIPLE],
    "self_sapsii": ["sapsii"], "self_inr": ["min_inr", "max_inr", "avg_inr"],
    "self_inr_total": ["min_inr", "max_inr", "avg_inr"], "self_death_ratio": ["los", "cl"],
    "self_sepsis_li": ["max_50885", "max_53089", "max_inr"], "self_ptr_score": ["max_pt_12"],
}
NOT_DOUBLE = {*STAY_KEYS, "age", "outtime", "intime", "sepsis", "charlson_comorbidity_index_max", "gender", "death28",
              "aki_stage_max", "sepsis_aki", "sepsis_li", "sepsis_co", "sepsis_ali"}
for _name in ("self_sepsis_20230822", "self_icd_code_5x", "self_sepsis_ali_20230824"):
    DOUBLE_COLUMNS[_name] = [c for c in WIDE_COLUMNS if c not in NOT_DOUBLE]


def view_sql(name: str) -> str:
    doubles = DOUBLE_COLUMNS.get(name, [])
    replaced = f" replace ({', '.join(f'round({c}, 8) as {c}' for c in doubles)})" if doubles else ""
    return f"select *{replaced} from v_{name}"


def register_view(name: str) -> None:
    key = "view_" + name.removeprefix("self_").lower()
    query(key, view_sql(name), **CTES)(lambda r: rounded(study(r).view(name)))


for _name in IcuStudy.view_names():
    register_view(_name)


@query("view_bedside_item", f"""select {IDS}, itemid, min_value, max_value, round(avg_value, 8) avg_value, 'Heart Rate' t_name
    from (select {KEYS}, l.itemid, {stats()} from w_icustays s join w_chartevents l on {ON["admission"]}
          and s.stay_id = l.stay_id where {DAY} and l.itemid = {CHART_ITEM} group by all)""", **CTES)
def bedside_item(r: Roles) -> DataFrame:
    """The bedside variant of the item aggregate."""
    return rounded(study(r).bedside_stats(CHART_ITEM, "Heart Rate"))


# --- external hospital --------------------------------------------------------------------------------------------

KEY = f'"{V.PATIENT_KEY}"'
LATEST = f"""select p.*, try_cast("{V.ADMITTED}" as timestamp) in_time, try_cast("{V.DISCHARGED}" as timestamp) out_time, """ \
    + " + ".join(f'coalesce(try_cast("{c}" as double), 0)' for c in V.COMORBIDITY_FLAGS) + f""" charlson_comorbidity_index_max
    from w_icu_patient p where "{V.ADMITTED}" = (select max("{V.ADMITTED}") from w_icu_patient q where q.{KEY} = p.{KEY})"""
RATIO = f"""select a."{V.SAMPLE_PATIENT}" pid, a."{V.SAMPLE_TIME}" at_text, try_cast(a."{V.SAMPLE_RESULT}" as double) po2,
    try_cast(b."{V.SAMPLE_RESULT}" as double) fio2,
    try_cast(a."{V.SAMPLE_RESULT}" as double) / nullif(try_cast(b."{V.SAMPLE_RESULT}" as double), 0) ratio
    from w_pao2 a left join w_fio2 b on a."{V.SAMPLE_PATIENT}" = b."{V.SAMPLE_PATIENT}"
    and a."{V.SAMPLE_TIME}" = b."{V.SAMPLE_TIME}" """


def one_analyte(name: str) -> str:
    source = (f"select pid, at_text, ratio res from x_ratio" if name == V.RATIO_ANALYTE else
              f"""select "{V.SAMPLE_PATIENT}" pid, "{V.SAMPLE_TIME}" at_text, try_cast("{V.SAMPLE_RESULT}" as double) res
                  from w_{name}""")
    cap = " and a.at <= t.in_time + interval 24 hour" if name in V.CAPPED_ANALYTES else ""
    return f"""select t.{KEY} pid, max(a.res) {name}_max, min(a.res) {name}_min, round(avg(a.res), 8) {name}_avg
        from x_latest t left join (select *, try_cast(at_text as timestamp) as at from ({source})) a
        on a.pid = t.{KEY} and a.at >= t.in_time and a.at <= t.out_time{cap} group by 1"""


MEASURED = [*V.ANALYTES, V.RATIO_ANALYTE]
ANALYTES_SQL = f"select x_ag.pid {KEY}, " + ", ".join(f"{a}_max, {a}_min, {a}_avg" for a in MEASURED) + " from x_ag " + " ".join(
    f"left join x_{a} on x_{a}.pid = x_ag.pid" for a in MEASURED[1:])
EXTERNAL_CTES = {**duck_ctes(), "x_latest": LATEST, "x_ratio": RATIO, "x_analytes": ANALYTES_SQL,
                 **{f"x_{a}": one_analyte(a) for a in V.ANALYTES}, "x_pao2fio2ratio": one_analyte(V.RATIO_ANALYTE)}


def number(column: str) -> str:
    return f'try_cast("{column}" as double)'


def cleaned(column: str, dash: bool) -> str:
    text = f"""replace("{column}", '{V.UNDETECTED}', '')"""
    text = f"replace({text}, '-', '')" if dash else text
    return f"try_cast(nullif({text}, '') as double)"


def external_sql() -> str:
    out = [f'"{V.NAME_COLUMN}" name, "{V.AGE_COLUMN}" age, t.{KEY} subject_id, in_time, out_time, sepsis']
    for feature, a in V.EXTERNAL_ANALYTE_FEATURES.items():
        scale = " * 18" if feature == "glucose" else ""
        out += [f"round(x.{a}_{t}{scale}, 6) {feature}_{t}" for t in TRIPLE]
    out.append("charlson_comorbidity_index_max")

    def triple(name: str, low: str, high: str, vital: bool) -> list[str]:
        names = [f"{t}_{name}" if vital else f"{name}_{t}" for t in TRIPLE]
        return [f"round({e}, 6) {n}" for e, n in zip((low, high, f"(({low}) + ({high})) / 2"), names)]

    for name, stem in V.EXTERNAL_TEXT_FEATURES.items():
        out += triple(name, number(stem + "_min"), number(stem + "_max"), False)
    out.append(f"{number(V.URINE_COLUMN)} urineoutput_max")
    for name, stem in V.EXTERNAL_VITALS.items():
        out += triple(name, number(stem + V.VITAL_MIN_SUFFIX), number(stem + V.VITAL_MAX_SUFFIX), True)
    low, high = [f"({number(V.EXTERNAL_VITALS['sbp'] + s)} - {number(V.EXTERNAL_VITALS['dbp'] + s)}) / 3 + "
                 f"{number(V.EXTERNAL_VITALS['dbp'] + s)}" for s in (V.VITAL_MIN_SUFFIX, V.VITAL_MAX_SUFFIX)]
    out += triple("mbp", low, high, True)
    out.append(f"""case when "{V.MALE_COLUMN}" = '1' then 'M' else 'F' end gender""")
    for name, stem in V.CLOTTING_TEXT.items():
        out += triple(name, *[cleaned(f"{stem}_{s}", name == "inr") for s in ("min", "max")], False)
    out.append(f"case when {number(V.DEATH_COLUMN)} = 1 then 't' else 'f' end death28")
    out += [f"""case "{f}" when '1' then 't' when '0' then 'f' end {f}""" for f in V.OUTCOME_FLAGS]
    return f"select {', '.join(out)} from x_latest t left join x_analytes x on x.{KEY} = t.{KEY}"


def hospital_tables(r: Roles) -> DerivedTables:
    return DerivedTables(r, HOSPITAL)


@query("external_wide", external_sql(), **EXTERNAL_CTES)
def external_wide(r: Roles) -> DataFrame:
    t = hospital_tables(r)
    wide = hospital.external_wide(t["icu_patient"], {a: t[a] for a in V.ANALYTES})
    keep = {"charlson_comorbidity_index_max", "urineoutput_max"}
    return wide.select(*[F.round(c, 6).alias(c) if k == "double" and c not in keep else F.col(c) for c, k in wide.dtypes])


@query("view_icu_patient", f"""select {KEY} subject_id, in_time, out_time, charlson_comorbidity_index_max from x_latest""",
       **EXTERNAL_CTES)
def view_icu_patient(r: Roles) -> DataFrame:
    patients = hospital.with_comorbidity_index(hospital_tables(r)["icu_patient"])
    return hospital.latest_admissions(patients).select(
        F.col(V.PATIENT_KEY).alias("subject_id"), "in_time", "out_time", "charlson_comorbidity_index_max")


@query("view_icu_pao2fio2ratio", "select pid subject_id, at_text, po2, fio2, round(ratio, 8) pao2fio2ratio from x_ratio",
       **EXTERNAL_CTES)
def view_icu_ratio(r: Roles) -> DataFrame:
    t = hospital_tables(r)
    samples = hospital.tagged_samples({a: t[a] for a in ("pao2", "fio2")})
    return hospital.oxygenation_ratio(samples).select(
        F.col(V.PATIENT_KEY).alias("subject_id"), F.col("sample_time").alias("at_text"), "po2", "fio2",
        r8(V.RATIO_ANALYTE).alias(V.RATIO_ANALYTE))


@query("view_icu_xueqi", f"""select {KEY} subject_id, {", ".join(
    f"round({a}_max, 6) {a}_max, round({a}_min, 6) {a}_min, round({a}_avg, 6) {a}_avg" for a in MEASURED)} from x_analytes""",
       **EXTERNAL_CTES)
def view_icu_analytes(r: Roles) -> DataFrame:
    t = hospital_tables(r)
    admissions = hospital.latest_admissions(hospital.with_comorbidity_index(t["icu_patient"]))
    table = hospital.analyte_table(admissions, hospital.tagged_samples({a: t[a] for a in V.ANALYTES}))
    return table.select(F.col(V.PATIENT_KEY).alias("subject_id"),
                        *[F.round(f"{a}_{s}", 6).alias(f"{a}_{s}") for a in MEASURED for s in ("max", "min", "avg")])
