"""The ICU warehouse and the external hospital, derived from the test tables.

Each table is one SELECT that Spark and DuckDB both understand; ``{name}`` marks a test table or a role.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from stayloom.plans import fixed_values as V
from stayloom.sources.roles import Roles

LAB_ITEMS = sorted({i for ids in V.WIDE_LAB_FEATURES.values() for i in ids} | {i for _, i in V.DAY_ITEM_VIEWS.values()}
                   | {i for _, ids in V.DAY_GROUP_VIEWS.values() for i in ids} | set(V.STAY_ITEMS) | {V.PROTHROMBIN_ITEM})
CODES = [*V.COAGULATION_CODES, *V.KIDNEY_CODES, "J189", "A419"]
SPECIMENS = list(dict.fromkeys(v for names in V.SITE_SPECIMENS.values() for v in names))
CHART_ITEM = 220045


def pick(selector: str, values: list, default: str | None = None) -> str:
    def lit(v) -> str:
        return f"'{v}'" if isinstance(v, str) else str(v)

    arms = " ".join(f"when {i} then {lit(v)}" for i, v in enumerate(values))
    return f"case {selector} {arms}" + (f" else {default}" if default else "") + " end"


def vitals() -> str:
    return ", ".join(
        f"case when stay_id % {i + 5} <> 0 then cast(stay_id % {17 + i} + {offset} as double) end {v}_{s}"
        for i, v in enumerate(V.VITALS) for s, offset in (("min", 30), ("max", 90), ("mean", 60)))


def gases() -> str:
    return ", ".join(
        f"case when stay_id % {i + 4} <> 1 then cast(stay_id % {11 + i} + {offset} as double) end {g}_{s}"
        for i, g in enumerate(("lactate", *V.BLOOD_GAS)) for s, offset in (("min", 1), ("max", 20)))


BASE = "user_id subject_id, user_id hadm_id"
WAREHOUSE = {
    "icustays": "select subject_id, hadm_id, stay_id, intime, outtime from {r_stays}",
    "chartevents": f"""select subject_id, hadm_id, stay_id, case itemid when 'view' then {CHART_ITEM} else 1 end itemid,
        charttime, valuenum from {{r_bedside}}""",
    "labevents": f"""select {BASE}, {pick(f"event_id % {len(LAB_ITEMS)}", LAB_ITEMS)} itemid, ts charttime,
        case when event_id % 2 = 0 then value else value / 25 end valuenum from {{events}} where event_type <> 'signup'""",
    "diagnoses_icd": f"""select o_custkey subject_id, o_custkey hadm_id, {pick("o_orderkey % 97", CODES, "'Z000'")} icd_code
        from {{orders}}""",
    "sepsis3": "select subject_id, stay_id, sepsis3 from {r_sepsis3}",
    "age": "select subject_id, hadm_id, age from {r_age}",
    "charlson": """select subject_id, hadm_id, cast(subject_id % 3 as int) rheumatic_disease,
        cast(subject_id % 2 as int) malignant_cancer, 0 metastatic_solid_tumor, 0 aids, renal_disease, mild_liver_disease,
        severe_liver_disease, chronic_pulmonary_disease, congestive_heart_failure, charlson_comorbidity_index
        from {r_comorb}""",
    "blood_differential": f"select {BASE}, ts charttime, " + ", ".join(
        f"case when event_id % {i + 5} <> 0 then value / {i + 2} end {c}" for i, c in enumerate(V.BLOOD_COUNTS))
    + " from {events} where event_type = 'click'",
    "first_day_bg_art": f"select subject_id, stay_id, {gases()} from {{r_stays}} where stay_id % 9 <> 0",
    "chemistry": f"select {BASE}, ts charttime, value / 50 calcium from {{events}} where event_type = 'view'",
    "enzyme": f"select {BASE}, ts charttime, value alp from {{events}} where event_type = 'purchase'",
    "gcs": """select subject_id, stay_id, charttime, cast(cast(floor(valuenum) as int) % 15 as double) gcs
        from {r_bedside} where itemid = 'view'""",
    "first_day_sofa": "select c_custkey subject_id, c_custkey hadm_id, c_nationkey % 12 sofa from {customer}",
    "first_day_urine_output": "select subject_id, stay_id, cast(stay_id % 3000 as double) urineoutput from {r_stays}",
    "first_day_weight": """select subject_id, stay_id, cast(40 + stay_id % 80 as double) weight_admit from {r_stays}
        where stay_id % 6 <> 0""",
    "first_day_vitalsign": f"select subject_id, stay_id, {vitals()} from {{r_stays}} where stay_id % 10 <> 0",
    "icp": "select subject_id, stay_id, charttime, valuenum / 10 icp from {r_bedside} where itemid = 'error'",
    "inflammation": f"select {BASE}, ts charttime, value crp from {{events}} where event_type = 'error'",
    "sapsii": """select subject_id, hadm_id, stay_id, case when stay_id % 3 = 0 then intime + interval 30 hour
        else intime + interval 2 hour end starttime, cast(stay_id % 70 as double) sapsii from {r_stays}""",
    "coagulation": f"""select {BASE}, ts charttime, value / 20 pt,
        case when event_id % 4 <> 0 then value / 50 end inr from {{events}} where event_type = 'purchase'""",
    "icustay_detail": """select subject_id, hadm_id, stay_id, admittime, dischtime, dod,
        case when subject_id % 2 = 0 then 'F' else 'M' end gender from {r_detail}""",
    "kdigo_stages": "select subject_id, hadm_id, stay_id, aki_stage from {r_stage}",
    "sofa": "select stay_id, cast(floor(valuenum) as int) % 5 sofa_24hours from {r_bedside} where itemid = 'view'",
    "suspicion_of_infection": f"""select o_custkey subject_id, o_custkey hadm_id, stay_id,
        {pick(f"o_orderkey % {len(SPECIMENS) + 1}", SPECIMENS)} specimen, suspected_infection_time
        from {{r_soi_keyed}}""",
    "ventilation": "select stay_id, ventilation_status from {r_vent}",
    "bg": f"select {BASE}, ts charttime, value * 8 pao2fio2ratio from {{events}} where event_type = 'error'",
    "height": "select subject_id, stay_id, cast(140 + stay_id % 60 as double) height from {r_stays} where stay_id % 4 <> 0",
}

PATIENT_STEMS = [*V.EXTERNAL_TEXT_FEATURES.values(), *V.CLOTTING_TEXT.values()]


def patient_columns() -> str:
    key = "subject_id"
    out = []
    for i, stem in enumerate(PATIENT_STEMS):
        gap = f"'{V.UNDETECTED}'" if stem in V.CLOTTING_TEXT.values() else "''"
        out.append(f"case when {key} % {i + 5} = 0 then {gap} else cast({key} % {i + 20} as varchar(20)) end `{stem}_min`")
        out.append(f"cast({key} % {i + 20} + {i + 3} as varchar(20)) `{stem}_max`")
    for i, stem in enumerate(V.EXTERNAL_VITALS.values()):
        out.append(f"cast({key} % {i + 30} + 40 as varchar(20)) `{stem}{V.VITAL_MIN_SUFFIX}`")
        out.append(f"cast({key} % {i + 30} + 90 as varchar(20)) `{stem}{V.VITAL_MAX_SUFFIX}`")
    for i, flag in enumerate(V.COMORBIDITY_FLAGS):
        out.append(f"case {key} % {i + 3} when 0 then '1' when 1 then '0' when 2 then '' end `{flag}`")
    for i, flag in enumerate(V.OUTCOME_FLAGS):
        out.append(f"case stay_id % {i + 3} when 0 then '1' when 1 then '0' end `{flag}`")
    out.append(f"cast({key} * 3 % 2500 as varchar(20)) `{V.URINE_COLUMN}`")
    out.append(f"case when {key} % 2 = 0 then '1' else '0' end `{V.MALE_COLUMN}`")
    out.append(f"case {key} % 3 when 0 then '1' when 1 then '0' end `{V.DEATH_COLUMN}`")
    out.append(f"cast({key} as varchar(20)) `{V.NAME_COLUMN}`")
    out.append(f"cast(20 + {key} % 60 as varchar(20)) `{V.AGE_COLUMN}`")
    out.append("case when stay_id % 2 = 0 then 't' else 'f' end sepsis")
    return ", ".join(out)


HOSPITAL = {
    "icu_patient": f"""select subject_id `{V.PATIENT_KEY}`, substr(cast(intime as varchar(40)), 1, 19) `{V.ADMITTED}`,
        substr(cast(outtime as varchar(40)), 1, 19) `{V.DISCHARGED}`, {patient_columns()} from {{r_stays}}""",
    **{name: f"""select patient_no `{V.SAMPLE_PATIENT}`, substr(sample_time, 1, 13) || ':00:00' `{V.SAMPLE_TIME}`,
        replace(replace(result, '{V.UNDETECTED}', ''), '-', '') `{V.SAMPLE_RESULT}` from {{r_text}}
        where analyte = '{kind}'"""
       for name, kind in zip(V.ANALYTES, ["click", "view", "purchase", "error"] * 3)},
}


class DerivedTables(Mapping):
    """Tables of one of the dictionaries above as DataFrames."""

    def __init__(self, roles: Roles, definitions: Mapping[str, str]):
        self.roles = roles
        self.definitions = definitions
        self._frames: dict[str, DataFrame] = {}

    def _source(self, name: str) -> DataFrame:
        r = self.roles
        if name == "r_soi_keyed":
            return keyed_suspicion(r)
        makers = {"r_stays": r.stays, "r_bedside": r.bedside, "r_age": r.age, "r_sepsis3": r.sepsis3,
                  "r_comorb": r.comorbidity, "r_detail": r.detail, "r_stage": r.stages, "r_vent": r.ventilation,
                  "r_text": r.text_results}
        return makers[name]() if name in makers else r.tables[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def _build(self, name: str) -> DataFrame:
        text = self.definitions[name]
        used = {n: self._source(n) for n in ("r_stays", "r_bedside", "r_age", "r_sepsis3", "r_comorb", "r_detail", "r_stage",
                                             "r_vent", "r_text", "r_soi_keyed", "events", "orders", "customer")
                if "{" + n + "}" in text}
        return self.roles.spark.sql(text, **used)

    def __iter__(self):
        return iter(self.definitions)

    def __len__(self) -> int:
        return len(self.definitions)


def keyed_suspicion(r: Roles) -> DataFrame:
    from pyspark.sql import functions as F

    last = r.stays().groupBy("subject_id").agg(F.max("stay_id").alias("last_stay"))
    orders = r.tables["orders"].select("o_custkey", "o_orderkey")
    hours = F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 720).cast("int"))
    return orders.join(last, F.col("o_custkey") == F.col("subject_id"), "left").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("last_stay")).alias("stay_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + hours).alias("suspected_infection_time"))


KEYED_SQL = """select o.o_custkey, o.o_orderkey, case when o.o_orderkey % 3 = 0 then null else m.stay_id end stay_id,
    timestamp '2024-01-01' + (o.o_orderkey % 720) * interval 1 hour suspected_infection_time
    from orders o left join (select subject_id, max(stay_id) stay_id from r_stays group by 1) m
    on m.subject_id = o.o_custkey"""


def duck_ctes() -> dict[str, str]:
    """The same tables as CTE bodies, prefixed ``w_``."""
    out = {"r_soi_keyed": KEYED_SQL}
    for name, text in {**WAREHOUSE, **HOSPITAL}.items():
        for mark in ("r_stays", "r_bedside", "r_age", "r_sepsis3", "r_comorb", "r_detail", "r_stage", "r_vent", "r_text",
                     "r_soi_keyed", "events", "orders", "customer"):
            text = text.replace("{" + mark + "}", mark)
        out[f"w_{name}"] = text.replace("`", '"')
    return out
