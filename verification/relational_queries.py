"""Sources, projections, filters, joins, aggregates, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.functions import scalar as S
from stayloom.operators import cohort as C
from stayloom.operators import prepare as P
from stayloom.operators.clean import latest_per_key, paired_ratio
from stayloom.operators.events import ADMISSION_KEYS, STAY_KEYS
from stayloom.operators.select import feature_vote, label_correlations
from stayloom.session import stage_path
from stayloom.sources.roles import Roles
from stayloom.sources.tables import StageStore, read_sheet, refresh_table, write_sheet
from stayloom.sources.versions import VersionedTables
from verification.registry import query, r8, r8_all

CLICK = "itemid = 'click'"


# --- sources and sinks ------------------------------------------------------------------------------------------

@query("scan_count", """
    select 'stays' tbl, count(*) n from r_stays union all select 'labs', count(*) from r_labs
    union all select 'age', count(*) from r_age union all select 'diagnoses', count(*) from r_dx""")
def scan_count(r: Roles) -> DataFrame:
    parts = {"stays": r.stays(), "labs": r.labs(), "age": r.age(), "diagnoses": r.diagnoses()}
    frames = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("csv_roundtrip", "select id, f1, f3, f5, label, dose from r_features")
def csv_roundtrip(r: Roles) -> DataFrame:
    df = r.features().select("id", "f1", "f3", "f5", "label", "dose")
    path = stage_path(r.spark, "sheet")
    write_sheet(df, path)
    return read_sheet(r.spark, path, df.schema)


@query("stage_roundtrip", "select subject_id, hadm_id, stay_id, intime, outtime from r_stays")
def stage_roundtrip(r: Roles) -> DataFrame:
    store = StageStore(r.spark, stage_path(r.spark, "stages"), "sepsis_ali")
    store.write(r.stays(), "clean_data")
    return store.read("clean_data")


@query("materialize_refresh", """
    select subject_id, hadm_id, stay_id, date_diff('microsecond', intime, outtime) / 3.6e9 stay_hours from r_stays""")
def materialize_refresh(r: Roles) -> DataFrame:
    """The second refresh reads the table it replaces."""
    first = refresh_table(r.stays(), "stayloom_stays")
    longer = first.select(*STAY_KEYS, S.hours_between(F.col("intime"), F.col("outtime")).alias("stay_hours"))
    return refresh_table(longer, "stayloom_stays")


@query("update_column", """
    select subject_id, hadm_id, renal_disease, mild_liver_disease, severe_liver_disease, chronic_pulmonary_disease,
           congestive_heart_failure,
           cast(renal_disease + mild_liver_disease + severe_liver_disease as double) charlson_comorbidity_index
    from r_comorb""")
def update_column_query(r: Roles) -> DataFrame:
    """The update writes a new version of the table, which is read back."""
    store = VersionedTables(r.spark, stage_path(r.spark, "tables"))
    store.write({"comorbidity": r.comorbidity()})
    flags = ["renal_disease", "mild_liver_disease", "severe_liver_disease"]
    return store.update("comorbidity", "charlson_comorbidity_index", S.sum_flags(flags))


# --- projections ------------------------------------------------------------------------------------------------

@query("project_alias", "select subject_id patient, charttime measured_at, valuenum result from r_labs")
def project_alias(r: Roles) -> DataFrame:
    return r.labs().select(F.col("subject_id").alias("patient"), F.col("charttime").alias("measured_at"),
                           F.col("valuenum").alias("result"))


@query("project_star", "select a.*, a.age * 2 double_age from r_age a")
def project_star(r: Roles) -> DataFrame:
    return r.age().select("*", (F.col("age") * 2).alias("double_age"))


@query("literal_tag", "select subject_id, itemid, valuenum, 'labs' e_type from r_labs")
def literal_tag(r: Roles) -> DataFrame:
    return r.labs().select("subject_id", "itemid", "valuenum", F.lit("labs").alias("e_type"))


@query("select_list", "select id, f1, f2, label from r_features")
def select_list(r: Roles) -> DataFrame:
    return r.features().select(*["id", "f1", "f2", "label"])


@query("select_range", "select id, f2, f3, f5 from r_features")
def select_range(r: Roles) -> DataFrame:
    df = r.features()
    return df.select("id", *P.column_range(df.columns, "f2", "f5", allowed={"f1", "f2", "f3", "f5"}))


@query("drop_columns", "select id, f1, f2, f3, f4, f5, label from r_features")
def drop_columns(r: Roles) -> DataFrame:
    return r.features().drop("dose", "stay_day")


@query("add_missing_columns", "select subject_id, hadm_id, age, '' \"name\", '' note from r_age")
def add_missing(r: Roles) -> DataFrame:
    return P.add_missing_columns(r.age(), ["subject_id", "age", "name", "note"])


@query("row_key", """select *, row_number() over (order by subject_id nulls first, charttime nulls first, itemid nulls first,
    hadm_id nulls first, valuenum nulls first) - 1 row_id from r_labs""")
def row_key(r: Roles) -> DataFrame:
    """Lab events have no key of their own: number them from 0."""
    return P.number_rows(r.labs(), ["subject_id", "charttime", "itemid", "hadm_id", "valuenum"], "row_id")


# --- filters ----------------------------------------------------------------------------------------------------

@query("filter_range", "select subject_id, hadm_id, age from r_age where age >= 18 and age < 89")
def filter_range(r: Roles) -> DataFrame:
    return r.age().filter((F.col("age") >= 18) & (F.col("age") < 89))


@query("filter_duration", """select subject_id, hadm_id, stay_id, intime, outtime from r_stays
    where date_diff('microsecond', intime, outtime) / 3.6e9 > 48""")
def filter_duration(r: Roles) -> DataFrame:
    return r.stays().filter(S.hours_between(F.col("intime"), F.col("outtime")) > 48)


@query("filter_equality", """select subject_id, hadm_id, renal_disease, charlson_comorbidity_index from r_comorb
    where renal_disease = 0 and charlson_comorbidity_index <> 3""")
def filter_equality(r: Roles) -> DataFrame:
    return r.comorbidity().filter((F.col("renal_disease") == 0) & (F.col("charlson_comorbidity_index") != 3)).select(
        *ADMISSION_KEYS, "renal_disease", "charlson_comorbidity_index")


@query("filter_null", "select id, f1, f2, dose from r_features where f1 is not null and dose is null")
def filter_null(r: Roles) -> DataFrame:
    return r.features().filter(F.col("f1").isNotNull() & F.col("dose").isNull()).select("id", "f1", "f2", "dose")


@query("filter_in_list", """select subject_id, hadm_id, icd_code from r_dx
    where substr(icd_code, 1, 3) in ('1-U', '3-M') or icd_code in ('5-LOW')""")
def filter_in_list(r: Roles) -> DataFrame:
    code = F.col("icd_code")
    return r.diagnoses().filter(S.prefix(code).isin("1-U", "3-M") | code.isin("5-LOW"))


@query("filter_boolean_3vl", """
    select 'true' kind, count(*) n from f where flag is true union all select 'bare', count(*) from f where flag
    union all select 'not', count(*) from f where not flag""",
       f="select s.stay_id, p.sepsis3 flag from r_stays s left join r_sepsis3 p using (subject_id, stay_id)")
def filter_boolean_3vl(r: Roles) -> DataFrame:
    """A NULL flag fails the filter and its negation; all three counts come from one scan."""
    flag = F.col("sepsis3")
    joined = r.stays().join(r.sepsis3(), ["subject_id", "stay_id"], "left")
    one = joined.agg(F.count_if(flag.eqNullSafe(True)).alias("true"), F.count_if(flag).alias("bare"),
                     F.count_if(~flag).alias("not"))
    return one.unpivot([], ["true", "bare", "not"], "kind", "n")


@query("filter_or_optional", """
    select s.subject_id, s.stay_id, v.ventilation_status, p.sepsis3 from r_stays s
    left join (select * from r_vent where ventilation_status <> 'None') v using (stay_id)
    left join r_sepsis3 p using (subject_id, stay_id)
    where v.ventilation_status is not null or p.sepsis3 is not null""")
def filter_or_optional(r: Roles) -> DataFrame:
    vent = r.ventilation().filter(F.col("ventilation_status") != "None")
    return (r.stays().select("subject_id", "stay_id").join(vent, "stay_id", "left")
            .join(r.sepsis3(), ["subject_id", "stay_id"], "left")
            .filter(F.col("ventilation_status").isNotNull() | F.col("sepsis3").isNotNull()))


@query("filter_null_or_gt", """select id, dose / stay_day per_day from r_features
    where dose / stay_day is null or dose / stay_day > 1""")
def filter_null_or_gt(r: Roles) -> DataFrame:
    per_day = F.col("per_day")
    return r.features().select("id", S.rate(F.col("dose"), F.col("stay_day")).alias("per_day")).filter(
        per_day.isNull() | (per_day > 1))


@query("row_completeness", """select id, f1, f2, f3, f4, f5 from r_features
    where ((f1 is not null)::int + (f2 is not null)::int + (f3 is not null)::int + (f4 is not null)::int
           + (f5 is not null)::int) / 5.0 >= 0.8""")
def row_completeness(r: Roles) -> DataFrame:
    columns = ["f1", "f2", "f3", "f4", "f5"]
    return P.filter_complete_rows(r.features(), columns, 0.8).select("id", *columns)


@query("cohort_target_filter", """
    select 'sepsis' target, count(*) n, sum(id)::bigint ids from t where sepsis is not null
    union all select 'death28', count(*), sum(id)::bigint from t
        where sepsis = 1 and sepsis_ali = 1 and death28 is not null
    union all select 'sepsis_ali', count(*), sum(id)::bigint from t where sepsis = 1 and sepsis_ali is not null""",
       t="""select id, case when id % 5 <> 0 then (id % 2)::int end sepsis,
            case when id % 3 <> 0 then label end sepsis_ali, case when f1 is not null then (f1 > 25)::int end death28
            from r_features""")
def cohort_target_filter(r: Roles) -> DataFrame:
    key = F.col("id")
    df = r.features().select(
        "id", F.when(key % 5 != 0, (key % 2).cast("int")).alias("sepsis"),
        F.when(key % 3 != 0, F.col("label")).alias("sepsis_ali"), (F.col("f1") > 25).cast("int").alias("death28"))
    parts = [P.filter_target_cohort(df, t).agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(
        F.lit(t).alias("target"), "n", "ids") for t in ("sepsis", "death28", "sepsis_ali")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- joins ------------------------------------------------------------------------------------------------------

@query("left_join_multikey", """
    select s.subject_id, s.hadm_id, s.stay_id, a.age, p.sepsis3, d.dod
    from r_stays s left join r_age a using (subject_id, hadm_id) left join r_sepsis3 p using (subject_id, stay_id)
    left join r_detail d using (subject_id, hadm_id, stay_id)""")
def left_join_multikey(r: Roles) -> DataFrame:
    return (r.stays().select(*STAY_KEYS).join(r.age(), list(ADMISSION_KEYS), "left")
            .join(r.sepsis3(), ["subject_id", "stay_id"], "left")
            .join(r.detail().select(*STAY_KEYS, "dod"), list(STAY_KEYS), "left"))


@query("dedup_latest_join", """
    select s.* from r_stays s join (select subject_id, max(intime) latest from r_stays group by 1) m
    on m.subject_id = s.subject_id and m.latest = s.intime""")
def dedup_latest(r: Roles) -> DataFrame:
    return latest_per_key(r.stays(), ["subject_id"], "intime")


@query("left_join_effective_inner", """
    select s.subject_id, s.hadm_id, s.stay_id, k.renal_disease from r_stays s
    left join r_comorb k on s.subject_id = k.subject_id and s.hadm_id = k.hadm_id where k.renal_disease = 0""")
def left_join_effective_inner(r: Roles) -> DataFrame:
    """A null-rejecting filter on the optional side makes the join inner; the filter runs before it."""
    healthy = r.comorbidity().filter(F.col("renal_disease") == 0).select(*ADMISSION_KEYS, "renal_disease")
    return r.stays().select(*STAY_KEYS).join(healthy, list(ADMISSION_KEYS))


@query("join_sentinel_or", """
    select s.subject_id, s.hadm_id, s.stay_id, c.stay_id evidence_stay from r_stays s
    left join ev c on (c.stay_id = s.stay_id or c.stay_id = 0) and c.hadm_id = s.hadm_id
    and c.subject_id = s.subject_id""",
       ev="""select subject_id, hadm_id, case when subject_id % 4 = 0 then 0 else max(coalesce(stay_id, 0)) end stay_id
             from r_soi group by subject_id, hadm_id""")
def join_sentinel_or(r: Roles) -> DataFrame:
    """The evidence has one row per admission, so the sentinel is a condition on one matched row, not on pairs."""
    latest = F.max(F.coalesce("stay_id", F.lit(0)))
    evidence = r.suspicion().groupBy(*ADMISSION_KEYS).agg(latest.alias("top")).select(
        *ADMISSION_KEYS, F.when(F.col("subject_id") % 4 == 0, F.lit(0)).otherwise(F.col("top")).alias("evidence"))
    covers = (F.col("evidence") == F.col("stay_id")) | (F.col("evidence") == 0)
    return r.stays().select(*STAY_KEYS).join(evidence, list(ADMISSION_KEYS), "left").select(
        *STAY_KEYS, F.when(covers, F.col("evidence")).cast("bigint").alias("evidence_stay"))


@query("join_null_wildcard", """
    select s.subject_id, s.hadm_id, s.stay_id, k.n from r_stays s
    join soi k on s.subject_id = k.subject_id and s.hadm_id = k.hadm_id
    and (s.stay_id = k.stay_id or k.stay_id is null)""",
       soi="select subject_id, hadm_id, stay_id, count(*) n from r_soi group by all")
def join_null_wildcard(r: Roles) -> DataFrame:
    counts = r.suspicion().groupBy(*STAY_KEYS).agg(F.count("*").alias("n"))
    return C.left_join_wildcard_key(r.stays().select(*STAY_KEYS), counts, ADMISSION_KEYS, "stay_id")


@query("semi_join_tuple", """
    select subject_id, hadm_id, stay_id from r_stays where (subject_id, hadm_id, stay_id) in
    (select subject_id, hadm_id, stay_id from r_soi where specimen in ('1-URGENT/F', '2-HIGH/O'))""")
def semi_join_tuple(r: Roles) -> DataFrame:
    wanted = r.suspicion().filter(F.col("specimen").isin("1-URGENT/F", "2-HIGH/O"))
    return r.stays().select(*STAY_KEYS).join(wanted, list(STAY_KEYS), "left_semi")


@query("paired_measure_ratio", """
    select a.patient_no, a.at_hour, a.res first_value, b.res second_value, a.res / nullif(b.res, 0) ratio
    from (select * from t where analyte = 'click') a left join (select * from t where analyte = 'view') b
    on a.patient_no = b.patient_no and a.at_hour = b.at_hour""",
       t="""select patient_no, substr(sample_time, 1, 13) at_hour, analyte,
            try_cast(nullif(replace(replace(result, '测不出', ''), '-', ''), '') as double) res from r_text""")
def paired_measure_ratio(r: Roles) -> DataFrame:
    samples = r.text_results().select(
        "patient_no", F.substring("sample_time", 1, 13).alias("at_hour"), "analyte",
        S.clean_numeric(F.col("result"), ("测不出", "-")).alias("res"))
    return paired_ratio(samples.filter("analyte = 'click'"), samples.filter("analyte = 'view'"),
                        keys=("patient_no", "at_hour"), value="res").select(
        "patient_no", "at_hour", F.col("first").alias("first_value"), F.col("second").alias("second_value"), "ratio")


# --- aggregates -------------------------------------------------------------------------------------------------

@query("count_all", "select count(*) n from r_labs")
def count_all(r: Roles) -> DataFrame:
    return r.labs().agg(F.count("*").alias("n"))


@query("count_distinct", "select count(distinct subject_id) n from r_stays")
def count_distinct(r: Roles) -> DataFrame:
    return r.stays().agg(F.countDistinct("subject_id").alias("n"))


@query("group_min_max_avg", """select subject_id, hadm_id, itemid, min(valuenum) min_value, max(valuenum) max_value,
    round(avg(valuenum), 8) avg_value from r_labs group by all""")
def group_min_max_avg(r: Roles) -> DataFrame:
    return r.labs().groupBy(*ADMISSION_KEYS, "itemid").agg(
        F.min("valuenum").alias("min_value"), F.max("valuenum").alias("max_value"),
        r8(F.avg("valuenum")).alias("avg_value"))


@query("group_count", "select substr(icd_code, 1, 3) x_type, count(*) n from r_dx group by 1")
def group_count(r: Roles) -> DataFrame:
    return r.diagnoses().groupBy(S.prefix(F.col("icd_code")).alias("x_type")).agg(F.count("*").alias("n"))


@query("agg_threshold_flag", """select subject_id, hadm_id, stay_id, max(aki_stage) max_aki_stage,
    min(aki_stage) min_aki_stage, max(aki_stage) >= 2 sepsis_aki from r_stage group by all""")
def agg_threshold_flag(r: Roles) -> DataFrame:
    stage = F.col("aki_stage")
    return r.stages().groupBy(*STAY_KEYS).agg(
        F.max(stage).alias("max_aki_stage"), F.min(stage).alias("min_aki_stage"),
        (F.max(stage) >= 2).alias("sepsis_aki"))


@query("any_match_flag", """select subject_id, hadm_id, max(case when icd_code like '%URGENT%' then 1 else 0 end) hit
    from r_dx group by all""")
def any_match_flag(r: Roles) -> DataFrame:
    return r.diagnoses().groupBy(*ADMISSION_KEYS).agg(
        F.max(F.when(F.col("icd_code").contains("URGENT"), 1).otherwise(0)).alias("hit"))


@query("distinct_keys", "select subject_id, stay_id, hadm_id from r_soi group by all")
def distinct_keys(r: Roles) -> DataFrame:
    return r.suspicion().select("subject_id", "stay_id", "hadm_id").distinct()


@query("sentinel_max", "select subject_id, hadm_id, max(coalesce(stay_id, 0)) stay_id from r_soi group by all")
def sentinel_max(r: Roles) -> DataFrame:
    return r.suspicion().groupBy(*ADMISSION_KEYS).agg(F.max(F.coalesce("stay_id", F.lit(0))).alias("stay_id"))


@query("feature_label_corr", "select feature, round(c, 8) corr from (" + " union all ".join(
    f"select '{c}' feature, corr({c}, label) c from r_features" for c in ("f1", "f2", "f3", "f4", "f5")) + ")")
def feature_label_corr(r: Roles) -> DataFrame:
    return r8_all(label_correlations(r.features(), ["f1", "f2", "f3", "f4", "f5"], "label"), "corr")


VOTES = """select o_orderpriority || '-' || o_orderstatus feature, (o_orderkey % 10)::int run,
    o_custkey::int pos from orders"""


@query("feature_vote", """
    select feature, count(*) votes, min(run * 100000::bigint + pos) first_seen from v group by feature
    order by votes desc, first_seen limit 10""", v=VOTES)
def feature_vote_query(r: Roles) -> DataFrame:
    picks = r.tables["orders"].select(
        F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("feature"),
        (F.col("o_orderkey") % 10).alias("run"), F.col("o_custkey").alias("pos"))
    return feature_vote(picks, top=10, seen=F.col("run") * 100000 + F.col("pos"))


# --- sort, top-n, sets ------------------------------------------------------------------------------------------

@query("sort_abs_desc", """select subject_id, hadm_id, itemid, drift from (select subject_id, hadm_id, itemid,
    round(avg(valuenum) - 50, 8) drift from r_labs group by all) order by abs(drift) desc, itemid""")
def sort_abs_desc(r: Roles) -> DataFrame:
    drift = r.labs().groupBy(*ADMISSION_KEYS, "itemid").agg(r8(F.avg("valuenum") - 50).alias("drift"))
    return drift.orderBy(F.abs("drift").desc(), "itemid")


@query("top_features", """select feature, round(c, 8) corr from (""" + " union all ".join(
    f"select '{c}' feature, corr({c}, label) c from r_features" for c in ("f1", "f2", "f3", "f4", "f5")) + """)
    order by abs(c) desc, feature limit 3""")
def top_features(r: Roles) -> DataFrame:
    corr = label_correlations(r.features(), ["f1", "f2", "f3", "f4", "f5"], "label")
    return r8_all(corr.orderBy(F.abs("corr").desc(), "feature").limit(3), "corr")


@query("union_distinct", """select subject_id, hadm_id, itemid from r_labs where itemid in ('click', 'view')
    union select subject_id, hadm_id, itemid from r_labs where itemid in ('view', 'error')""")
def union_distinct(r: Roles) -> DataFrame:
    labs = r.labs().select(*ADMISSION_KEYS, "itemid")
    return labs.filter(F.col("itemid").isin("click", "view")).unionByName(
        labs.filter(F.col("itemid").isin("view", "error"))).distinct()


@query("union_flagged", """select id, f1, f5, 1 model from r_features where id % 5 <> 0
    union all select id, f1, f5, 0 from r_features where id % 5 = 0""")
def union_flagged(r: Roles) -> DataFrame:
    df = r.features().select("id", "f1", "f5")
    return P.concat_flagged(df.filter("id % 5 <> 0"), df.filter("id % 5 = 0"))


# --- scalar functions -------------------------------------------------------------------------------------------

@query("sc_coalesce", """select s.subject_id, s.stay_id, coalesce(p.sepsis3, false) sepsis
    from r_stays s left join r_sepsis3 p using (subject_id, stay_id)""")
def sc_coalesce(r: Roles) -> DataFrame:
    return r.stays().join(r.sepsis3(), ["subject_id", "stay_id"], "left").select(
        "subject_id", "stay_id", S.or_false(F.col("sepsis3")).alias("sepsis"))


@query("sc_case", """select subject_id, itemid, valuenum, case when valuenum < 20 then 2 when valuenum < 60 then 1
    else 0 end with_else, case when valuenum > 100 then 'high' when valuenum > 50 then 'mid' end without_else
    from r_labs""")
def sc_case(r: Roles) -> DataFrame:
    v = F.col("valuenum")
    return r.labs().select("subject_id", "itemid", "valuenum",
                           F.when(v < 20, 2).when(v < 60, 1).otherwise(0).alias("with_else"),
                           F.when(v > 100, "high").when(v > 50, "mid").alias("without_else"))


@query("sc_case_simple", """select subject_id, hadm_id, icd_code, case coalesce(substr(icd_code, 1, 3)
    in ('1-U', '2-H'), false) when true then 1 else 0 end hit from r_dx""")
def sc_case_simple(r: Roles) -> DataFrame:
    hit = S.or_false(S.prefix(F.col("icd_code")).isin("1-U", "2-H"))
    return r.diagnoses().withColumn("hit", F.when(hit, 1).otherwise(0))


@query("recode_flags", """select subject_id, hadm_id, case g when 'F' then 1 when 'M' then 0 end gender,
    case d when 't' then 1 when 'f' then 0 end death28 from t""",
       t="""select subject_id, hadm_id, case age % 3 when 0 then 'F' when 1 then 'M' else 'X' end g,
            case when age % 4 = 0 then 't' when age % 4 = 1 then 'f' end d from r_age""")
def recode_flags(r: Roles) -> DataFrame:
    """The mapping is an argument because the two study parts code gender the opposite way; absent columns are skipped."""
    age = F.col("age")
    df = r.age().select(*ADMISSION_KEYS,
                        F.when(age % 3 == 0, "F").when(age % 3 == 1, "M").otherwise("X").alias("gender"),
                        F.when(age % 4 == 0, "t").when(age % 4 == 1, "f").alias("death28"))
    return S.recode(df, {"gender": {"F": 1, "M": 0}, "death28": {"t": 1, "f": 0}, "sepsis": {"t": 1, "f": 0}})


@query("sc_try_cast", "select patient_no, analyte, result, try_cast(result as double) res from r_text")
def sc_try_cast(r: Roles) -> DataFrame:
    return r.text_results().select("patient_no", "analyte", "result", S.as_double(F.col("result")).alias("res"))


@query("sc_duration", """select stay_id, round(date_diff('microsecond', intime, outtime) / 3.6e9, 8) stay_hours,
    round(date_diff('microsecond', intime, outtime) / 3.6e9 / 24, 8) stay_days from r_stays""")
def sc_duration(r: Roles) -> DataFrame:
    start, end = F.col("intime"), F.col("outtime")
    return r.stays().select("stay_id", r8(S.hours_between(start, end)).alias("stay_hours"),
                            r8(S.days_between(start, end)).alias("stay_days"))


@query("sc_interval_shift", """select stay_id, intime - interval 6 hour window_start, intime + interval 24 hour
    window_end from r_stays""")
def sc_interval_shift(r: Roles) -> DataFrame:
    return r.stays().select("stay_id", (F.col("intime") - S.hours(6)).alias("window_start"),
                            (F.col("intime") + S.hours(24)).alias("window_end"))


@query("sc_parse_ts", """select patient_no, analyte, sample_time, strptime(sample_time, '%Y-%m-%d %H:%M:%S') sampled_at
    from r_text""")
def sc_parse_ts(r: Roles) -> DataFrame:
    return r.text_results().select("patient_no", "analyte", "sample_time",
                                   S.parse_timestamp(F.col("sample_time")).alias("sampled_at"))


@query("sc_substr", "select subject_id, icd_code, substr(icd_code, 1, 3) x_type from r_dx")
def sc_substr(r: Roles) -> DataFrame:
    return r.diagnoses().select("subject_id", "icd_code", S.prefix(F.col("icd_code")).alias("x_type"))


@query("sc_clean_numeric", """select patient_no, analyte, result,
    case when replace(replace(result, '测不出', ''), '-', '') = '' then null
    else cast(replace(replace(result, '测不出', ''), '-', '') as double) end res from r_text""")
def sc_clean_numeric(r: Roles) -> DataFrame:
    return r.text_results().select("patient_no", "analyte", "result",
                                   S.clean_numeric(F.col("result"), ("测不出", "-")).alias("res"))


@query("sc_midpoint", """select subject_id, itemid, (min(valuenum) + max(valuenum)) / 2 mid, max(valuenum) * 18 scaled,
    round(max(valuenum) / 12, 8) ratio from r_labs group by all""")
def sc_midpoint(r: Roles) -> DataFrame:
    low, high = F.min("valuenum"), F.max("valuenum")
    return r.labs().groupBy("subject_id", "itemid").agg(
        S.midpoint(low, high).alias("mid"), (high * 18).alias("scaled"), r8(high / 12).alias("ratio"))


@query("sc_map_pressure", """select id, round((f5 - f2) / 3 + f2, 8) mbp from r_features""")
def sc_map_pressure(r: Roles) -> DataFrame:
    return r.features().select("id", r8(S.mean_arterial_pressure(F.col("f5"), F.col("f2"))).alias("mbp"))


@query("sc_3vl", """select id, f1 > 25 gt, f1 > 25 or f3 > 0.05 any_gt, f1 > 25 and f3 > 0.05 both_gt,
    coalesce((f1 > 25 or f3 > 0.05) and f4 > 0.03, false) decided from r_features""")
def sc_3vl(r: Roles) -> DataFrame:
    a, b, c = F.col("f1") > 25, F.col("f3") > 0.05, F.col("f4") > 0.03
    return r.features().select("id", a.alias("gt"), (a | b).alias("any_gt"), (a & b).alias("both_gt"),
                               S.or_false((a | b) & c).alias("decided"))


@query("sc_is_not_null", """select id, case when f2 is not null then f1 is not null end known from r_features""")
def sc_is_not_null(r: Roles) -> DataFrame:
    return r.features().select("id", F.when(F.col("f2").isNotNull(), F.col("f1").isNotNull()).alias("known"))


@query("sc_greatest", """select id, case when coalesce(f3, 0) > coalesce(f4, 0) then coalesce(f3, 0)
    else coalesce(f4, 0) end larger from r_features""")
def sc_greatest(r: Roles) -> DataFrame:
    return r.features().select("id", S.larger_of(F.col("f3"), F.col("f4")).alias("larger"))


@query("sc_presence", "select id, dose is not null treated from r_features")
def sc_presence(r: Roles) -> DataFrame:
    return r.features().select("id", S.presence(F.col("dose")).alias("treated"))


@query("sc_rate", "select id, dose / nullif(stay_day - 2, 0) per_day from r_features")
def sc_rate(r: Roles) -> DataFrame:
    return r.features().select("id", S.rate(F.col("dose"), F.col("stay_day") - 2).alias("per_day"))


@query("sc_round_even", "select id, round_even(dose / 2, 0) label from r_features where dose is not null")
def sc_round_even(r: Roles) -> DataFrame:
    return r.features().filter(F.col("dose").isNotNull()).select(
        "id", S.round_half_even(F.col("dose") / 2).alias("label"))


@query("sc_fill_missing", """select id, coalesce(f1, round(f5 / 10000, 8)) f1, coalesce(f3, 0.05) f3
    from r_features""")
def sc_fill_missing(r: Roles) -> DataFrame:
    """Only missing cells change: the computed frame is joined on the row key and coalesced behind the original."""
    from stayloom.operators.clean import fill_missing

    df = r.features()
    computed = df.select("id", r8(F.col("f5") / 10000).alias("f1"), F.lit(0.05).alias("f3"))
    return fill_missing(df.select("id", "f1", "f3"), computed, key="id", columns=["f1", "f3"])


@query("one_hot_decode", """select id, target[1] first_out, target[2] second_out,
    case when (p1 - 1) * (p1 - 1) + p2 * p2 > p1 * p1 + (p2 - 1) * (p2 - 1) then 0 else 1 end decoded from t""",
       t="""select id, case when label >= 0.5 then [1.0::double, 0.0::double] else [0.0::double, 1.0::double] end target,
            coalesce(f1, 25.0) / 50 p1, coalesce(f3, 0.05) * 10 p2 from r_features""")
def one_hot_decode(r: Roles) -> DataFrame:
    p1, p2 = F.coalesce("f1", F.lit(25.0)) / 50, F.coalesce("f3", F.lit(0.05)) * 10
    target = S.one_hot(F.col("label"))
    return r.features().select("id", target[0].alias("first_out"), target[1].alias("second_out"),
                               S.nearer_corner(p1, p2).alias("decoded"))
