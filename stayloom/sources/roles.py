"""Clinical roles played by the test tables.

Each role is a derived relation with the columns of a clinical table (stays, lab events, diagnoses, ...), so that every
operator can run on tables that are not clinical. ``verification.role_sql`` holds the same relations as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayloom.functions.scalar import hours
from stayloom.sources.tables import TableRegistry

# Declared schemas of the test tables.
TEST_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


class Roles:
    """Lazily built role relations over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.tables = TableRegistry.from_folder(spark, folder, TEST_SCHEMAS)

    def stays(self) -> DataFrame:
        user, event = F.col("user_id"), F.col("event_id")
        return self.tables["events"].filter(F.col("event_type") == "signup").select(
            user.alias("subject_id"), user.alias("hadm_id"), event.alias("stay_id"), F.col("ts").alias("intime"),
            (F.col("ts") + hours(12 + event % 120)).alias("outtime"))

    def labs(self) -> DataFrame:
        user = F.col("user_id")
        return self.tables["events"].filter(F.col("event_type") != "signup").select(
            user.alias("subject_id"), user.alias("hadm_id"), F.col("event_type").alias("itemid"),
            F.col("ts").alias("charttime"), F.col("value").alias("valuenum"))

    def bedside(self) -> DataFrame:
        from stayloom.operators.events import interval_join

        return interval_join(self.stays(), self.labs(), keys=("subject_id", "hadm_id"),
                             window=(F.col("intime"), F.col("outtime"))).select(
            "subject_id", "hadm_id", "stay_id", "itemid", "charttime", "valuenum")

    def age(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.tables["customer"].select(
            key.alias("subject_id"), key.alias("hadm_id"), (13 + key % 85).alias("age"))

    def sepsis3(self) -> DataFrame:
        return self.stays().filter(F.col("stay_id") % 2 == 0).select(
            "subject_id", "stay_id", (F.col("stay_id") % 3 == 0).alias("sepsis3"))

    def comorbidity(self) -> DataFrame:
        key, nation = F.col("c_custkey"), F.col("c_nationkey")

        def every(n: int, name: str):
            return (nation % n == 0).cast("int").alias(name)

        return self.tables["customer"].select(
            key.alias("subject_id"), key.alias("hadm_id"), every(2, "renal_disease"), every(3, "mild_liver_disease"),
            every(7, "severe_liver_disease"), every(4, "chronic_pulmonary_disease"),
            every(5, "congestive_heart_failure"), (nation % 10).alias("charlson_comorbidity_index"))

    def diagnoses(self) -> DataFrame:
        key = F.col("o_custkey")
        return self.tables["orders"].select(
            key.alias("subject_id"), key.alias("hadm_id"), F.col("o_orderpriority").alias("icd_code"))

    def suspicion(self) -> DataFrame:
        last = self.stays().groupBy("subject_id").agg(F.max("stay_id").alias("last_stay"))
        key, order = F.col("o_custkey"), F.col("o_orderkey")
        infections = self.tables["orders"].select(
            key.alias("subject_id"), key.alias("hadm_id"), order.alias("order"),
            F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("specimen"),
            (F.lit("2024-01-01").cast("timestamp_ntz") + hours(order % 720)).alias("suspected_infection_time"))
        return infections.join(last, "subject_id", "left").select(
            "subject_id", "hadm_id", F.when(F.col("order") % 3 != 0, F.col("last_stay")).alias("stay_id"), "specimen",
            "suspected_infection_time")

    def detail(self) -> DataFrame:
        stay = F.col("stay_id")
        return self.stays().select(
            "subject_id", "hadm_id", "stay_id", F.col("intime").alias("admittime"), F.col("outtime").alias("dischtime"),
            F.when(stay % 4 == 0, F.col("intime") + hours((stay % 60) * 24)).alias("dod"))

    def stages(self) -> DataFrame:
        return self.bedside().filter(F.col("itemid") == "click").select(
            "subject_id", "hadm_id", "stay_id", (F.floor("valuenum").cast("int") % 4).alias("aki_stage"))

    def ventilation(self) -> DataFrame:
        kind = F.col("stay_id") % 4
        return self.stays().select(
            "stay_id", F.when(kind == 0, "InvasiveVent").when(kind == 1, "HFNC").otherwise("None").alias(
                "ventilation_status"))

    def text_results(self) -> DataFrame:
        event, value = F.col("event_id"), F.col("value").cast("decimal(12,2)").cast("string")
        return self.tables["events"].filter(F.col("event_type") != "signup").select(
            F.col("user_id").alias("patient_no"),
            F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd HH:mm:ss").alias("sample_time"),
            F.col("event_type").alias("analyte"),
            F.when(event % 11 == 0, "测不出").when(event % 13 == 0, "").when(event % 17 == 0, F.concat(F.lit("-"), value))
            .otherwise(value).alias("result"))

    def features(self) -> DataFrame:
        """Feature matrix with NULLs; means are rounded so that summation order cannot show."""
        lines = self.tables["lineitem"].groupBy("l_orderkey").agg(
            F.round(F.avg("l_quantity"), 6).alias("q"), F.round(F.avg("l_extendedprice"), 6).alias("p"),
            F.round(F.avg("l_discount"), 6).alias("d"), F.round(F.avg("l_tax"), 6).alias("t"))
        key = F.col("o_orderkey")

        def holes(n: int, r: int, source: str, name: str):
            return F.when(key % n != r, F.col(source)).alias(name)

        return self.tables["orders"].join(lines, F.col("l_orderkey") == key).select(
            key.alias("id"), holes(7, 3, "q", "f1"), holes(11, 4, "p", "f2"), holes(13, 5, "d", "f3"),
            holes(17, 6, "t", "f4"), F.col("o_totalprice").alias("f5"),
            (F.col("q") + 100 * F.col("d") > 31).cast("int").alias("label"),
            F.when(key % 7 == 0, 1.0 + key % 5).alias("dose"), (2.0 + key % 4).alias("stay_day"))
