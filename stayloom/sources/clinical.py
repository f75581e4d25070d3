"""Declared schemas of the clinical input tables."""

from __future__ import annotations


def _doubles(*names: str) -> str:
    return ", ".join(f"{n} double" for n in names)


_STAY = "subject_id bigint, hadm_id bigint, stay_id bigint"
_ADMISSION = "subject_id bigint, hadm_id bigint"
_BY_STAY = "subject_id bigint, stay_id bigint"
_AT = "charttime timestamp_ntz"

# Table and column names of the ICU warehouse.
WAREHOUSE_SCHEMAS = {
    "icustays": f"{_STAY}, intime timestamp_ntz, outtime timestamp_ntz",
    "chartevents": f"{_STAY}, itemid bigint, {_AT}, valuenum double",
    "labevents": f"{_ADMISSION}, itemid bigint, {_AT}, valuenum double",
    "diagnoses_icd": f"{_ADMISSION}, icd_code string",
    "sepsis3": f"{_BY_STAY}, sepsis3 boolean",
    "age": f"{_ADMISSION}, age double",
    "charlson": f"{_ADMISSION}, rheumatic_disease int, malignant_cancer int, metastatic_solid_tumor int, aids int, "
                "renal_disease int, mild_liver_disease int, severe_liver_disease int, chronic_pulmonary_disease int, "
                "congestive_heart_failure int, charlson_comorbidity_index int",
    "blood_differential": f"{_ADMISSION}, {_AT}, " + _doubles(
        "wbc", "lymphocytes_abs", "monocytes_abs", "neutrophils_abs", "lymphocytes", "monocytes", "neutrophils"),
    "first_day_bg_art": f"{_BY_STAY}, " + _doubles(
        *[f"{m}_{s}" for m in ("lactate", "po2", "pco2", "ph", "baseexcess", "pao2fio2ratio") for s in ("min", "max")]),
    "chemistry": f"{_ADMISSION}, {_AT}, calcium double",
    "enzyme": f"{_ADMISSION}, {_AT}, alp double",
    "gcs": f"{_BY_STAY}, {_AT}, gcs double",
    "first_day_sofa": f"{_ADMISSION}, sofa int",
    "first_day_urine_output": f"{_BY_STAY}, urineoutput double",
    "first_day_weight": f"{_BY_STAY}, weight_admit double",
    "first_day_vitalsign": f"{_BY_STAY}, " + _doubles(
        *[f"{m}_{s}" for m in ("heart_rate", "mbp", "resp_rate", "temperature", "sbp", "dbp", "spo2")
          for s in ("min", "max", "mean")]),
    "icp": f"{_BY_STAY}, {_AT}, icp double",
    "inflammation": f"{_ADMISSION}, {_AT}, crp double",
    "sapsii": f"{_STAY}, starttime timestamp_ntz, sapsii double",
    "coagulation": f"{_ADMISSION}, {_AT}, pt double, inr double",
    "icustay_detail": f"{_STAY}, admittime timestamp_ntz, dischtime timestamp_ntz, dod timestamp_ntz, gender string",
    "kdigo_stages": f"{_STAY}, aki_stage int",
    "sofa": "stay_id bigint, sofa_24hours int",
    "suspicion_of_infection": f"{_STAY}, specimen string, suspected_infection_time timestamp_ntz",
    "ventilation": "stay_id bigint, ventilation_status string",
    "bg": f"{_ADMISSION}, {_AT}, pao2fio2ratio double",
    "height": f"{_BY_STAY}, height double",
    "lods": f"{_STAY}, lods double",
    "meld": f"{_STAY}, meld double",
    "oasis": f"{_STAY}, oasis double",
}
