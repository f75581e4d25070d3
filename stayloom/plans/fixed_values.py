"""Fixed values of the study: item ids, code lists, column names and settings.

They must be exactly these for the results to be right; there is no logic here.
"""

from __future__ import annotations

# --- laboratory items -------------------------------------------------------------------------------------------

# view name -> (label, item id), window from 6 h before to 24 h after admission
DAY_ITEM_VIEWS = {
    "self_Troponin_T": ("Troponin T", 51003),
    "self_CreatineKinase_IsoenzymeMB": ("Creatine Kinase,Isoenzyme MB", 50911),
    "self_Albumin": ("Albumin", 50862),
    "self_NTproBNP": ("NTproBNP", 50963),
    "self_AnionGap": ("Anion Gap", 50868),
    "self_Bicarbonate": ("Bicarbonate", 50882),
    "self_UreaNitrogen": ("Urea Nitrogen", 51006),
    "self_Creatinine": ("Creatinine", 50912),
    "self_Chloride": ("Chloride", 50902),
    "self_Sodium": ("Sodium", 50983),
    "self_Potassium": ("Potassium", 50971),
    "self_Hematocrit": ("Hematocrit", 51221),
    "self_PlateletCount": ("Platelet Count", 51265),
    "self_AlanineAminotransferase": ("Alanine Aminotransferase (ALT)", 50861),
    "self_Amylase": ("Amylase", 50867),
    "self_BilirubinTotal": ("Bilirubin, Total", 50885),
}
# view name -> (label, item ids) combined over items
DAY_GROUP_VIEWS = {
    "self_Glucose": ("Glucose", (52569, 50931, 50809)),
    "self_DDimer": ("D-Dimer", (50915, 51196, 52551)),
    "self_Hemoglobin": ("Hemoglobin", (50811, 51640, 51222)),
}
FREE_CALCIUM = ("Free Calcium", (50808, 51624))
# item ids aggregated from 6 h before admission to the end of the stay
STAY_ITEMS = (50861, 53084, 50878, 53088, 50885, 53089, 51265, 51704)
LIVER_ITEMS = (50861, 53084, 50878, 53088, 50885, 53089)
BILIRUBIN_ITEMS = (50885, 53089)
PLATELET_ITEMS = (51265, 51704)
PROTHROMBIN_ITEM = 51274

# feature of the wide row -> item ids
WIDE_LAB_FEATURES = {
    "troponin_t": (51003,),
    "creatine_kinase_isoenzyme": (50911,),
    "albumin": (50862,),
    "anion_gap": (50868,),
    "urea_nitrogen": (51006,),
    "creatinine": (50912,),
    "chloride": (50902,),
    "sodium": (50983,),
    "potassium": (50971,),
    "glucose": (52569, 50931, 50809),
    "hematocrit": (51221,),
    "hemoglobin": (50811, 51640, 51222),
    "platelet_count": (51265,),
    "alanine_aminotransferase": (50861,),
    "bilirubin_total": (50885,),
    "calcium": (50808, 51624),
}

BLOOD_GAS = ("po2", "pco2", "ph", "baseexcess", "pao2fio2ratio")
BLOOD_COUNTS = ("wbc", "lymphocytes_abs", "monocytes_abs", "neutrophils_abs", "lymphocytes", "monocytes", "neutrophils")
VITALS = ("heart_rate", "mbp", "resp_rate", "temperature", "sbp", "dbp", "spo2")

# --- cohort, labels, slices -------------------------------------------------------------------------------------

MIN_AGE, MAX_AGE, MIN_STAY_HOURS = 18, 89, 48
LIVER_BILIRUBIN_ABOVE, LIVER_INR_ABOVE = 2.0, 1.5
LUNG_RATIO_BELOW = 200.0
COAGULATION_CODES = ("286", "287", "451", "D68", "D69", "I80", "D65")
KIDNEY_CODES = ("582", "585", "586", "V56")
INVASIVE_VENTILATION = ("Tracheostomy", "InvasiveVent", "HFNC")
RESPIRATORY_SPECIMENS = (
    "TRACHEAL ASPIRATE", "BRONCHIAL BRUSH", "BRONCHIAL BRUSH - PROTECTED", "BRONCHOALVEOLAR LAVAGE",
    "BRONCHIAL WASHINGS", "SPUTUM",
)
SITE_SPECIMENS = {
    "pulmonary": (
        "TRACHEAL ASPIRATE", "BRONCHIAL BRUSH", "BRONCHIAL BRUSH - PROTECTED", "ASPIRATE", "BRONCHOALVEOLAR LAVAGE",
        "BRONCHIAL WASHINGS", "SPUTUM", "Rapid Respiratory Viral Screen & Culture",
        "RAPID RESPIRATORY VIRAL ANTIGEN TEST", "Mini-BAL", "Influenza A/B by DFA",
        "Influenza A/B by DFA - Bronch Lavage",
    ),
    "blood": (
        "BLOOD CULTURE ( MYCO/F LYTIC BOTTLE)", "BLOOD CULTURE", "BLOOD", "Blood (CMV AB)", "Blood (Malaria)",
        "Blood (Toxo)", "DIALYSIS FLUID", "Blood (LYME)", "Blood (EBV)", "Stem Cell - Blood Culture", "SEROLOGY/BLOOD",
        "BLOOD BAG FLUID",
    ),
    "abdomen": ("PERITONEAL FLUID", "BILE", "STOOL"),
    "urine": ("URINE,KIDNEY", "URINE", "URINE,SUPRAPUBIC ASPIRATE"),
    "central nervous system": ("CSF;SPINAL FLUID",),
    "Bones and joints": (
        "PROSTHETIC JOINT FLUID", "JOINT FLUID", "BONE MARROW", "BONE MARROW - CYTOGENETICS",
    ),
    "Skin and soft tissue": ("FLUID WOUND", "SKIN SCRAPINGS", "FOOT CULTURE", "TISSUE"),
    "Other": (
        "CORNEAL EYE SCRAPINGS", "NAIL SCRAPINGS", "ARTHROPOD",
        "Direct Antigen Test for Herpes Simplex Virus Types 1 & 2", "ABSCESS", "THROAT CULTURE", "SWAB, R/O GC",
        "FOREIGN BODY", "Swab R/O Yeast Screen", "ANORECTAL/VAGINAL", "PERIPHERAL BLOOD LYMPHOCYTES", "SWAB", "Isolate",
        "DIRECT ANTIGEN TEST FOR VARICELLA-ZOSTER VIRUS", "C, E, & A Screening", "CRE Screen", "Staph aureus swab",
        "Infection Control Yeast", "IMMUNOLOGY", "EYE", "BIOPSY", "NEOPLASTIC BLOOD", "VIRAL CULTURE",
        "BLOOD CULTURE - NEONATE", "VIRAL CULTURE:R/O HERPES SIMPLEX VIRUS", "FLUID,OTHER", "WORM",
        "STOOL (RECEIVED IN TRANSPORT SYSTEM)", "Swab", "EAR", "MRSA SCREEN", "VIRAL CULTURE: R/O CYTOMEGALOVIRUS",
        "Touch Prep/Sections", "CATHETER TIP-IV", "FECAL SWAB", "THROAT FOR STREP", "Foreign Body - Sonication Culture",
        "Influenza A/B by DFA - Bronch Lavage", "PLEURAL FLUID", "Immunology (CMV)", "POSTMORTEM CULTURE",
    ),
}

# --- external hospital ------------------------------------------------------------------------------------------

PATIENT_KEY, ADMITTED, DISCHARGED = "住院号", "入科时间", "出科时间"
SAMPLE_PATIENT, SAMPLE_TIME, SAMPLE_RESULT = "病人号", "采样时间", "检验结果"
UNDETECTED = "测不出"
COMORBIDITY_FLAGS = (
    "心梗1", "心衰", "周围血管", "痴呆", "脑血管（无后遗症）", "结缔组织", "消化性溃疡", "糖尿病（无并发症）", "慢性肺病",
    "轻度肝病", "偏瘫2", "CKD", "糖尿病（有并发症）", "实体瘤", "白血病", "淋巴瘤", "3肝病（门脉高压、出血）", "6转移肿瘤",
)
ANALYTES = ("ag", "be", "ca", "ci", "fio2", "glu", "k", "lac", "na", "paco2", "pao2", "ph")
RATIO_ANALYTE = "pao2fio2ratio"
# counted only up to 24 h after admission
CAPPED_ANALYTES = ("fio2", "lac", "paco2", "pao2", "pao2fio2ratio")
GLUCOSE_FACTOR = 18
# output feature -> analyte
EXTERNAL_ANALYTE_FEATURES = {
    "po2": "pao2", "pco2": "paco2", "ph": "ph", "baseexcess": "be", "pao2fio2ratio": "pao2fio2ratio", "lactate": "lac",
    "anion_gap": "ag", "chloride": "ci", "sodium": "na", "potassium": "k", "glucose": "glu", "calcium": "ca",
}
# output feature -> stem of the text columns <stem>_min and <stem>_max
EXTERNAL_TEXT_FEATURES = {
    "wbc": "白细胞", "lymphocytes_abs": "淋巴细胞计数", "monocytes_abs": "单核细胞计数", "neutrophils_abs": "中性粒细胞计数",
    "lymphocytes": "淋巴细胞百分比", "monocytes": "单核细胞百分比", "neutrophils": "中性粒细胞百分比",
    "creatine_kinase_isoenzyme": "肌酸激酶", "albumin": "总蛋白", "urea_nitrogen": "尿素", "creatinine": "肌酐",
    "hematocrit": "红细胞压积", "hemoglobin": "血红蛋白", "platelet_count": "血小板",
    "alanine_aminotransferase": "谷丙转氨酶", "bilirubin_total": "总胆红素", "alp": "碱性磷酸酶",
}
# output vital -> stem of the text columns <stem>最小值 and <stem>最大值
EXTERNAL_VITALS = {
    "heart_rate": "心率", "resp_rate": "呼吸", "temperature": "体温", "sbp": "收缩压", "dbp": "舒张压", "spo2": "SpO2",
}
VITAL_MIN_SUFFIX, VITAL_MAX_SUFFIX = "最小值", "最大值"
URINE_COLUMN, MALE_COLUMN, DEATH_COLUMN, NAME_COLUMN, AGE_COLUMN = "24小时尿量", "男性1", "死亡1", "姓名", "AGE"
CLOTTING_TEXT = {"pt": "PT", "inr": "INR"}
OUTCOME_FLAGS = ("sepsis_aki", "sepsis_li", "sepsis_co", "sepsis_ali")

# --- modelling --------------------------------------------------------------------------------------------------

TRAIN_FRACTION, SPLIT_SEED = 0.8, 1987
COMPLETENESS, MAX_FEATURES = 0.8, 10
IMPUTE_ROUNDS, IMPUTE_TOLERANCE, IMPUTE_NEAREST = 100, 0.1, 3
PREDICT_TARGET = "sepsis_ali"
FIRST_FEATURE, LAST_FEATURE = "po2_min", "inr_avg"
INTERNAL_KEYS, EXTERNAL_KEYS = ("subject_id", "hadm_id", "stay_id"), ("name",)
TARGET_COLUMNS = (
    "alp_max", "hematocrit_min", "min_heart_rate", "min_mbp", "urea_nitrogen_min", "po2_max", "avg_sbp", "alp_min",
    "platelet_count_min", "glucose_min", "max_sbp", "platelet_count_max", "glucose_max", "pao2fio2ratio_max",
    "pao2fio2ratio_min", "avg_dbp", "baseexcess_min", "platelet_count_avg", "creatine_kinase_isoenzyme_max",
    "pao2fio2ratio_avg",
)
# Columns a selector may use, from a rule: three statistics per measurement and vital, and four single columns.
LEGAL_MEASUREMENTS = (
    "po2", "pco2", "ph", "baseexcess", "pao2fio2ratio", "wbc", "lymphocytes_abs", "monocytes_abs", "neutrophils_abs",
    "lymphocytes", "monocytes", "neutrophils", "lactate", "creatine_kinase_isoenzyme", "albumin", "anion_gap",
    "urea_nitrogen", "creatinine", "chloride", "sodium", "potassium", "glucose", "hematocrit", "hemoglobin",
    "platelet_count", "alanine_aminotransferase", "bilirubin_total", "calcium", "alp", "pt",
)
LEGAL_COLUMNS = frozenset(
    [f"{m}_{s}" for m in LEGAL_MEASUREMENTS for s in ("min", "max", "avg")]
    + [f"{s}_{v}" for v in VITALS for s in ("min", "max", "avg")]
    + ["inr_min", "urineoutput_max", "gender", "charlson_comorbidity_index_max"]
)
FLAG_CODES = {"t": 1, "f": 0}
ANALYSIS_CODES = {
    "gender": {"F": 1, "M": 0}, "death28": FLAG_CODES, "sepsis": FLAG_CODES, "sepsis_aki": FLAG_CODES,
    "sepsis_li": FLAG_CODES, "sepsis_co": FLAG_CODES, "sepsis_ali": FLAG_CODES,
}

# --- propensity matching ----------------------------------------------------------------------------------------

MATCH_COMPLETENESS, MATCH_IMPUTE_ROUNDS, MATCH_IMPUTE_TOLERANCE = 0.95, 50, 0.2
MATCH_DOSE_ABOVE = 2
MATCH_CODES = {"gender": {"M": 1, "F": 0}}
DOSE_COLUMN, OTHER_DRUG_COLUMN, STAY_DAY_COLUMN = "itemid_225975_dose", "itemids", "stay_day"
MATCH_COVARIATES = (
    "po2_avg", "pco2_avg", "ph_avg", "bicarbonate_avg", "pao2fio2ratio_avg", "wbc_avg", "lymphocytes_abs_avg",
    "hemoglobin_avg", "albumin_avg", "lactate_max", "charlson_comorbidity_index_max", "platelet_count_avg",
    "alanine_aminotransferase_avg", "bilirubin_total_avg", "creatinine_avg", "glucose_avg", "avg_heart_rate", "avg_mbp",
    "avg_resp_rate", "avg_temperature", "pt_avg", "age", "gender",
)
