"""The ICU warehouse study: every named view, and the wide row that joins them.

``IcuStudy(tables)`` reads its inputs by the names of ``sources.clinical``. ``view(name)`` returns one view (lazily, but for the cohort that ``wide`` writes);
``wide()`` builds the final row without going through the single views: all laboratory items of both windows come from one
scan of the log, limited to cohort stays.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from copy import copy
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.functions.scalar import midpoint
from stayloom.operators import cohort as C
from stayloom.operators import labels as L
from stayloom.operators.events import (
    ADMISSION_KEYS,
    STAY_KEYS,
    attribute_stats,
    combine_items,
    event_stats,
    horizon_window,
    multi_window_column_stats,
    multi_window_stats,
    spread_items,
    stay_window,
    windowed_column_stats,
)
from stayloom.operators.wide import join_features, require_unique
from stayloom.plans import fixed_values as V
from stayloom.session import cut_lineage
from stayloom.sources.tables import refresh_table
from stayloom.sources.versions import Manifest, VersionedTables

BY_STAY = ("subject_id", "stay_id")


def _triples(names) -> list[str]:
    return [f"{n}_{s}" for n in names for s in ("min", "max", "avg")]


# Column order of the wide row.
WIDE_COLUMNS = [
    *STAY_KEYS, "age", "outtime", "intime", "stay_day", "sepsis",
    *_triples(V.BLOOD_GAS), *_triples(V.BLOOD_COUNTS), "lactate_dehydrogenase_max", *_triples(V.WIDE_LAB_FEATURES),
    *_triples(["alp"]), "height", "charlson_comorbidity_index_max", "urineoutput_max", "weight_admit_max",
    *[f"{s}_{v}" for v in V.VITALS for s in ("min", "max", "avg")], "gender", *_triples(["pt", "inr"]), "death28",
    "aki_stage_max", "sepsis_aki", "sepsis_li", "sepsis_co", "sepsis_ali",
]

# Tables that meet the wide row as they are and therefore must hold one row per key.
UNIQUE_INPUTS = {
    "sepsis3": BY_STAY, "age": ADMISSION_KEYS, "charlson": ADMISSION_KEYS, "first_day_bg_art": BY_STAY,
    "height": BY_STAY, "icustay_detail": STAY_KEYS,
}


class IcuStudy:
    def __init__(self, tables: Mapping[str, DataFrame]):
        self.t = tables

    # --- shared frames ---------------------------------------------------------------------------------------

    @property
    def stays(self) -> DataFrame:
        return self.t["icustays"]

    @cached_property
    def cohort(self) -> DataFrame:
        return C.build_cohort(self.stays, self.t["sepsis3"], self.t["age"], min_age=V.MIN_AGE, max_age=V.MAX_AGE,
                              min_hours=V.MIN_STAY_HOURS)

    def day_stats(self, items, tag: str | None = None) -> DataFrame:
        """One or several lab items, 6 hours before to 24 hours after admission."""
        return event_stats(self.stays, self.t["labevents"], window=horizon_window(), items=items, tag=tag)

    def stay_stats(self, items, tag: str | None = None) -> DataFrame:
        """One or several lab items, 6 hours before admission to the end of the stay."""
        return event_stats(self.stays, self.t["labevents"], window=stay_window(), items=items, tag=tag)

    def bedside_stats(self, item: int, tag: str, after: int = 24) -> DataFrame:
        """One monitored item; the bedside log also carries the stay id."""
        return event_stats(self.stays, self.t["chartevents"], window=horizon_window(6, after), items=[item],
                           keys=STAY_KEYS, tag=tag)

    def _measured(self, table: str, column: str, tag: str, keys=ADMISSION_KEYS, time: str = "charttime") -> DataFrame:
        stats = windowed_column_stats(self.stays, self.t[table], [column], window=horizon_window(), keys=keys, time=time)
        return stats.select(*STAY_KEYS, *[F.col(f"{column}_{s}").alias(f"{s}_value") for s in ("min", "max", "avg")],
                            F.lit(tag).alias("e_type"))

    def _attribute(self, table: str, column: str, keys) -> DataFrame:
        stats = attribute_stats(self.stays, self.t[table], [column], keys=keys)
        return stats.select(*STAY_KEYS, *[F.col(f"{column}_{s}").alias(f"{s}_value") for s in ("min", "max", "avg")],
                            F.lit(column).alias("e_type"))

    # --- pieces of the labels, each over per-stay statistics ---------------------------------------------------

    def _platelet_scores(self, stats: DataFrame, low: str = "min_value") -> DataFrame:
        """Scores of both platelet items from one set of per-item statistics."""
        names = [f"platelet_count_score_{i}" for i in V.PLATELET_ITEMS]
        parts = [L.low_count_score(stats.filter(F.col("itemid") == i).withColumnRenamed(low, "min_value"), n)
                 for i, n in zip(V.PLATELET_ITEMS, names)]
        return L.combine_scores(parts[0], parts[1], tuple(names), "platelet_count_score")

    def _coagulation_label(self, stats: DataFrame) -> DataFrame:
        ratio = L.ratio_score(stats.filter(F.col("itemid") == V.PROTHROMBIN_ITEM), "ptr", "max_pt_12").drop("max_pt_12")
        sofa = L.grade_score(self.t["sofa"], "sofa_24hours", "sofa24_score").select("stay_id", "sofa24_score")
        return L.sum_of_scores_label(
            self._platelet_scores(stats).select(*STAY_KEYS, "platelet_count_score"),
            [(ratio, STAY_KEYS), (sofa, ["stay_id"])], ["platelet_count_score", "ptr", "sofa24_score"],
            L.prefix_flag(self.t["diagnoses_icd"], V.COAGULATION_CODES), "sepsis_co")

    def _liver_label(self, stats: DataFrame, clotting: DataFrame) -> DataFrame:
        """``stats``: per-item stay statistics; ``clotting``: ``max_inr`` per stay within the stay itself."""
        liver = stats.filter(F.col("itemid").isin(list(V.LIVER_ITEMS)))
        tops = [F.max(F.when(F.col("itemid") == i, F.col("max_value"))).alias(f"max_{i}") for i in V.BILIRUBIN_ITEMS]
        measured = liver.groupBy(*STAY_KEYS).agg(*tops).join(clotting.select(*STAY_KEYS, "max_inr"), list(STAY_KEYS), "left")
        high = [F.col(f"max_{i}") > V.LIVER_BILIRUBIN_ABOVE for i in V.BILIRUBIN_ITEMS]
        values = [*[f"max_{i}" for i in V.BILIRUBIN_ITEMS], "max_inr"]
        return L.multi_threshold_label(
            measured, self.t["charlson"], values={v: v for v in values}, name="sepsis_li",
            rule=(high[0] | high[1]) & (F.col("max_inr") > V.LIVER_INR_ABOVE),
            without=("mild_liver_disease", "severe_liver_disease"))

    @cached_property
    def lung_collection(self) -> DataFrame:
        return L.evidence_collection(
            self.t["suspicion_of_infection"], self.t["ventilation"], self.t["bg"], self.stays,
            statuses=V.INVASIVE_VENTILATION, window=stay_window(), value="pao2fio2ratio", below=V.LUNG_RATIO_BELOW)

    def _lactate(self) -> DataFrame:
        gas = self.t["first_day_bg_art"].filter(F.col("lactate_max").isNotNull())
        return gas.groupBy(*BY_STAY).agg(F.max("lactate_max").alias("max_value"), F.min("lactate_min").alias("min_value"))

    # --- the wide row ------------------------------------------------------------------------------------------

    def check_inputs(self) -> None:
        """Fail if an input joined as it is would duplicate stays (runs one job)."""
        require_unique({name: (self.t[name], keys) for name, keys in UNIQUE_INPUTS.items()})

    def wide(self) -> DataFrame:
        """One row per cohort stay with all features and labels (runs the job that writes the cohort).

        The narrow joins come first, the wide lab features last, and parts sharing the three stay keys follow each other
        so that the cohort is exchanged once for all of them. The cohort enters a dozen joins, so it is written first.
        """
        cohort = cut_lineage(self.cohort, "cohort")
        window = {"day": horizon_window(), "stay": stay_window()}
        features = [i for ids in V.WIDE_LAB_FEATURES.values() for i in ids]
        labs = multi_window_stats(cohort, self.t["labevents"], windows=window,
                                  items=sorted({*features, *V.STAY_ITEMS, V.PROTHROMBIN_ITEM}))
        day = spread_items(labs, V.WIDE_LAB_FEATURES, prefix="day_", avg_of_feature={"calcium": "avg_value"})
        whole_stay = labs.filter(F.col("stay_n") > 0).select(
            *STAY_KEYS, "itemid", *[F.col(f"stay_{s}_value").alias(f"{s}_value") for s in ("min", "max", "avg")])
        clotting = multi_window_column_stats(cohort, self.t["coagulation"], ["pt", "inr"],
                                             windows={"day": horizon_window(), "stay": stay_window(0)})
        counts = windowed_column_stats(cohort, self.t["blood_differential"], V.BLOOD_COUNTS, window=horizon_window())
        alp = windowed_column_stats(cohort, self.t["enzyme"], ["alp"], window=horizon_window())
        gas = self.t["first_day_bg_art"].select(
            *BY_STAY, *[F.col(f"{g}_{s}") for g in V.BLOOD_GAS for s in ("min", "max")],
            *[midpoint(F.col(f"{g}_min"), F.col(f"{g}_max")).alias(f"{g}_avg") for g in V.BLOOD_GAS])
        by_stay = [
            (gas, BY_STAY),
            (self._lactate().select(*BY_STAY, F.col("max_value").alias("lactate_dehydrogenase_max")), BY_STAY),
            (self.t["height"].select(*BY_STAY, "height"), BY_STAY),
            (self._top("first_day_urine_output", "urineoutput"), BY_STAY),
            (self._top("first_day_weight", "weight_admit"), BY_STAY),
            (self._vitals(), BY_STAY),
        ]
        by_admission = [
            (self.t["charlson"].groupBy(*ADMISSION_KEYS).agg(
                F.max("charlson_comorbidity_index").alias("charlson_comorbidity_index_max")), ADMISSION_KEYS),
        ]
        by_all = [
            (self.t["icustay_detail"].select(*STAY_KEYS, "gender"), STAY_KEYS),
            (L.mortality_label(self.t["icustay_detail"]).select(*STAY_KEYS, "death28"), STAY_KEYS),
            (L.stage_label(self.t["kdigo_stages"], self.t["charlson"]).select(
                *STAY_KEYS, F.col("max_aki_stage").alias("aki_stage_max"), "sepsis_aki"), STAY_KEYS),
            (self._liver_label(whole_stay, clotting.select(*STAY_KEYS, F.col("stay_inr_max").alias("max_inr"))).select(
                *STAY_KEYS, "sepsis_li"), STAY_KEYS),
            (self._coagulation_label(whole_stay).select(*STAY_KEYS, "sepsis_co"), STAY_KEYS),
            (L.membership_label(cohort, self.lung_collection, self.t["charlson"]), STAY_KEYS),
            (clotting.select(*STAY_KEYS, *[F.col(f"day_{c}").alias(c) for c in _triples(["pt", "inr"])]), STAY_KEYS),
            (alp, STAY_KEYS), (counts, STAY_KEYS), (day, STAY_KEYS),
        ]
        return join_features(cohort, [*by_admission, *by_stay, *by_all]).select(*WIDE_COLUMNS)

    @cached_property
    def wide_table(self) -> DataFrame:
        """The wide row written once, for the slices that start from it."""
        return cut_lineage(self.wide(), "wide")

    def _top(self, table: str, column: str) -> DataFrame:
        return self.t[table].groupBy(*BY_STAY).agg(F.max(column).alias(f"{column}_max"))

    def _vitals(self) -> DataFrame:
        kinds = {"min": ("min", F.min), "max": ("max", F.max), "avg": ("mean", F.avg)}
        return self.t["first_day_vitalsign"].groupBy(*BY_STAY).agg(
            *[fn(f"{v}_{source}").alias(f"{out}_{v}") for v in V.VITALS for out, (source, fn) in kinds.items()])

    # --- views ---------------------------------------------------------------------------------------------------

    def view(self, name: str) -> DataFrame:
        if name in V.DAY_ITEM_VIEWS:
            tag, item = V.DAY_ITEM_VIEWS[name]
            return self.day_stats([item], tag)
        if name in V.DAY_GROUP_VIEWS:
            return combine_items(self.day_stats(V.DAY_GROUP_VIEWS[name][1]))
        if name.removeprefix("self_").isdigit() and int(name.removeprefix("self_")) in V.STAY_ITEMS:
            item = name.removeprefix("self_")
            return self.stay_stats([int(item)], item)
        return VIEWS[name](self)

    @staticmethod
    def view_names() -> list[str]:
        return [*V.DAY_ITEM_VIEWS, *V.DAY_GROUP_VIEWS, *[f"self_{i}" for i in V.STAY_ITEMS], *VIEWS]

    def refresh_all(self, store: VersionedTables, names: Sequence[str] | None = None) -> Manifest:
        """Refresh the named views (all by default) as one new version of ``store``: readers see all of them or none.

        The cohort, the lung collection and the wide row are written before the views that start from them, which read what
        was written.
        """
        wanted = list(names or self.view_names())
        study, batch = copy(self), store.batch()
        order = [n for n in SHARED if n in wanted and n != WIDE_VIEW]
        order += [n for n in wanted if n not in order and n not in AFTER_WIDE and n != WIDE_VIEW]
        order += [n for n in wanted if n == WIDE_VIEW] + [n for n in wanted if n in AFTER_WIDE]
        for name in order:
            written = batch.write(name, study.view(name))
            if name in SHARED:
                study.__dict__[SHARED[name]] = written
        return batch.commit()

    def materialize(self, name: str) -> DataFrame:
        """Fully refresh the view as a catalog table of the same name."""
        return refresh_table(self.view(name), name)


def _blood_differential(s: IcuStudy) -> DataFrame:
    return windowed_column_stats(s.stays, s.t["blood_differential"], V.BLOOD_COUNTS, window=horizon_window())


def _vital_signs(s: IcuStudy) -> DataFrame:
    return s.stays.select(*STAY_KEYS).join(s._vitals(), list(BY_STAY), "left").select(
        *STAY_KEYS, *[f"{k}_{v}" for v in V.VITALS for k in ("min", "max", "avg")],
        F.lit("hr_mbp_resp_temperature").alias("e_type"))


def _severity(s: IcuStudy) -> DataFrame:
    stats = windowed_column_stats(s.stays, s.t["sapsii"], ["sapsii"], window=horizon_window(), keys=STAY_KEYS,
                                  time="starttime")
    return stats.select(*STAY_KEYS, F.col("sapsii_avg").alias("sapsii"), F.lit("sapsii").alias("e_type"))


def _clotting_ratio(s: IcuStudy, window) -> DataFrame:
    stats = windowed_column_stats(s.stays, s.t["coagulation"], ["inr"], window=window)
    return stats.select(*STAY_KEYS, *[F.col(f"inr_{k}").alias(f"{k}_inr") for k in ("min", "max", "avg")],
                        F.lit("inr").alias("e_type"))


def _site_slice(s: IcuStudy) -> DataFrame:
    """Where the wide row has not been written, only the stays of the slice get one."""
    few = copy(s)
    few.__dict__["cohort"] = cohort = cut_lineage(s.cohort, "cohort")
    sites = cut_lineage(L.site_flags(s.t["suspicion_of_infection"], cohort, V.SITE_SPECIMENS).drop("count").filter(~F.col("pulmonary")), "sites")
    if "wide_table" not in s.__dict__:
        picked = C.flag_slice(cohort.filter("sepsis"), sites, ~F.col("pulmonary")).select(*[F.col(k).alias(f"_{k}") for k in STAY_KEYS]).distinct()
        few.__dict__["cohort"] = cohort.join(picked, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in STAY_KEYS]), "left_semi")
    return C.flag_slice(few.wide_table.filter("sepsis"), sites, ~F.col("pulmonary"))


WIDE_VIEW = "self_sepsis_20230822"
# Views that others start from, and the frame of the study that each of them is.
SHARED = {"self_collection": "cohort", "self_sepsis_ali_collection": "lung_collection", WIDE_VIEW: "wide_table"}
AFTER_WIDE = ("self_icd_code_5x", "self_sepsis_ali_20230824")

VIEWS: dict[str, Callable[[IcuStudy], DataFrame]] = {
    "self_collection_all": lambda s: C.collect_attributes(
        s.stays, s.t["sepsis3"], s.t["age"], s.t["charlson"],
        ("rheumatic_disease", "malignant_cancer", "metastatic_solid_tumor", "aids")),
    "self_collection": lambda s: s.cohort,
    "self_blood_differential": _blood_differential,
    "self_LactateDehydrogenase": lambda s: s._lactate(),
    "self_calcium": lambda s: s._measured("chemistry", "calcium", "calcium"),
    "self_calcium_new": lambda s: s.day_stats(V.FREE_CALCIUM[1], V.FREE_CALCIUM[0]),
    "self_alp": lambda s: s._measured("enzyme", "alp", "alp"),
    "self_gcs": lambda s: s._measured("gcs", "gcs", "gcs", BY_STAY),
    "self_charlson_comorbidity_index": lambda s: s._attribute("charlson", "charlson_comorbidity_index", ADMISSION_KEYS),
    "self_sofa": lambda s: s._attribute("first_day_sofa", "sofa", ADMISSION_KEYS),
    "self_urineoutput": lambda s: s._attribute("first_day_urine_output", "urineoutput", BY_STAY),
    "self_weight_admit": lambda s: s._attribute("first_day_weight", "weight_admit", BY_STAY),
    "self_hr_mbp_resp_temperature": _vital_signs,
    "self_icp": lambda s: s._measured("icp", "icp", "icp", BY_STAY),
    "self_crp": lambda s: s._measured("inflammation", "crp", "crp"),
    "self_sapsii": _severity,
    "self_pt": lambda s: s._measured("coagulation", "pt", "pt"),
    "self_inr": lambda s: _clotting_ratio(s, horizon_window()),
    "self_inr_total": lambda s: _clotting_ratio(s, stay_window(0)),
    "self_death_ratio": lambda s: L.mortality_label(s.t["icustay_detail"]),
    "self_sepsis_aki": lambda s: L.stage_label(s.t["kdigo_stages"], s.t["charlson"]),
    "self_liver_injury_collection": lambda s: s.stay_stats(V.LIVER_ITEMS).select(*STAY_KEYS).distinct(),
    "self_platelet_count_score": lambda s: s._platelet_scores(s.stay_stats(V.PLATELET_ITEMS)),
    "self_sepsis_li": lambda s: s._liver_label(s.stay_stats(V.LIVER_ITEMS), s.view("self_inr_total")),
    "self_ptr_score": lambda s: L.ratio_score(s.stay_stats([V.PROTHROMBIN_ITEM]), "ptr", "max_pt_12"),
    "self_sofa24_score": lambda s: L.grade_score(s.t["sofa"], "sofa_24hours", "sofa24_score"),
    "self_sepsis_co_match": lambda s: L.prefix_flag(s.t["diagnoses_icd"], V.COAGULATION_CODES),
    "self_sepsis_co": lambda s: s._coagulation_label(s.stay_stats([*V.PLATELET_ITEMS, V.PROTHROMBIN_ITEM])),
    "self_sepsis_ali_collection": lambda s: s.lung_collection,
    "self_sepsis_ali": lambda s: L.membership_label(s.cohort, s.lung_collection, s.t["charlson"]),
    "self_sepsis_20230822": lambda s: s.wide(),
    "self_icd_code_5x": lambda s: C.diagnosis_slice(s.wide_table, s.t["diagnoses_icd"], V.KIDNEY_CODES),
    "self_icd_code_5x_counts": lambda s: C.diagnosis_slice_counts(s.cohort, s.t["diagnoses_icd"], V.KIDNEY_CODES),
    "respiratory_specimen_stays": lambda s: L.membership_label(
        C.specimen_slice(s.cohort, s.t["suspicion_of_infection"], V.RESPIRATORY_SPECIMENS), s.lung_collection,
        s.t["charlson"], keep=True),
    "self_specimen_count": lambda s: L.site_flags(s.t["suspicion_of_infection"], s.cohort, V.SITE_SPECIMENS),
    "self_specimen_totals": lambda s: L.flag_totals(s.view("self_specimen_count"), list(V.SITE_SPECIMENS)),
    "self_sepsis_ali_20230824": _site_slice,
}
