"""The propensity-matching flow: treatment table to matched pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.functions.scalar import presence, rate, recode
from stayloom.operators.impute import iterative_impute
from stayloom.operators.match import matched_pairs, nearest_control, propensity_score
from stayloom.operators.prepare import filter_complete_rows
from stayloom.plans import fixed_values as V
from stayloom.session import cut_lineage


@dataclass(frozen=True)
class MatchingConfig:
    key: str = "stay_id"
    ids: Sequence[str] = ("subject_id", "hadm_id")
    covariates: Sequence[str] = V.MATCH_COVARIATES
    dose: str = V.DOSE_COLUMN
    other_drug: str = V.OTHER_DRUG_COLUMN
    stay_day: str = V.STAY_DAY_COLUMN
    treated_name: str = "heparin"
    completeness: float = V.MATCH_COMPLETENESS
    max_iter: int = V.MATCH_IMPUTE_ROUNDS
    tol: float = V.MATCH_IMPUTE_TOLERANCE
    dose_above: float = V.MATCH_DOSE_ABOVE
    label_mode: str = "treated"
    codes: dict = field(default_factory=lambda: V.MATCH_CODES)


def prepare_treatment(df: DataFrame, cfg: MatchingConfig = MatchingConfig()) -> DataFrame:
    """Complete rows without the other drugs, imputed, with the treatment flag and the dose per day (runs jobs).

    Text covariates are recoded before imputation because the regressions need numbers.
    """
    kept = filter_complete_rows(df, cfg.covariates, cfg.completeness).filter(F.col(cfg.other_drug).isNull())
    kept = recode(kept.select(*cfg.ids, cfg.key, cfg.stay_day, *cfg.covariates, cfg.dose, cfg.other_drug), cfg.codes)
    filled = iterative_impute(cut_lineage(kept, "treatment"), cfg.covariates, key=cfg.key, max_iter=cfg.max_iter, tol=cfg.tol)
    dose = F.col(cfg.dose)
    return filled.withColumns({cfg.treated_name: presence(dose), "per_day": rate(dose, F.col(cfg.stay_day))})


def match_treatment(prepared: DataFrame, cfg: MatchingConfig = MatchingConfig()) -> DataFrame:
    """Matched pairs: every treated row beside its nearest control by propensity score (runs jobs)."""
    per_day = F.col("per_day")
    rows = prepared.filter(per_day.isNull() | (per_day > cfg.dose_above))
    rows = rows.withColumn("per_day_gt1", F.coalesce(per_day, F.lit(0.0)))
    scored = cut_lineage(propensity_score(rows, cfg.covariates, "per_day_gt1", key=cfg.key, label_mode=cfg.label_mode),
                         "scored")
    treated, control = scored.filter("per_day_gt1 > 0"), scored.filter("per_day is null")
    return matched_pairs(treated, control, nearest_control(treated, control, key=cfg.key, score="propensity_score"),
                         key=cfg.key)
