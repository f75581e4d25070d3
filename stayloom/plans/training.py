"""The prediction flow: wide rows to train and verify tables, classifiers and their accuracy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.functions.scalar import recode
from stayloom.operators import classify
from stayloom.operators.evaluate import confusion_matrix, mean_accuracy
from stayloom.operators.impute import check_imputed, iterative_impute
from stayloom.operators.prepare import (
    add_missing_columns,
    balance_undersample,
    column_range,
    concat_flagged,
    filter_complete_rows,
    filter_target_cohort,
    split_exact,
)
from stayloom.operators.select import stable_features
from stayloom.plans import fixed_values as V
from stayloom.session import cut_lineage
from stayloom.sources.tables import StageStore


@dataclass(frozen=True)
class TrainingConfig:
    key: str = "stay_id"
    target: str = V.PREDICT_TARGET
    features: Sequence[str] = V.TARGET_COLUMNS
    extra: Sequence[str] = (*V.INTERNAL_KEYS, *V.EXTERNAL_KEYS)
    codes: dict = field(default_factory=lambda: V.ANALYSIS_CODES)
    completeness: float = V.COMPLETENESS
    fraction: float = V.TRAIN_FRACTION
    seed: int = V.SPLIT_SEED
    max_iter: int = V.IMPUTE_ROUNDS
    tol: float = V.IMPUTE_TOLERANCE
    impute_on: str = "both"  # "train" fits and fills the two parts apart
    balance_verify: bool = True


def with_lactate_name(df: DataFrame) -> DataFrame:
    """The internal wide row calls its lactate maximum ``lactate_dehydrogenase_max``; features know it as ``lactate_max``."""
    if "lactate_dehydrogenase_max" in df.columns and "lactate_max" not in df.columns:
        return df.withColumnRenamed("lactate_dehydrogenase_max", "lactate_max")
    return df


def eligible_rows(df: DataFrame, cfg: TrainingConfig) -> DataFrame:
    """Numeric codes, complete enough rows, and the target's cohort."""
    coded = recode(with_lactate_name(df), cfg.codes)
    return filter_target_cohort(filter_complete_rows(coded, cfg.features, cfg.completeness), cfg.target)


def align(df: DataFrame, cfg: TrainingConfig, other: DataFrame | None = None) -> DataFrame:
    """Extra columns, features and target in one order. A column that only ``other`` has is NULL of its type, one that
    neither has is empty text."""
    names = list(dict.fromkeys([cfg.key, *cfg.extra, *cfg.features, cfg.target]))
    there = {} if other is None else {f.name: f.dataType for f in other.schema}
    typed = {c: F.lit(None).cast(there[c]) for c in names if c not in df.columns and c in there}
    return add_missing_columns(df.withColumns(typed) if typed else df, names).select(*names)


def clean_data(internal: DataFrame, cfg: TrainingConfig = TrainingConfig(), external: DataFrame | None = None) -> DataFrame:
    """Train rows (``model`` 1) and verify rows (``model`` 0): a split of the internal rows, or all of them against the
    external ones (runs counting jobs). External rows need the key column as well."""
    rows = eligible_rows(internal, cfg)
    if external is None:
        train, verify = split_exact(cut_lineage(rows, "eligible"), key=cfg.key, fraction=cfg.fraction, seed=cfg.seed)
    else:
        train, verify = rows, eligible_rows(external, cfg)
    return concat_flagged(align(train, cfg, verify), align(verify, cfg, train))


def prepare_dataset(internal: DataFrame, cfg: TrainingConfig = TrainingConfig(), external: DataFrame | None = None,
                    store: StageStore | None = None) -> tuple[DataFrame, DataFrame]:
    """Balanced train and verify tables without missing features (runs jobs).

    By default train and verify rows are imputed together and both are balanced, as in the study.
    """
    def stage(df: DataFrame, name: str) -> DataFrame:
        return store.write(df, name) if store else cut_lineage(df, name)

    data = stage(clean_data(internal, cfg, external), "clean_data")
    parts = [data] if cfg.impute_on == "both" else [data.filter("model = 1"), data.filter("model = 0")]
    filled = [iterative_impute(p, cfg.features, key=cfg.key, max_iter=cfg.max_iter, tol=cfg.tol) for p in parts]
    complete = stage(filled[0] if len(filled) == 1 else filled[0].unionByName(filled[1]), "multiple_imputation")
    check_imputed(data, complete, cfg.features)
    train, verify = [complete.filter(F.col("model") == m).drop("model") for m in (1, 0)]
    train = balance_undersample(train, cfg.target, key=cfg.key)
    if cfg.balance_verify:
        verify = balance_undersample(verify, cfg.target, key=cfg.key)
    return stage(train, "train"), stage(verify, "verify")


def select_features(wide: DataFrame, cfg: TrainingConfig = TrainingConfig(), *, first: str = V.FIRST_FEATURE,
                    last: str = V.LAST_FEATURE, allowed=V.LEGAL_COLUMNS, seeds: Sequence[int] = range(10),
                    top: int = V.MAX_FEATURES) -> DataFrame:
    """The features most often chosen over repeated imputation and selection (runs jobs)."""
    coded = recode(with_lactate_name(wide), cfg.codes)
    columns = column_range(coded.columns, first, last, allowed)
    rows = filter_target_cohort(filter_complete_rows(coded, columns, cfg.completeness), cfg.target)
    rows = cut_lineage(rows.select(cfg.key, *columns, F.col(cfg.target).cast("double").alias(cfg.target)), "selection")
    return stable_features(rows, columns, cfg.target, key=cfg.key, seeds=seeds, top=top, max_iter=cfg.max_iter, tol=cfg.tol)


@dataclass
class Evaluation:
    accuracy: DataFrame  # model, seed, accuracy
    mean: DataFrame  # model, accuracy
    predictions: dict[str, DataFrame]  # verify rows with the first run's predictions
    confusion: dict[str, DataFrame]


def train_and_evaluate(train: DataFrame, verify: DataFrame, cfg: TrainingConfig = TrainingConfig(), *,
                       seeds: Sequence[int] = range(10), network: bool = True,
                       store: StageStore | None = None) -> Evaluation:
    """Fit every model per seed, evaluate on the verify rows and keep the first run's predictions (runs jobs)."""
    predictions: dict[str, DataFrame] = {}

    def keep(name: str, table: DataFrame) -> DataFrame:
        predictions[name] = store.write(table, f"{name}_verify") if store else cut_lineage(table, name)
        return predictions[name]

    shared = {"features": cfg.features, "target": cfg.target, "key": cfg.key, "keep": keep}
    accuracy = classify.repeated_accuracy(train, verify, seeds=seeds, **shared)
    if network:
        accuracy = accuracy.unionByName(classify.repeated_accuracy(train, verify, models=["dnn_model"], seeds=[0], **shared))
    confusion = {name: confusion_matrix(table, cfg.target, f"model_{cfg.target}") for name, table in predictions.items()}
    return Evaluation(accuracy, mean_accuracy(accuracy), predictions, confusion)
