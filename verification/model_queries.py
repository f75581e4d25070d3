"""Preparation, imputation, selection, matching, classification and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.operators import classify, evaluate, impute, match, prepare, select
from stayloom.operators.neighbours import knn_classify
from stayloom.plans import propensity, training
from stayloom.session import cut_lineage
from stayloom.sources.roles import Roles
from verification.registry import query, r8, r8_all

COLUMNS = ["f1", "f2", "f3", "f4", "f5"]
COVARIATES = ["f1", "f2", "f3", "f4", "f5"]
SPLIT = "round_even(0.8 * (select count(*) from r_features), 0)"
RANKED = f"""select *, row_number() over (order by md5(id || '-1987')) <= {SPLIT} is_train from r_features"""
COMPLETE = "select id, label, " + ", ".join(
    f"round(coalesce({c}, (select avg({c}) from r_features)), 8) {c}" for c in COLUMNS) + " from r_features"


def complete(r: Roles) -> DataFrame:
    """Every row, missing cells filled with their column's mean."""
    return r8_all(impute.mean_fill(r.features().select("id", *COLUMNS, "label"), COLUMNS), *COLUMNS)


def split(df: DataFrame, seed: int = 1987) -> tuple[DataFrame, DataFrame]:
    return prepare.split_exact(df, key="id", fraction=0.8, seed=seed)


@query("split_train", "select id, label from ranked where is_train", ranked=RANKED)
def split_train(r: Roles) -> DataFrame:
    return split(cut_lineage(r.features().select("id", "label")))[0]


@query("split_anti", "select id, label from ranked where not is_train", ranked=RANKED)
def split_anti(r: Roles) -> DataFrame:
    """The rows the sample left over: the complement of the same cut, no join."""
    return split(cut_lineage(r.features().select("id", "label")))[1]


@query("balance_undersample", """
    select id, label from (select *, row_number() over (partition by coalesce(label > 0.5, false) order by md5(id || '-0')) i
        from r_features)
    where i <= (select least(count(*) filter (where coalesce(label > 0.5, false)),
                             count(*) filter (where not coalesce(label > 0.5, false))) from r_features)""")
def balance_undersample(r: Roles) -> DataFrame:
    return prepare.balance_undersample(cut_lineage(r.features().select("id", "label")), "label", key="id")


@query("impute_mean_init", "select id, " + ", ".join(
    f"round(coalesce({c}, (select avg({c}) from r_features)), 8) {c}" for c in COLUMNS) + " from r_features")
def impute_mean_init(r: Roles) -> DataFrame:
    return r8_all(impute.mean_fill(r.features().select("id", *COLUMNS), COLUMNS), *COLUMNS)


@query("imputation_check", " union all ".join(
    f"select '{c}' \"column\", count(*) \"rows\", count({c}) filled_before, count(*) filled_after from r_features"
    for c in COLUMNS))
def imputation_check(r: Roles) -> DataFrame:
    before = r.features().select("id", *COLUMNS)
    after = impute.mean_fill(before, COLUMNS)
    a = impute.cell_summary(before, COLUMNS).withColumnRenamed("filled", "filled_before")
    b = impute.cell_summary(after, COLUMNS).select("column", F.col("filled").alias("filled_after"))
    return a.join(b, "column")


@query("impute_iterative")
def impute_iterative(r: Roles) -> DataFrame:
    return impute.iterative_impute(r.features().select("id", *COLUMNS, "label"), COLUMNS, key="id", max_iter=100, tol=0.1)


@query("propensity_score")
def propensity_score(r: Roles) -> DataFrame:
    df = impute.mean_fill(r.features(), COVARIATES)
    dosed = df.withColumn("per_day", F.coalesce(F.col("dose") / F.col("stay_day"), F.lit(0.0)))
    return match.propensity_score(dosed, COVARIATES, "per_day", key="id").select("id", "per_day", "propensity_score")


PER_DAY = "select id, coalesce(dose / stay_day, 0) per_day from r_features"


def dosed(r: Roles) -> DataFrame:
    df = impute.mean_fill(r.features(), COVARIATES)
    return df.withColumn("per_day", F.coalesce(F.col("dose") / F.col("stay_day"), F.lit(0.0)))


@query("propensity_balance", "select count(*) filter (where per_day > 0) expected, count(*) n from doses", doses=PER_DAY)
def propensity_balance(r: Roles) -> DataFrame:
    """At the optimum the scores add up to the treated rows, since the intercept is free of the penalty."""
    scores = match.propensity_score(dosed(r), COVARIATES, "per_day", key="id")
    return scores.agg(F.round(F.sum("propensity_score")).cast("bigint").alias("expected"), F.count("*").alias("n"))


@query("propensity_dose", """select count(*) filter (where place = 2) expected, count(*) n, max(place) classes
    from (select dense_rank() over (order by round_even(per_day, 0)) place from doses)""", doses=PER_DAY)
def propensity_dose(r: Roles) -> DataFrame:
    """Rounded doses as classes: the probabilities of the second class add up to its rows."""
    df = dosed(r)
    scores = match.propensity_score(df, COVARIATES, "per_day", key="id", label_mode="rounded_dose")
    return scores.agg(F.round(F.sum("propensity_score")).cast("bigint").alias("expected"), F.count("*").alias("n"),
                      F.count_distinct(F.rint("per_day")).alias("classes"))


SCORED = "select id, f5 / 500000 score, f1, dose from r_features"
MATCHED = """select t.id treated_key, arg_min(c.id, row(abs(t.score - c.score), c.id)) control_key, any_value(t.score) score
    from (select * from scored where dose > 0) t, (select * from scored where dose is null) c group by t.id"""


def scored_groups(r: Roles) -> tuple[DataFrame, DataFrame]:
    df = r.features().select("id", (F.col("f5") / 500000).alias("score"), "f1", "dose")
    return df.filter("dose > 0"), df.filter("dose is null")


@query("psm_match", "select treated_key, control_key, score from matched", scored=SCORED, matched=MATCHED)
def psm_match(r: Roles) -> DataFrame:
    treated, control = scored_groups(r)
    return match.nearest_control(treated, control, key="id", score="score")


@query("psm_pairs", """select t.id id_t, t.score score_t, t.f1 f1_t, t.dose dose_t, c.id id_c, c.score score_c, c.f1 f1_c,
    c.dose dose_c from matched m join scored t on t.id = m.treated_key join scored c on c.id = m.control_key""",
       scored=SCORED, matched=MATCHED)
def psm_pairs(r: Roles) -> DataFrame:
    treated, control = scored_groups(r)
    found = match.nearest_control(treated, control, key="id", score="score")
    return match.matched_pairs(treated, control, found, key="id")


@query("lasso_select")
def lasso_select(r: Roles) -> DataFrame:
    df = cut_lineage(complete(r))
    return select.lasso_table(df, select.lasso_cv(df, COLUMNS, "label", key="id"), 10)


@query("lasso_vote")
def lasso_vote(r: Roles) -> DataFrame:
    """Ten imputations with different predictor draws, one selection each, then the vote."""
    df = cut_lineage(r.features().select("id", *COLUMNS, "label"))
    return select.stable_features(df, COLUMNS, "label", key="id", max_iter=100, tol=0.1)


KNN = {
    "complete": COMPLETE,
    "parts": """select *, row_number() over (order by md5(id || '-1987')) <=
                round_even(0.8 * (select count(*) from complete), 0) is_train from complete""",
    "nearest": """select q.id, unnest(min_by(t.label, row(
            (q.f1 - t.f1) * (q.f1 - t.f1) + (q.f2 - t.f2) * (q.f2 - t.f2) + (q.f3 - t.f3) * (q.f3 - t.f3)
            + (q.f4 - t.f4) * (q.f4 - t.f4) + (q.f5 - t.f5) * (q.f5 - t.f5), t.id), 16)) vote
        from (select * from parts where not is_train) q, (select * from parts where is_train) t group by q.id""",
}


@query("knn_classify", "select id, avg(vote) vote, (avg(vote) > 0.5)::int prediction from nearest group by id", **KNN)
def knn_query(r: Roles) -> DataFrame:
    train, verify = split(cut_lineage(complete(r)))
    return knn_classify(train, verify, features=COLUMNS, key="id", label="label", k=16)


def model_table(r: Roles, name: str) -> DataFrame:
    train, verify = split(cut_lineage(complete(r)))
    predicted = classify.MODELS[name](train, verify, features=COLUMNS, label="label", key="id")
    return classify.attach_predictions(verify.select("id", "label"), predicted, key="id", target="label")


@query("gbt_classify")
def gbt_classify(r: Roles) -> DataFrame:
    return model_table(r, "xgb_model")


@query("svm_rbf_classify")
def svm_rbf_classify(r: Roles) -> DataFrame:
    return model_table(r, "svm_model")


@query("tree_classify")
def tree_classify(r: Roles) -> DataFrame:
    return model_table(r, "tree_model")


@query("mlp_classify")
def mlp_classify(r: Roles) -> DataFrame:
    return model_table(r, "dnn_model")


@query("predictions_table")
def predictions_table(r: Roles) -> DataFrame:
    """Verify rows with class and raw output of every model; of the repeated ones, from the first run."""
    train, verify = split(cut_lineage(complete(r)))
    base = verify.select("id", "label")
    parts = []
    for name in classify.MODELS:
        predicted = classify.MODELS[name](train, verify, features=COLUMNS, label="label", key="id", seed=0)
        parts.append(classify.attach_predictions(base, predicted, key="id", target="label").select(
            "*", F.lit(name).alias("model")))
    return reduce(DataFrame.unionByName, parts)


RULE = "select id, label, case when coalesce(f1, 25) + 100 * coalesce(f3, 0.05) > 30 then 1 else 0 end pred from r_features"


def rule_predictions(r: Roles) -> DataFrame:
    """A closed-form prediction, so that the evaluation itself can be compared."""
    signal = F.coalesce("f1", F.lit(25.0)) + 100 * F.coalesce("f3", F.lit(0.05))
    return r.features().select("id", "label", F.when(signal > 30, 1).otherwise(0).alias("pred"))


@query("accuracy", "select round(avg((label = pred)::int::double) * 100, 8) accuracy from rule", rule=RULE)
def accuracy(r: Roles) -> DataFrame:
    return rule_predictions(r).agg(r8(evaluate.accuracy_percent(F.col("label"), F.col("pred"))).alias("accuracy"))


@query("accuracy_mean", """select model, round(avg(accuracy), 8) accuracy from (select 'rule' model, id % 10 seed,
    avg((label = pred)::int::double) * 100 accuracy from rule group by all) group by model""", rule=RULE)
def accuracy_mean(r: Roles) -> DataFrame:
    runs = rule_predictions(r).groupBy(F.lit("rule").alias("model"), (F.col("id") % 10).alias("seed")).agg(
        evaluate.accuracy_percent(F.col("label"), F.col("pred")).alias("accuracy"))
    return r8_all(evaluate.mean_accuracy(runs), "accuracy")


@query("confusion_matrix", """select label truth, count(*) filter (where pred = 0) predicted_0,
    count(*) filter (where pred = 1) predicted_1 from rule group by label""", rule=RULE)
def confusion_matrix(r: Roles) -> DataFrame:
    return evaluate.confusion_matrix(rule_predictions(r), "label", "pred")


@query("assemble_features", "select id, label, [" + ", ".join(f"{c}::double" for c in COLUMNS) + "] features from complete",
       complete=COMPLETE)
def assemble_features(r: Roles) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return classify.assemble_features(complete(r), COLUMNS, label="label", key="id").select(
        "id", "label", vector_to_array("features").alias("features"))


@query("prepare_dataset")
def prepare_dataset(r: Roles) -> DataFrame:
    """Completeness, cohort, split, joint imputation and balancing; train rows (1) and verify rows (0) together."""
    df = r.features().select("id", *COLUMNS, "label", F.lit(1).alias("sepsis"))
    cfg = training.TrainingConfig(key="id", target="label", features=COLUMNS, extra=("name",), codes={})
    train, verify = training.prepare_dataset(df, cfg)
    return prepare.concat_flagged(train, verify)


@query("clean_external", "select id, " + ", ".join(COLUMNS) + ", label, (id % 2 = 0)::int model from r_features where ("
       + " + ".join(f"({c} is not null)::int" for c in COLUMNS) + ") >= 4")
def clean_external(r: Roles) -> DataFrame:
    """All eligible rows of one source as train rows, against those of another, which lacks a column of the first."""
    df = r.features().select("id", *COLUMNS, "label", F.lit(1).alias("sepsis"))
    cfg = training.TrainingConfig(key="id", target="label", features=COLUMNS, extra=("name", "ward"), codes={}, completeness=0.8)
    internal, external = df.where("id % 2 = 0").withColumn("ward", F.lit(3)), df.where("id % 2 = 1")
    return training.clean_data(internal, cfg, external).select("id", *COLUMNS, "label", "model")


@query("matching_flow")
def matching_flow(r: Roles) -> DataFrame:
    """Treatment table to matched pairs in one go."""
    df = r.features().withColumn("itemids", F.when(F.col("id") % 11 == 0, F.lit("other")))
    cfg = propensity.MatchingConfig(key="id", ids=(), covariates=COVARIATES, dose="dose", completeness=0.8, codes={},
                                    dose_above=0.5)
    return propensity.match_treatment(propensity.prepare_treatment(df, cfg), cfg)
