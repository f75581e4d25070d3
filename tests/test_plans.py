"""The study flows end to end on the derived warehouse."""

import os

import pytest
from pyspark.sql import functions as F

from stayloom.operators.wide import duplicate_keys, require_unique
from stayloom.plans import fixed_values as V
from stayloom.plans import hospital, propensity, training
from stayloom.plans.icu import WIDE_COLUMNS, IcuStudy
from stayloom.session import LoopState, cut_lineage, scratch_dir
from stayloom.sources.clinical import WAREHOUSE_SCHEMAS
from stayloom.sources.roles import Roles
from stayloom.sources.tables import StageStore, TableRegistry
from verification.warehouse import HOSPITAL, WAREHOUSE, DerivedTables


@pytest.fixture(scope="module")
def study(spark, folder):
    return IcuStudy(DerivedTables(Roles(spark, folder), WAREHOUSE))


@pytest.fixture(scope="module")
def wide(study):
    return cut_lineage(study.wide(), "wide")


def test_wide_row_has_one_row_per_cohort_stay(study, wide):
    assert wide.columns == WIDE_COLUMNS and len(WIDE_COLUMNS) == 134
    assert wide.count() == study.cohort.count() == wide.select("stay_id").distinct().count()


def test_inputs_are_checked_for_fan_out(study, spark):
    study.check_inputs()
    twice = spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "a int, b int")
    assert [(r["table"], r["groups"], r["rows"]) for r in duplicate_keys({"t": (twice, ["a"]), "u": (twice.distinct(), ["a"])}
                                                                         ).collect()] == [("t", 1, 2)]
    with pytest.raises(ValueError):
        require_unique({"t": (twice, ["a"])})


def test_warehouse_from_files(spark, study, tmp_path):
    """The same views read from declared files; the declared schemas cover every input the views use."""
    used = [n for n in WAREHOUSE_SCHEMAS if n in WAREHOUSE]
    for name in used:
        types = [c.strip().rsplit(" ", 1) for c in WAREHOUSE_SCHEMAS[name].split(",")]
        study.t[name].select(*[F.col(c).cast(t).alias(c) for c, t in types]).write.parquet(f"{tmp_path}/{name}.parquet")
    files = IcuStudy(TableRegistry.from_folder(spark, str(tmp_path), {n: WAREHOUSE_SCHEMAS[n] for n in used}))
    for name in ("self_collection", "self_Glucose", "self_sepsis_co", "self_specimen_count"):
        assert files.view(name).count() == study.view(name).count()
    assert files.materialize("self_sofa24_score").count() == study.view("self_sofa24_score").count()
    spark.sql("drop table self_sofa24_score")


def test_training_flow(spark, wide, tmp_path):
    cfg = training.TrainingConfig(target="death28", features=("po2_min", "wbc_avg", "min_heart_rate", "avg_mbp", "alp_max"),
                                  completeness=0.4, max_iter=3)
    flagged = wide.withColumns({"sepsis": F.lit(True), "sepsis_ali": F.lit(True)})
    store = StageStore(spark, str(tmp_path), cfg.target)
    train, verify = training.prepare_dataset(flagged, cfg, store=store)
    for part in (train, verify):
        counts = {r["death28"]: r["count"] for r in part.groupBy("death28").count().collect()}
        assert counts[0] == counts[1]
        assert part.select(*cfg.features).dropna().count() == part.count()
        assert "name" in part.columns and "model" not in part.columns
    assert not {r[0] for r in train.select("stay_id").collect()} & {r[0] for r in verify.select("stay_id").collect()}
    result = training.train_and_evaluate(train, verify, cfg, seeds=[0], network=False, store=store)
    assert sorted(r["model"] for r in result.mean.collect()) == ["knn_model", "svm_model", "tree_model", "xgb_model"]
    table = store.read("tree_model_verify")
    assert {"model_death28", "model_real_death28"} <= set(table.columns) and table.count() == verify.count()
    assert result.confusion["tree_model"].count() == 2
    top = training.select_features(flagged, cfg, first="wbc_min", last="wbc_avg", seeds=[0, 1], top=2)
    assert {r["feature"] for r in top.collect()} <= {"wbc_min", "wbc_max", "wbc_avg"}


def test_external_verification_set(spark, folder, wide):
    tables = DerivedTables(Roles(spark, folder), HOSPITAL)
    external = hospital.external_wide(tables["icu_patient"], {a: tables[a] for a in V.ANALYTES})
    external = external.withColumn("stay_id", F.xxhash64("subject_id")).drop("subject_id")
    cfg = training.TrainingConfig(target="sepsis_aki", features=("wbc_min", "alp_max", "min_sbp"), completeness=0.3)
    data = training.clean_data(wide.withColumn("sepsis", F.lit(True)), cfg, external=external.withColumn("sepsis", F.lit("t")))
    kinds = {r["model"]: r["n"] for r in data.groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert kinds[1] > 0 and kinds[0] > 0
    assert data.filter("model = 0").filter("sepsis_aki in (0, 1)").count() == kinds[0]
    assert len(data.collect()) == kinds[0] + kinds[1]


def test_matching_flow(spark, folder):
    df = Roles(spark, folder).features().withColumn("itemids", F.when(F.col("id") % 11 == 0, F.lit("other")))
    cfg = propensity.MatchingConfig(key="id", ids=(), covariates=("f1", "f2", "f3", "f4", "f5"), dose="dose",
                                    completeness=0.8, codes={}, dose_above=0.5)
    prepared = cut_lineage(propensity.prepare_treatment(df, cfg), "prepared")
    assert prepared.filter("itemids is not null").count() == 0
    assert prepared.dropna(subset=["f1", "f2", "f3", "f4"]).count() == prepared.count()
    pairs = propensity.match_treatment(prepared, cfg)
    rows = pairs.select("id_t", "id_c", "per_day_t", "per_day_c").collect()
    assert len(rows) == prepared.filter("per_day > 0.5").count() > 0
    assert all(r["per_day_c"] is None and r["per_day_t"] > 0.5 for r in rows)


def test_scratch_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert scratch_dir(spark) == configured.rstrip("/")
    rounds = LoopState("loop")
    first = rounds.advance(spark.range(3))
    path = first.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert os.path.isdir(path)
    second = rounds.advance(first.union(first))
    assert second.count() == 6 and not os.path.exists(path)


def test_views_are_refreshed_as_one_version(study, spark, tmp_path):
    from stayloom.sources.versions import VersionedTables

    names = ["self_sepsis_ali", "self_sepsis_ali_collection", "self_icd_code_5x_counts", "self_collection", "self_death_ratio"]
    store = VersionedTables(spark, str(tmp_path / "views"))
    assert study.refresh_all(store, names).number == 1 and store.names() == sorted(names)
    for name in names:
        assert store[name].schema.names == study.view(name).columns
        assert sorted(map(str, store[name].collect())) == sorted(map(str, study.view(name).collect()))
    assert set(IcuStudy.view_names()) >= {"self_collection", "self_sepsis_ali_collection", "self_sepsis_20230822"}


def test_site_slice_makes_wide_rows_of_its_stays_only(spark, folder, monkeypatch):
    from pyspark.sql import functions as F
    from stayloom.operators import cohort as C
    from stayloom.plans import icu
    from stayloom.sources.roles import Roles
    from verification.view_queries import study

    made = []
    whole = icu.IcuStudy.wide
    monkeypatch.setattr(icu.IcuStudy, "wide", lambda self: (made.append(self.cohort.count()), whole(self))[1])

    def flags(suspicion, stays, categories):  # three stays of the cohort, one without a stay id, of which the first two pass
        ranked = stays.where("sepsis").orderBy("stay_id").limit(3).select("subject_id", "hadm_id", "stay_id").collect()
        rows = [(r[0], r[1], None if i == 1 else r[2], i == 2, 1) for i, r in enumerate(ranked)]
        return spark.createDataFrame(rows, "subject_id bigint, hadm_id bigint, stay_id bigint, pulmonary boolean, count bigint").select(
            "*", *[F.lit(False).alias(c) for c in categories if c != "pulmonary"])

    monkeypatch.setattr(icu.L, "site_flags", flags)
    a = study(Roles(spark, folder))
    got = a.view("self_sepsis_ali_20230824")
    sites = flags(None, a.cohort, icu.V.SITE_SPECIMENS).drop("count")
    want = C.flag_slice(cut(whole(a)).filter("sepsis"), sites, ~F.col("pulmonary")).select(got.columns)
    assert got.count() >= 2 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert made[0] < a.cohort.count()


def cut(df):
    from stayloom.session import cut_lineage

    return cut_lineage(df)
