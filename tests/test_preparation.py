import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayloom.operators import prepare as P
from stayloom.operators import ranks
from stayloom.sources.tables import StageStore, refresh_table, write_clustered


def test_number_rows(spark):
    rows = [(i % 5, None if i % 4 == 0 else i, "x") for i in range(40)] + [(None, 3, "y")] * 30
    df = spark.createDataFrame(rows, "a int, b int, start string").repartition(4)
    got = P.number_rows(df, ["a", "b"], "n", first=10)
    assert got.columns == ["a", "b", "start", "n"]
    ordered = sorted(got.collect(), key=lambda r: r["n"])
    assert [r["n"] for r in ordered] == list(range(10, 80))
    low = lambda v: (v is not None, v or 0)
    assert [(r["a"], r["b"]) for r in ordered] == [t[:2] for t in sorted(rows, key=lambda t: (low(t[0]), low(t[1])))]
    assert P.number_rows(df.limit(0), ["a"], "n").collect() == []


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.integers(-2**62, 2**62) | st.integers(-3, 3), min_size=1, max_size=60), data=st.data())
def test_order_statistics(spark, values, data):
    wanted = data.draw(st.lists(st.integers(1, len(values)), min_size=1, max_size=3))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = ranks.order_statistics(df, F.col("v"), lambda n: wanted)
    ordered = sorted(values)
    for rank, (value, below, equal) in zip(wanted, got):
        assert value == ordered[rank - 1]
        assert below == sum(v < value for v in values) and equal == values.count(value)


def test_order_statistics_in_many_passes(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SLICES", 3)
    values = [int(v) for v in np.random.default_rng(0).integers(-10**12, 10**12, 500)] + [5] * 200
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = ranks.order_statistics(df, F.col("v"), lambda n: [1, 350, n])
    assert [g[0] for g in got] == [min(values), sorted(values)[349], max(values)]


@pytest.mark.parametrize("values", [[-2**63, 2**63 - 1], [-2**62, 2**62, 0, 0], [-2**63, -2**63, -1, 1, 2**63 - 2, 2**63 - 1, 2**63 - 1]])
def test_order_statistics_at_both_ends_of_bigint(spark, monkeypatch, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    every = list(range(1, len(values) + 1))
    for slices in (4096, 2):
        monkeypatch.setattr(ranks, "SLICES", slices)
        assert [g[0] for g in ranks.order_statistics(df, F.col("v"), lambda n: every)] == sorted(values)


def test_cut_breaks_ties_by_the_next_column(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (1, 4), (2, 1), (0, 9)], "a long, b long")
    order = [F.col("a"), F.col("b")]
    cut = ranks.rank_cut(df, order, rows=lambda n: 3)
    assert sorted(map(tuple, df.filter(cut.upto(order)).collect())) == [(0, 9), (1, 3), (1, 4)]
    for rows, count in ((0, 0), (5, 5), (9, 5)):
        assert df.filter(ranks.rank_cut(df, order, rows=lambda n: rows).upto(order)).count() == count
    with pytest.raises(ValueError):
        twice = df.unionByName(df)
        ranks.rank_cut(twice, order, rows=lambda n: 3)


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_split_is_exact_and_complete(spark, n):
    df = spark.range(n)
    train, verify = P.split_exact(df, key="id", fraction=0.8, seed=1987)
    a, b = {r[0] for r in train.collect()}, {r[0] for r in verify.collect()}
    assert len(a) == round(0.8 * n) and not a & b and len(a | b) == n
    again, _ = P.split_exact(df.repartition(7), key="id", fraction=0.8, seed=1987)
    assert {r[0] for r in again.collect()} == a


@pytest.mark.parametrize("labels", [[1] * 30 + [0] * 11, [0] * 9 + [1] * 3 + [None] * 5, [1] * 4, [1, 0]])
def test_balance(spark, labels):
    df = spark.createDataFrame(list(enumerate(labels)), "id long, y int")
    positive = sum(1 for v in labels if v)
    smaller = min(positive, len(labels) - positive)
    rows = P.balance_undersample(df, "y", key="id").collect()
    assert sum(1 for r in rows if r["y"]) == smaller and len(rows) == 2 * smaller


def test_completeness_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.0, None), (2, 1.0, 1.0, 1.0, None, None)],
                               "id int, a double, b double, c double, d double, e double")
    assert [r["id"] for r in P.filter_complete_rows(df, list("abcde"), 0.8).collect()] == [1]


def test_columns(spark):
    df = spark.range(2).select("id", F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit(3).alias("c"))
    assert P.column_range(df.columns, "a", "c", {"a", "c", "id"}) == ["a", "c"]
    assert P.add_missing_columns(df, ["a", "name"]).first()["name"] == ""
    flagged = P.concat_flagged(df, df)
    assert sorted(r["model"] for r in flagged.collect()) == [0, 0, 1, 1]


def test_stage_and_refresh(spark, tmp_path):
    store = StageStore(spark, str(tmp_path), "death28")
    back = store.write(spark.range(5), "train")
    assert back.count() == 5 and store.read("train").count() == 5 and store.path("train").endswith("death28-train")
    first = refresh_table(spark.range(3), "t_refresh", str(tmp_path / "v1"))
    second = refresh_table(first.union(spark.range(3)), "t_refresh", str(tmp_path / "v2"))
    assert second.count() == 6 == spark.table("t_refresh").count()
    spark.sql("drop table t_refresh")


def test_clustered_log_spreads_a_hot_item(spark, tmp_path):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("itemid"),
                                    F.col("id").alias("at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the data is tiny
    try:
        write_clustered(df.repartition(6), str(tmp_path / "log"), ["itemid", "at"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 30_000
    assert back.filter("itemid = 7").select(F.input_file_name()).distinct().count() > 1


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, 1.0), (2, 0.0, nan), (3, 0.0, 2.0), (4, 0.0, 3.0), (5, 1.0, 4.0)], "id int, t double, v double")
    assert P.filter_complete_rows(df, ["t", "v"], 1.0).count() == 3
    assert P.filter_target_cohort(df.withColumnRenamed("t", "sepsis"), "sepsis").count() == 4
    kept = [r.t for r in P.balance_undersample(df, "t", key="id").collect()]
    assert len(kept) == 2 and kept.count(1.0) == 1
    from stayloom.operators.impute import cell_summary, mean_fill
    assert {r["column"]: r["filled"] for r in cell_summary(df, ["t", "v"]).collect()} == {"t": 4, "v": 4}
    assert [r.v for r in mean_fill(df, ["v"]).orderBy("id").collect()] == [1.0, 2.5, 2.0, 3.0, 4.0]


def test_refreshed_table_lies_outside_the_scratch_folder(spark):
    from stayloom.session import scratch_dir
    refresh_table(spark.range(3).toDF("n"), "kept_table")
    refresh_table(spark.table("kept_table").union(spark.range(2).toDF("n")), "kept_table")
    place = spark.sql("DESCRIBE FORMATTED kept_table").where("col_name = 'Location'").first()["data_type"]
    assert scratch_dir(spark) not in place and spark.table("kept_table").count() == 5
    spark.sql("DROP TABLE kept_table")


def test_versions_switch_together_and_fail_whole(spark, tmp_path):
    from stayloom.sources.versions import CommitConflict, VersionedTables

    store = VersionedTables(spark, str(tmp_path / "tables"))
    assert store.names() == [] and store.manifest().number == 0
    store.write({"a": spark.range(3).toDF("n"), "b": spark.range(2).toDF("m")})
    doubled = store.update("a", "n", F.col("n") * 2)  # reads the table it replaces
    assert sorted(r.n for r in doubled.collect()) == [0, 2, 4] and sorted(r.n for r in store.read("a", 1).collect()) == [0, 1, 2]
    assert store.versions() == [1, 2] and store["b"].count() == 2

    batch = store.batch()
    batch.write("a", spark.range(9).toDF("n"))
    with pytest.raises(Exception):
        batch.write("b", spark.range(3).select(F.raise_error(F.lit("broken")).alias("m")))
    assert store.manifest().number == 2 and store["a"].count() == 3  # nothing of a broken batch is seen

    one, two, other = store.batch(), store.batch(), store.batch()
    one.write("a", spark.range(1).toDF("n"))
    two.write("a", spark.range(2).toDF("n"))
    other.write("c", spark.range(4).toDF("k"))
    one.commit()
    with pytest.raises(CommitConflict):
        two.commit()
    assert other.commit().number == 4 and store["a"].count() == 1 and store.names() == ["a", "b", "c"]
    gone = store.remove_before(4)
    assert len(gone) == 2 and store.versions() == [4] and [store[n].count() for n in store.names()] == [1, 2, 4]
    with pytest.raises(KeyError):
        store.read("a", 1)


def test_failed_refresh_keeps_the_old_table(spark, monkeypatch):
    refresh_table(spark.range(3).toDF("n"), "kept_on_failure")
    sql = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, q, *a, **k: 1 / 0 if q.endswith("RENAME TO kept_on_failure") and "_fresh_" in q else sql(self, q, *a, **k))
    with pytest.raises(ZeroDivisionError):
        refresh_table(spark.range(5).toDF("n"), "kept_on_failure")
    monkeypatch.undo()
    assert spark.table("kept_on_failure").count() == 3
    spark.sql("drop table kept_on_failure")
