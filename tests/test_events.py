from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayloom.operators.events import (
    ADMISSION_KEYS,
    STAY_KEYS,
    attribute_stats,
    combine_items,
    event_stats,
    horizon_window,
    interval_join,
    multi_window_stats,
    spread_items,
    stay_window,
    windowed_column_stats,
)
from stayloom.operators.labels import site_flags
from stayloom.operators.windows import open_window, windowed_aggregate

T0 = datetime(2024, 3, 10, 12, 0, 0)
STAYS = "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz"
LABS = "subject_id long, hadm_id long, itemid long, charttime timestamp_ntz, valuenum double"


def stays(spark, *rows):
    return spark.createDataFrame(rows or [(1, 10, 100, T0, T0 + timedelta(days=4))], STAYS)


def labs(spark, *offsets):
    rows = [(1, 10, 7, T0 + delta, float(i)) for i, delta in enumerate(offsets)]
    return spark.createDataFrame(rows, LABS)


H = timedelta(hours=1)
US = timedelta(microseconds=1)


@pytest.mark.parametrize("delta, inside", [
    (-6 * H, True), (-6 * H - US, False), (24 * H, True), (24 * H + US, False), (24 * H + timedelta(minutes=59), False),
    (timedelta(0), True)])
def test_day_window_bounds(spark, delta, inside):
    found = event_stats(stays(spark), labs(spark, delta), window=horizon_window(6, 24)).count()
    assert found == (1 if inside else 0)


def test_stay_window_ends_with_the_stay(spark):
    got = event_stats(stays(spark), labs(spark, -6 * H, 96 * H, 96 * H + US), window=stay_window()).first()
    assert (got["min_value"], got["max_value"]) == (0.0, 1.0)


def test_strict_bounds(spark):
    pairs = interval_join(stays(spark), labs(spark, timedelta(0), US, 96 * H - US, 96 * H), keys=ADMISSION_KEYS,
                          window=(F.col("intime"), F.col("outtime")), strict=True)
    assert sorted(r["valuenum"] for r in pairs.collect()) == [1.0, 2.0]


def test_no_window_for_unknown_or_reversed_times(spark):
    odd = stays(spark, (1, 10, 100, T0, None), (1, 10, 101, T0, T0 - timedelta(days=3)), (1, 10, 102, None, T0))
    assert interval_join(odd, labs(spark, -24 * H, timedelta(0)), keys=ADMISSION_KEYS,
                         window=(F.col("intime"), F.col("outtime"))).count() == 0


def test_null_keys_and_values(spark):
    log = spark.createDataFrame([(1, None, 7, T0, 1.0), (1, 10, 7, T0, None), (1, 10, 8, None, 3.0)], LABS)
    got = event_stats(stays(spark), log, window=horizon_window()).collect()
    assert [(r["itemid"], r["min_value"], r["avg_value"]) for r in got] == [(7, None, None)]


def test_overlapping_stays_share_events_without_loss(spark):
    rows = [(1, 10, s, T0 + s * H, T0 + (s + 60) * H) for s in range(20)]
    deltas = [timedelta(minutes=37 * i) for i in range(-20, 200)]
    got = {r["stay_id"]: r["max_value"] for r in event_stats(
        stays(spark, *rows), labs(spark, *deltas), window=stay_window()).collect()}
    for s in range(20):
        low, high = (s - 6) * H, (s + 60) * H
        assert got[s] == max(float(i) for i, d in enumerate(deltas) if low <= d <= high)


def test_one_pass_equals_single_items_and_windows(spark):
    rows = [(1, 10, 100, T0, T0 + 50 * H), (1, 10, 101, T0 + 40 * H, T0 + 90 * H), (2, 20, 200, T0, T0 + 30 * H)]
    log = spark.createDataFrame(
        [(1 + i % 2, 10 + 10 * (i % 2), i % 3, T0 + timedelta(minutes=41 * i - 600), float(i * 7 % 50)) for i in range(200)],
        LABS)
    base = stays(spark, *rows)
    both = multi_window_stats(base, log, windows={"day": horizon_window(), "stay": stay_window()})
    for name, window in {"day": horizon_window(), "stay": stay_window()}.items():
        for item in range(3):
            one = event_stats(base, log, window=window, items=[item])
            shared = both.filter((F.col("itemid") == item) & (F.col(f"{name}_n") > 0)).select(
                *STAY_KEYS, "itemid", *[F.col(f"{name}_{s}_value").alias(f"{s}_value") for s in ("min", "max", "avg")])
            assert sorted(map(tuple, one.collect())) == sorted(map(tuple, shared.collect()))


def test_combined_average_is_of_minima(spark):
    log = spark.createDataFrame([(1, 10, 1, T0, 2.0), (1, 10, 1, T0, 4.0), (1, 10, 2, T0, 10.0), (1, 10, 2, T0, 30.0)], LABS)
    stats = event_stats(stays(spark), log, window=horizon_window())
    got = combine_items(stats).first()
    assert (got["g_min_value"], got["g_max_value"], got["g_avg_value"]) == (2.0, 30.0, 6.0)
    assert combine_items(stats, avg_of="avg_value").first()["g_avg_value"] == 11.5
    wide = spread_items(stats, {"both": [1, 2], "single": [2]}, avg_of_feature={"both": "avg_value"}).first()
    assert (wide["both_avg"], wide["single_avg"], wide["single_min"]) == (11.5, 20.0, 10.0)


def test_column_and_attribute_stats(spark):
    table = labs(spark, timedelta(0), H, 30 * H).withColumn("twice", F.col("valuenum") * 2)
    got = windowed_column_stats(stays(spark), table, ["valuenum", "twice"], window=horizon_window()).first()
    assert (got["valuenum_max"], got["twice_avg"]) == (1.0, 1.0)
    two = stays(spark, (1, 10, 100, T0, T0), (9, 90, 900, T0, T0))
    got = {r["stay_id"]: r["valuenum_max"] for r in attribute_stats(two, table, ["valuenum"]).collect()}
    assert got == {100: 2.0, 900: None}


def test_site_flags_wildcard_and_empty(spark):
    base = stays(spark, (1, 10, 100, T0, T0 + 48 * H), (1, 10, 101, T0 + 24 * H, T0 + 72 * H))
    rows = [(1, 10, 100, "A", T0 + H), (1, 10, None, "B", T0 + 30 * H), (1, 10, 101, "A", T0 + H),
            (1, 10, 101, None, T0 + 30 * H), (2, 20, None, "A", T0)]
    soi = spark.createDataFrame(
        rows, "subject_id long, hadm_id long, stay_id long, specimen string, suspected_infection_time timestamp_ntz")
    got = {r["stay_id"]: (r["count"], r["a"], r["b"]) for r in site_flags(soi, base, {"a": ["A"], "b": ["B"]}).collect()}
    # the record without stay id meets both overlapping stays; an unknown specimen decides no flag
    assert got == {100: (1, True, False), None: (2, False, True), 101: (1, None, None)}


def test_hot_day_is_split_by_adaptive_execution(spark):
    """Two thirds of the events on one day of one patient: the join on it is split into several tasks."""
    # one patient of several is hot
    hot = spark.range(400_000).select(
        F.lit(1).cast("long").alias("subject_id"), F.lit(10).cast("long").alias("hadm_id"), F.lit(7).alias("itemid"),
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 30000).cast(
            "decimal(18,6)"))).alias("charttime"), F.rand(1).alias("valuenum"))
    rest = spark.range(200_000).select(
        (2 + F.col("id") % 500).alias("subject_id"), (20 + F.col("id") % 500).alias("hadm_id"), F.lit(7).alias("itemid"),
        F.lit(T0).cast("timestamp_ntz").alias("charttime"), F.rand(2).alias("valuenum"))
    many = spark.range(1, 502).select(
        F.col("id").alias("subject_id"), F.when(F.col("id") == 1, 10).otherwise(18 + F.col("id")).cast("long").alias("hadm_id"),
        F.col("id").alias("stay_id"), F.lit(T0).cast("timestamp_ntz").alias("intime"),
        F.lit(T0 + 48 * H).cast("timestamp_ntz").alias("outtime"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = event_stats(many, hot.unionByName(rest), window=horizon_window(0, 24))
        rows = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 501
    assert "isSkew=true" in plan or "skew=true" in plan or "skewed" in plan


@pytest.mark.parametrize("items", [["itemid"], []])
def test_crowded_days_equal_the_direct_way(spark, items):
    """Nested blocks and pairs give the same statistics, with several windows and NULL values."""
    import random

    rng = random.Random(5)
    rows = []
    for s in range(120):
        begin = T0 + timedelta(microseconds=rng.randrange(3 * 86_400_000_000))
        subject = 1 if s < 90 else 2 + s % 3
        rows.append((subject, subject * 10, s, begin, begin + timedelta(microseconds=rng.randrange(1, 2 * 86_400_000_000))))
    base = stays(spark, *rows)
    log = []
    for i in range(600):
        subject = 1 if i % 3 else 2 + i % 4
        at = T0 + timedelta(microseconds=rng.randrange(5 * 86_400_000_000)) if i % 5 else rows[i % 120][3 + i % 2]
        log.append((subject, subject * 10, i % 3, at, None if i % 17 == 0 else float(rng.randrange(1000))))
    events = spark.createDataFrame(log, LABS)
    windows = {"day": horizon_window(), "stay": stay_window(0)}
    options = dict(rows=STAY_KEYS, keys=ADMISSION_KEYS, windows=windows, values=["valuenum"], by=items)
    direct = windowed_aggregate(base, events, crowded=10**9, **options)
    nested = windowed_aggregate(base, events, crowded=0, **options).select(*direct.columns)
    mixed = windowed_aggregate(base, events, crowded=40, **options).select(*direct.columns)
    want = sorted(map(str, direct.collect()))
    assert len(want) > 100
    assert sorted(map(str, nested.collect())) == want
    assert sorted(map(str, mixed.collect())) == want


def test_open_window_excludes_its_bounds(spark):
    got = windowed_aggregate(stays(spark), labs(spark, timedelta(0), US, 96 * H - US, 96 * H), rows=STAY_KEYS,
                             keys=ADMISSION_KEYS, windows={"w": open_window((F.col("intime"), F.col("outtime")))},
                             values=["valuenum"], crowded=0).first()
    assert (got["w_rows"], got["w_valuenum_sum"]) == (2, 3.0)
