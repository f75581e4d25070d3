"""Propensity scores and nearest-score matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayloom.functions.scalar import round_half_even
from stayloom.operators.prepare import number_rows
from stayloom.session import cut_lineage

ROWS_PER_BUCKET = 1_000_000


def propensity_score(df: DataFrame, covariates: Sequence[str], treatment: str, *, key: str,
                     label_mode: str = "treated", name: str = "propensity_score") -> DataFrame:
    """Add the estimated probability of treatment (fits a model).

    L2-penalised logistic regression with unit penalty on the summed loss, no scaling, no penalty on the intercept.
    ``label_mode="treated"`` models treated or not; ``"rounded_dose"`` models the half-even rounded dose as classes, numbered
    in order, and returns the probability of the second smallest class; a row without a dose is no row of the model.
    """
    if label_mode == "treated":
        labelled = df.withColumn("_label", (F.col(treatment) > 0).cast("double"))
    else:
        dose = round_half_even(F.col(treatment))
        classes = number_rows(df.select(dose.alias("_dose")).distinct().where("_dose is not null"), ["_dose"], "_label")
        labelled = df.withColumn("_dose", dose).join(cut_lineage(classes, "classes"), "_dose", "left").withColumn("_label", F.col("_label").cast("double"))
    assembler = VectorAssembler(inputCols=list(covariates), outputCol="_features", handleInvalid="error")
    # Model input is written once: the optimiser passes over it many times.
    data = cut_lineage(assembler.transform(labelled.select(key, "_label", *covariates)).select(
        key, "_label", "_features"), "propensity")
    known = data.where("_label is not null")
    n = known.count()
    model = LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_p", regParam=1.0 / n,
                               elasticNetParam=0.0, standardization=False, maxIter=100).fit(known)
    scores = model.transform(data).select(key, vector_to_array("_p")[1].alias(name))
    return df.join(scores, key)


def nearest_control(treated: DataFrame, control: DataFrame, *, key: str, score: str) -> DataFrame:
    """For each treated row the control with the nearest score, with replacement and without a caliper (runs jobs).

    Returns ``treated_key, control_key, score``; equal distances go to the smaller control key. Scores are reduced to
    distinct values first, so any number of equal scores is one point. The points are cut into score ranges of similar
    size; inside a range a running window finds the controls below and above, and the last control of earlier ranges
    (first of later ones) is carried across through a table with one row per range. Treated rows without a score (NULL or
    NaN) have no nearest control and are not in the result; controls without a score are never chosen.
    """
    wanted = treated.select(F.col(score).alias("s"), F.lit(None).cast(control.schema[key].dataType).alias("c"),
                            F.lit(True).alias("t"))
    offered = control.select(F.col(score).alias("s"), F.col(key).alias("c"), F.lit(False).alias("t"))
    points = cut_lineage(wanted.unionByName(offered).filter(F.col("s").isNotNull() & ~F.isnan("s")).groupBy("s").agg(
        F.min("c").alias("c"), F.bool_or("t").alias("t")), "scores")
    ranged = _score_ranges(points)
    point = F.when(F.col("c").isNotNull(), F.struct("s", "c"))
    carried = _carry_edges(ranged, point)
    upward = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    downward = Window.partitionBy("r").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    near = ranged.withColumns({"below": F.last(point, ignorenulls=True).over(upward),
                               "above": F.last(point, ignorenulls=True).over(downward)})
    near = near.filter("t").join(carried, "r")
    below, above = F.coalesce("below", "edge_below"), F.coalesce("above", "edge_above")
    down, up = F.col("s") - below["s"], above["s"] - F.col("s")
    take_below = above.isNull() | (down < up) | ((down == up) & (below["c"] <= above["c"]))
    best = near.select("s", F.when(below.isNotNull() & take_below, below["c"]).otherwise(above["c"]).alias("control_key"))
    return treated.select(F.col(key).alias("treated_key"), F.col(score).alias("s")).join(best, "s").select(
        "treated_key", "control_key", F.col("s").alias(score))


def _score_ranges(points: DataFrame) -> DataFrame:
    """Add the range number ``r``; the limits are approximate quantiles of the distinct scores."""
    parts = max(2, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // ROWS_PER_BUCKET))
    # Any limit gives right matches, so a table without scores may have an arbitrary one.
    limits = sorted(set(points.approxQuantile("s", [i / parts for i in range(1, parts)], 0.1 / parts))) or [0.0]
    bucketizer = Bucketizer(splits=[float("-inf"), *limits, float("inf")], inputCol="s", outputCol="r")
    return bucketizer.transform(points)


def _carry_edges(ranged: DataFrame, point: Column) -> DataFrame:
    """Per range the nearest control before it and after it (one row per range passes the driver)."""
    rows = sorted(ranged.groupBy("r").agg(F.min(point).alias("first"), F.max(point).alias("last")).collect(),
                  key=lambda row: row["r"])
    below, above = {}, {}
    seen = None
    for row in rows:
        below[row["r"]] = seen
        seen = row["last"] or seen
    seen = None
    for row in reversed(rows):
        above[row["r"]] = seen
        seen = row["first"] or seen
    kind = ranged.schema["c"].dataType.simpleString()
    edges = [(row["r"], below[row["r"]], above[row["r"]]) for row in rows]
    return ranged.sparkSession.createDataFrame(
        edges, f"r double, edge_below struct<s: double, c: {kind}>, edge_above struct<s: double, c: {kind}>")


def matched_pairs(treated: DataFrame, control: DataFrame, matches: DataFrame, *, key: str,
                  suffixes: tuple[str, str] = ("_t", "_c")) -> DataFrame:
    """Treated row and matched control side by side, columns told apart by suffix."""
    left = treated.select(*[F.col(c).alias(c + suffixes[0]) for c in treated.columns])
    right = control.select(*[F.col(c).alias(c + suffixes[1]) for c in control.columns])
    pairs = matches.select("treated_key", "control_key")
    return (left.join(pairs, F.col(key + suffixes[0]) == F.col("treated_key"))
            .join(right, F.col(key + suffixes[1]) == F.col("control_key")).drop("treated_key", "control_key"))
