import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayloom.operators import classify, evaluate, impute, match, neighbours, select
from stayloom.operators.moments import group_moments
from stayloom.operators.neighbours import k_nearest, knn_classify


def frame(spark, array, columns, start=0):
    rows = [(start + i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(array)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in columns))


# --- moments ------------------------------------------------------------------------------------------------------

def test_moments(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 10, 100] + [5, -50, 1e5]
    df = frame(spark, x, "abc").repartition(5)
    parts = group_moments(df, list("abc"), group=F.col("id") % 3, shift=[5, -50, 1e5])
    assert sorted(parts) == [0, 1, 2]
    total = parts[0] + parts[1] + parts[2]
    assert total.n == 300
    np.testing.assert_allclose(total.mean, x.mean(0), rtol=1e-12)
    np.testing.assert_allclose(total.centered() / 299, np.cov(x.T), rtol=1e-9)
    np.testing.assert_allclose((total - parts[1]).correlation(), np.corrcoef(x[np.arange(300) % 3 != 1].T), rtol=1e-9)


# --- imputation ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def holes():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 2))
    x = np.column_stack([base[:, 0], base[:, 1], base[:, 0] * 2 + base[:, 1] + rng.normal(size=400) * 0.05,
                         base[:, 0] - base[:, 1] + rng.normal(size=400) * 0.05, rng.normal(size=400)])
    gaps = rng.random(x.shape) < 0.15
    gaps[:, 4] = False
    holed = x.copy()
    holed[gaps] = np.nan
    return x, holed, gaps


@pytest.mark.parametrize("seed", [None, 0])
def test_imputation_changes_only_missing_cells(spark, holes, seed):
    x, holed, gaps = holes
    df = frame(spark, holed, "abcde").withColumn("other", F.lit("kept"))
    out = impute.iterative_impute(df, list("abcde"), key="id", max_iter=6, tol=0.01, seed=seed)
    assert out.columns == df.columns
    got = np.array([[r[c] for c in "abcde"] for r in out.orderBy("id").collect()], dtype=float)
    assert got.shape == x.shape and not np.isnan(got).any()
    np.testing.assert_array_equal(got[~gaps], x[~gaps])
    # far better than the mean for the columns that follow from others
    for j in (2, 3):
        miss = gaps[:, j]
        assert np.abs(got[miss, j] - x[miss, j]).mean() < 0.6 * np.abs(np.nanmean(holed[:, j]) - x[miss, j]).mean()
    impute.check_imputed(df, out, list("abcde"))


def test_imputation_is_deterministic_and_seeded(spark, holes):
    df = frame(spark, holes[1], "abcde")
    def run(seed, parts):
        out = impute.iterative_impute(df.repartition(parts), list("abcde"), key="id", max_iter=2, tol=1e-6, seed=seed, nearest=1)
        return np.array([[r[c] for c in "abcde"] for r in out.orderBy("id").collect()])
    first = run(1, 3)
    np.testing.assert_allclose(first, run(1, 6), rtol=1e-8)
    assert np.abs(first - run(2, 3)).max() > 1e-3


def test_imputation_rejects_empty_columns_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None)], "id long, a double, b double")
    with pytest.raises(impute.ImputationError):
        impute.iterative_impute(df, ["a", "b"], key="id")
    with pytest.raises(impute.ImputationError):
        impute.mean_fill(df, ["a", "b"])
    with pytest.raises(impute.ImputationError):
        impute.check_imputed(df, df, ["b"])
    nan = spark.createDataFrame([(i, float(i), float("nan") if i == 3 else 2.0 * i) for i in range(10)], "id long, a double, b double")
    got = impute.iterative_impute(nan, ["a", "b"], key="id", seed=None).filter("id = 3").first()
    assert abs(got["b"] - 6) < 0.2


def test_bayesian_ridge_approaches_least_squares():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=5000) * 0.1
    xc, yc = x - x.mean(0), y - y.mean()
    coef = impute.bayesian_ridge(xc.T @ xc, xc.T @ yc, yc @ yc, 5000)
    np.testing.assert_allclose(coef, [1.0, -2.0, 0.5], atol=0.01)


# --- lasso --------------------------------------------------------------------------------------------------------

def test_lasso_optimality_and_cv(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)) * [1, 5, 1, 1, 20, 1]
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=400)
    columns = ["a", "b", "c", "d", "e", "f"]
    df = frame(spark, np.column_stack([x, y]), [*columns, "y"]).repartition(4)
    fit = select.lasso_cv(df, columns, "y", key="id")
    xc, yc = x - x.mean(0), y - y.mean()
    gradient = xc.T @ (yc - xc @ fit.coef) / 400
    on = np.abs(fit.coef) > 0
    np.testing.assert_allclose(gradient[on], fit.alpha * np.sign(fit.coef[on]), rtol=1e-4, atol=1e-7)
    assert (np.abs(gradient[~on]) <= fit.alpha * (1 + 1e-6)).all()
    assert fit.selected(2) == ["b", "a"] or fit.selected(2) == ["a", "b"]
    # cross-validation error of one alpha computed directly on contiguous folds
    a = 40
    errors = []
    for f in range(5):
        test = np.arange(400) // 80 == f
        xt, yt = x[~test], y[~test]
        c = xt - xt.mean(0)
        w = select.soft_threshold_descent(c.T @ c, c.T @ (yt - yt.mean()), 320 * fit.alphas[a], np.zeros(6))
        errors.append(((y[test] - yt.mean() - (x[test] - xt.mean(0)) @ w) ** 2).mean())
    np.testing.assert_allclose(fit.cv_error[a], np.mean(errors), rtol=1e-5)
    table = select.lasso_table(df, fit, 3).collect()
    assert [r["rank"] for r in table] == list(range(len(table)))


def test_feature_vote_breaks_ties_by_first_seen(spark):
    picks = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, "c")], "pos int, feature string")
    got = select.feature_vote(picks, top=2, seen=F.col("pos"))
    assert [r["feature"] for r in got.collect()] == ["b", "a"]


# --- propensity ---------------------------------------------------------------------------------------------------

def brute_match(treated, control):
    return {t: min(control, key=lambda c: (abs(s - c[1]), c[0]))[0] for t, s in treated}


@pytest.mark.parametrize("per_bucket, decimals", [(1_000_000, 3), (7, 3), (3, 1)])
def test_nearest_control_equals_brute_force(spark, monkeypatch, per_bucket, decimals):
    monkeypatch.setattr(match, "ROWS_PER_BUCKET", per_bucket)
    rng = np.random.default_rng(per_bucket + decimals)
    scores = np.round(rng.random(160), decimals) / 2**3
    scores[:50] = scores[0]  # a large group of equal scores
    treated = [(i, float(s)) for i, s in enumerate(scores) if i % 3 == 0]
    control = [(1000 + i, float(s)) for i, s in enumerate(scores) if i % 3 == 1]
    schema = "id long, p double"
    got = match.nearest_control(spark.createDataFrame(treated, schema), spark.createDataFrame(control, schema),
                                key="id", score="p").collect()
    assert {r["treated_key"]: r["control_key"] for r in got} == brute_match(treated, control)
    assert len(got) == len(treated)


def test_match_with_controls_on_one_side_only(spark, monkeypatch):
    monkeypatch.setattr(match, "ROWS_PER_BUCKET", 2)
    schema = "id long, p double"
    t = spark.createDataFrame([(i, 0.5 + i / 100) for i in range(9)], schema)
    c = spark.createDataFrame([(77, 0.1), (78, 0.05)], schema)
    assert {r["control_key"] for r in match.nearest_control(t, c, key="id", score="p").collect()} == {77}
    pairs = match.matched_pairs(t, c, match.nearest_control(t, c, key="id", score="p"), key="id")
    assert pairs.columns == ["id_t", "p_t", "id_c", "p_c"] and pairs.count() == 9


def test_match_leaves_out_rows_without_a_score_and_takes_no_single_task(spark):
    schema = "id long, p double"
    t = spark.createDataFrame([(1, 0.2), (2, None), (3, float("nan"))], schema)
    c = spark.createDataFrame([(7, 0.5), (8, None), (9, float("nan")), (6, 0.9)], schema)
    got = match.nearest_control(t, c, key="id", score="p")
    assert [(r["treated_key"], r["control_key"]) for r in got.collect()] == [(1, 7)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "cross" not in plan.lower() and "(r#" in plan
    empty = spark.createDataFrame([], schema)
    assert match.nearest_control(empty, empty, key="id", score="p").collect() == []


def test_propensity_modes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    dose = np.where(x[:, 0] + rng.normal(size=500) * 0.5 > 0.5, np.where(x[:, 1] > 0, 3.0, 5.0), 0.0)
    df = frame(spark, np.column_stack([x, dose]), ["a", "b", "dose"])
    one = {r["id"]: r["propensity_score"] for r in match.propensity_score(df, ["a", "b"], "dose", key="id").collect()}
    values = np.array([one[i] for i in range(500)])
    assert ((values > 0) & (values < 1)).all()
    assert values[dose > 0].mean() > values[dose == 0].mean() + 0.3
    # gradient of the penalised loss at the optimum: sum(p - y) x + w = 0, checked through the intercept sum
    assert abs(values.sum() - (dose > 0).sum()) < 0.5
    multi = match.propensity_score(df, ["a", "b"], "dose", key="id", label_mode="rounded_dose")
    got = {r["id"]: r["propensity_score"] for r in multi.collect()}
    three = np.array([got[i] for i in range(500)])
    assert three[dose == 3].mean() > three[dose != 3].mean() + 0.2


# --- neighbours ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("blocks, cells", [(8192, 2048), (16, 40), (7, 9)])
def test_neighbours_equal_brute_force(spark, monkeypatch, blocks, cells):
    rng = np.random.default_rng(blocks)
    x = np.round(rng.normal(size=(260, 3)), 1)
    x[:90] = x[0]  # a third of the rows are copies
    y = rng.integers(0, 2, 260)
    q = np.round(rng.normal(size=(60, 3)) * 1.5, 1)
    q[:20] = x[0]
    train = frame(spark, np.column_stack([x, y]), ["a", "b", "c", "y"])
    asked = frame(spark, q, ["a", "b", "c"], start=10_000)
    k = 9
    search, sizes = neighbours._search, []
    monkeypatch.setattr(neighbours, "_search", lambda leaves, *rest: (sizes.extend(r[1] for r in leaves.groupBy("cell").count().collect()), search(leaves, *rest))[1])
    got = k_nearest(train, asked, features=["a", "b", "c"], key="id", label="y", k=k, block_rows=blocks, cell_rows=cells)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_key"], []).append((r["distance"], r["key"]))
    for i, row in enumerate(q):
        d = [(float(sum((row[j] - x[n][j]) ** 2 for j in range(3))), n) for n in range(260)]
        assert sorted(n for _, n in found[10_000 + i]) == sorted(n for _, n in sorted(d)[:k])
    assert sum(sizes) == 260 and max(sizes) <= cells


def test_tied_vote_is_class_zero(spark):
    train = spark.createDataFrame([(1, 0.0, 1), (2, 0.0, 0)], "id long, a double, y int")
    got = knn_classify(train, train.select("id", "a"), features=["a"], key="id", label="y", k=2)
    assert {r["prediction"] for r in got.collect()} == {0}


# --- classifiers --------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] ** 2 + x[:, 1] ** 2 < 1.2).astype(float)
    df = frame(spark, np.column_stack([x, y]), ["a", "b", "y"]).withColumn("y", F.col("y").cast("int")).cache()
    return df.filter("id < 450"), df.filter("id >= 450")


@pytest.mark.parametrize("name, options", [("knn_model", {}), ("xgb_model", {}), ("svm_model", {}), ("tree_model", {}),
                                           ("dnn_model", {"steps": 40, "rate": 0.05})])
def test_models_beat_the_majority(spark, separable, name, options):
    train, verify = separable
    predicted = classify.MODELS[name](train, verify, features=["a", "b"], label="y", key="id", **options)
    table = classify.attach_predictions(verify, predicted, key="id", target="y")
    assert table.count() == verify.count()
    row = table.agg(evaluate.accuracy_percent(F.col("y"), F.col("model_y")).alias("acc"), F.avg("y").alias("share")).first()
    assert row["acc"] > 100 * max(row["share"], 1 - row["share"]) + 8


def test_seedless_model_is_fitted_once(spark, separable, monkeypatch):
    train, verify = separable
    fits = []
    monkeypatch.setitem(classify.MODELS, "knn_model", lambda *a, seed, **k: fits.append(seed) or classify.fit_predict_tree(*a, seed=seed, **k))
    runs = classify.repeated_accuracy(train, verify, features=["a", "b"], target="y", key="id", models=["knn_model"], seeds=[4, 5, 6])
    rows = runs.collect()
    assert fits == [4] and [r["seed"] for r in rows] == [4, 5, 6] and len({r["accuracy"] for r in rows}) == 1


def test_repeated_accuracy_and_confusion(spark, separable):
    train, verify = separable
    runs = classify.repeated_accuracy(train, verify, features=["a", "b"], target="y", key="id", models=["tree_model"], seeds=[0, 1])
    assert runs.count() == 2 and evaluate.mean_accuracy(runs).first()["accuracy"] > 80
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "y int, p int")
    assert sorted(map(tuple, evaluate.confusion_matrix(df, "y", "p").collect())) == [(0, 0, 0), (1, 1, 2)]


def test_assembly_refuses_missing_values(spark):
    df = spark.createDataFrame([(1, 1.0, None)], "id long, a double, b double")
    with pytest.raises(Exception):
        classify.assemble_features(df, ["a", "b"]).collect()


def test_boosting_equals_its_definition(spark):
    """One stump on one column: leaf values follow the penalised formula; a large penalty leaves the mean."""
    from stayloom.operators.boosting import fit_boosted_trees, penalised_value

    df = classify.assemble_features(spark.createDataFrame(
        [(i, float(i >= 60), float(i >= 60)) for i in range(100)], "id long, a double, y double"), ["a"], label="y", key="id")
    model = fit_boosted_trees(df, "y", trees=2, depth=1, step=0.5, absolute=10, quadratic=1)
    got = {r["y"]: r["s"] for r in model.score(df, "s").select("y", "s").distinct().collect()}
    low, high = 0.4, 0.4
    for _ in range(2):
        low += 0.5 * penalised_value(60 * (0 - low), 60, 10, 1)
        high += 0.5 * penalised_value(40 * (1 - high), 40, 10, 1)
    assert got[0.0] == pytest.approx(low) and got[1.0] == pytest.approx(high)
    flat = fit_boosted_trees(df, "y", trees=1, depth=1, absolute=1000)
    assert {round(r["s"], 12) for r in flat.score(df, "s").collect()} == {0.4}


def plain_tree(x, residual, columns, depth, absolute, quadratic):
    """The penalised greedy tree by trying every threshold; returns the value of each row and the splits made."""
    from stayloom.operators.boosting import LEAST_GAIN, penalised_value

    def part(r):
        return max(abs(r.sum()) - absolute, 0.0) ** 2 / (len(r) + quadratic)

    def grow(rows, level):
        r, best = residual[rows], None
        for c in columns if level < depth else ():
            values = np.unique(x[rows, c])
            for t in (values[:-1] + values[1:]) / 2:
                left = x[rows, c] <= t
                gain = 0.5 * (part(r[left]) + part(r[~left]) - part(r))
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, c, left)
        if best is None or best[0] <= LEAST_GAIN:
            out[rows] = penalised_value(r.sum(), len(rows), absolute, quadratic)
            return 0
        return 1 + grow(rows[best[2]], level + 1) + grow(rows[~best[2]], level + 1)

    out = np.zeros(len(x))
    return out, grow(np.arange(len(x)), 0)


@pytest.mark.parametrize("absolute, quadratic, share, finish", [(0.0, 0.0, 1.0, 10**6), (3.0, 1.0, 1.0, 0), (2.0, 5.0, 0.5, 150)])
def test_boosting_splits_by_the_penalised_gain(spark, absolute, quadratic, share, finish):
    from stayloom.operators.boosting import fit_boosted_trees

    rng = np.random.default_rng(7)
    x = np.column_stack([rng.integers(0, 40, 400), rng.normal(size=400).round(1), rng.integers(0, 2, 400), np.full(400, 3.0)]).astype(float)
    y = (x[:, 0] > 25) * 2.0 + (x[:, 1] > 0.3) * x[:, 2] * 3 + rng.normal(size=400)
    df = classify.assemble_features(spark.createDataFrame(
        [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y double").repartition(5),
        list("abcd"), label="y", key="id")
    model = fit_boosted_trees(df, "y", trees=4, depth=3, step=0.5, column_share=share, absolute=absolute, quadratic=quadratic, seed=2, write_every=2, finish_rows=finish)
    got = np.array([r["s"] for r in model.score(df, "s").orderBy("id").collect()])
    draw, want = np.random.default_rng(2), np.full(400, y.mean())
    splits = []
    for _ in range(4):
        columns = sorted(draw.choice(4, size=max(1, int(share * 4)), replace=False).tolist())
        step, made = plain_tree(x, y - want, columns, 3, absolute, quadratic)
        want = want + 0.5 * step
        splits.append(made)
    assert [int((t.column >= 0).sum()) for t in model.trees] == splits
    assert np.allclose(got, want)


def test_bins_of_columns_with_many_values(spark):
    from stayloom.operators.boosting import column_cuts

    df = classify.assemble_features(spark.range(5000).selectExpr("id", "cast(id as double) a", "cast(id % 7 as double) b", "1.0d c"), ["a", "b", "c"], key="id")
    many, few, one = column_cuts(df, 3)
    assert 200 <= len(many) <= 255 and max(np.diff(many)) < 60
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5] and len(one) == 0


def one_column_at_a_time(spark, df, columns, *, max_iter, tol, nearest, seed):
    """Imputation by one regression after another over the whole table, with pandas."""
    data = df.orderBy("id").toPandas()
    raw = data[columns].to_numpy(dtype=float)
    gap = np.isnan(raw)
    means = np.nanmean(raw, axis=0)
    state = np.where(gap, means, raw)
    weights = np.nan_to_num(np.abs(np.corrcoef(state.T)))
    order = sorted((c for c in range(len(columns)) if gap[:, c].any()), key=lambda c: gap[:, c].sum())
    limit = tol * np.nanmax(np.abs(raw))
    rng = None if seed is None else np.random.default_rng(seed)
    for turn in range(max_iter):
        before = state.copy()
        for c in order:
            chosen = impute._draw_predictors(weights, c, nearest, rng)
            seen = ~gap[:, c]
            x, y = state[seen][:, chosen], state[seen, c]
            xc, yc = x - x.mean(0), y - y.mean()
            coef = impute.bayesian_ridge(xc.T @ xc, xc.T @ yc, yc @ yc, len(y))
            state[~seen, c] = y.mean() + (state[~seen][:, chosen] - x.mean(0)) @ coef
        if np.abs(state - before).sum(axis=1).max() < limit:
            return state, turn + 1
    return state, max_iter


@pytest.mark.parametrize("seed, nearest, tol", [(None, 3, 1e-3), (0, 3, 0.01), (5, 1, 1e-4), (2, 4, 0.1)])
def test_levels_give_the_values_of_one_column_at_a_time(spark, holes, seed, nearest, tol):
    df = frame(spark, holes[1], "abcde").repartition(3)
    want, _ = one_column_at_a_time(spark, df, list("abcde"), max_iter=12, tol=tol, nearest=nearest, seed=seed)
    out = impute.iterative_impute(df, list("abcde"), key="id", max_iter=12, tol=tol, nearest=nearest, seed=seed)
    got = np.array([[r[c] for c in "abcde"] for r in out.orderBy("id").collect()], dtype=float)
    np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-9)


def test_levels_of_a_round():
    weights = np.ones((5, 5))
    plan = impute._round_equations(weights, [3, 1, 0], 4, None)
    assert [(e.target, e.level) for e in plan] == [(3, 0), (1, 1), (0, 2)]
    assert [dict(zip(e.predictors, e.fresh)).get(3) for e in plan] == [None, True, True]
    sparse = np.eye(5)
    sparse[[4, 2, 4], [3, 1, 0]] = 9
    assert [(e.predictors, e.level) for e in impute._round_equations(sparse, [3, 1, 0], 1, None)] == [((4,), 0), ((2,), 0), ((4,), 0)]


def test_runs_side_by_side_equal_single_runs(spark, holes):
    label = (holes[0][:, 2] + holes[0][:, 4] > 0).astype(float)
    df = frame(spark, np.column_stack([holes[1], label]), [*"abcde", "y"]).repartition(3).cache()
    seeds = [0, 3, 7]
    runs = impute.impute_runs(df, list("abcde"), key="id", seeds=seeds, max_iter=15, tol=0.1, nearest=2, also=["y"])
    picks = []
    for i, seed in enumerate(seeds):
        single = impute.iterative_impute(df, list("abcde"), key="id", max_iter=15, tol=0.1, nearest=2, seed=seed)
        a, b = ([[r[c] for c in "abcde"] for r in d.orderBy("id").collect()] for d in (single, runs.complete(df, i)))
        np.testing.assert_allclose(a, b, rtol=1e-8)
        fit = select.lasso_cv(single, list("abcde"), "y", key="id")
        picks += [(i, p, c) for p, c in enumerate(fit.selected(3))]
    assert len(set(runs.rounds)) > 1  # runs end on their own
    want = select.feature_vote(spark.createDataFrame(picks, "run int, pos int, feature string"), top=3, seen=F.col("run") * 1000 + F.col("pos"))
    got = select.stable_features(df, list("abcde"), "y", key="id", seeds=seeds, top=3, max_iter=15, tol=0.1, nearest=2)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


# --- trees --------------------------------------------------------------------------------------------------------

def plain_class_tree(x, y, order, rows=None):
    """Prediction function of the Gini tree grown by trying every threshold of every column."""
    rows = np.arange(len(x)) if rows is None else rows
    counts = np.bincount(y[rows], minlength=y.max() + 1)
    best = None
    for c in order if (counts > 0).sum() > 1 else ():
        values = np.unique(x[rows, c])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[rows, c] <= t
            score = sum((np.bincount(y[rows[s]]) ** 2).sum() / s.sum() for s in (left, ~left))
            if best is None or score > best[0] * (1 + 1e-12):
                best = (score, c, t, left)
    if best is None:
        return lambda q: counts.argmax()
    _, c, t, left = best
    low, high = plain_class_tree(x, y, order, rows[left]), plain_class_tree(x, y, order, rows[~left])
    return lambda q: (low if q[c] <= t else high)(q)


def test_tree_equals_brute_force(spark):
    from stayloom.operators.trees import fit_tree

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 3)), 1)
    x[:, 2] = rng.integers(0, 3, 300)
    x[:20] = x[0]  # equal rows of several classes
    y = ((x[:, 0] > 0).astype(int) + (rng.random(300) < 0.3)) * 5
    df = frame(spark, np.column_stack([x, y]), ["a", "b", "c", "y"]).repartition(4)
    asked = np.round(rng.normal(size=(80, 3)), 1)
    model = fit_tree(df, ["a", "b", "c"], "y", seed=3)
    got = {r["id"]: r["prediction"] for r in model.predict(frame(spark, np.vstack([x, asked]), ["a", "b", "c"]), ["a", "b", "c"], "id", blocks=3).collect()}
    plain = plain_class_tree(x, y // 5, np.random.default_rng(3).permutation(3).tolist())
    assert [got[i] for i in range(380)] == [5.0 * plain(q) for q in np.vstack([x, asked])]


def test_tree_split_by_counts_above_and_values_below(spark):
    from stayloom.operators.trees import fit_tree

    rng = np.random.default_rng(6)
    x = rng.integers(0, 50, (600, 2)).astype(float)
    y = ((x[:, 0] + x[:, 1]) % 7 < 3).astype(float)
    df = frame(spark, np.column_stack([x, y]), ["a", "b", "y"]).repartition(3)
    model = fit_tree(df, ["a", "b"], "y", finish_cells=150)
    assert len(model.top.column) > 7 and model.subtrees.count() == model.top.column.count(-1)
    got = {r["id"]: r["prediction"] for r in model.predict(df, ["a", "b"], "id").collect()}
    assert all(got[i] == y[i] for i in range(600))  # labels follow from the values, so a tree of any depth fits every row


def test_deep_tree(spark):
    """A chain: each split parts one row, deeper than any fixed limit."""
    from stayloom.operators.trees import grow, walk

    n = 120
    x = np.arange(n, dtype=float)[:, None]
    y = np.arange(n) % 2
    column, threshold, child, majority = grow(x, y, 2, [0])
    assert (majority[walk(x, column, threshold, child)] == y).all() and (column >= 0).sum() == n - 1


# --- kernel machine and network -------------------------------------------------------------------------------------

def test_landmarks_bound_every_kernel_value(spark):
    from stayloom.operators.kernel import find_landmarks, rbf

    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 3))
    x[:30] = x[0]
    df = frame(spark, x, "abc").repartition(3)
    ranks = []
    for error in (0.3, 0.05, 1e-6):
        marks, worst = find_landmarks(df, list("abc"), 0.4, error=error, candidates=16)
        mapped = marks.features(x)
        assert worst <= error and np.abs(rbf(x, x, 0.4) - mapped @ mapped.T).max() <= error + 1e-6
        ranks.append(len(marks.rows))
    assert ranks[0] < ranks[1] < ranks[2] <= 211


def exact_machine(x, y, gamma, cost, rounds=4000):
    """Decision function of the hinge-loss machine on the exact kernel, by coordinate ascent on pairs of its dual."""
    from stayloom.operators.kernel import rbf

    k, s = rbf(x, x, gamma), np.where(y > 0, 1.0, -1.0)
    alpha, gradient = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(rounds):
        up, low = ((alpha < cost) & (s > 0)) | ((alpha > 0) & (s < 0)), ((alpha < cost) & (s < 0)) | ((alpha > 0) & (s > 0))
        i, j = np.where(up)[0][np.argmax(-(s * gradient)[up])], np.where(low)[0][np.argmin(-(s * gradient)[low])]
        gap = -s[i] * gradient[i] + s[j] * gradient[j]
        if gap < 1e-4:
            break
        step = gap / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, cost - alpha[i] if s[i] > 0 else alpha[i], alpha[j] if s[j] > 0 else cost - alpha[j])
        for n, d in ((i, step * s[i]), (j, -step * s[j])):
            alpha[n] += d
            gradient += d * s[n] * s * k[:, n]
    b = -(s * gradient)[i] / 2 - (s * gradient)[j] / 2
    return lambda q: rbf(q, x, gamma) @ (alpha * s) + b


def test_kernel_machine_agrees_with_the_exact_one(spark, separable):
    train, verify = separable
    a, b = (np.array([[r["a"], r["b"], r["y"]] for r in d.orderBy("id").collect()]) for d in separable)
    want = exact_machine(a[:, :2], a[:, 2], 0.5, 1.0)(b[:, :2]) > 0
    for error, least in ((0.05, 0.96), (0.001, 0.98)):
        found = classify.fit_predict_svm(train, verify, features=["a", "b"], label="y", key="id", gamma=0.5, kernel_error=error)
        got = np.array([r["prediction"] for r in found.orderBy("id").collect()])
        assert (got == want).mean() >= least


def test_network_gradient_is_that_of_its_loss():
    from stayloom.operators.network import Network, _masks

    rng = np.random.default_rng(3)
    net = Network.start(4, 2, (5, 4, 3), (False, True, True, False), 1)
    x, target = rng.normal(size=(20, 4)), rng.integers(0, 2, (20, 2)).astype(float)
    masks = _masks(np.arange(20), net, 0.3, 5)
    assert masks[0] is None and 0 < (masks[1] == 0).mean() < 0.7
    loss, gradient = net.gradient(x, target, masks)
    for w, g in zip(net.weights, gradient):
        for at in [(0, 0), (w.shape[0] - 1, w.shape[1] - 1), (1, 1)]:
            w[at] += 1e-6
            more = net.gradient(x, target, masks)[0]
            w[at] -= 2e-6
            less = net.gradient(x, target, masks)[0]
            w[at] += 1e-6
            assert g[at] == pytest.approx((more - less) / 2e-6, rel=1e-4, abs=1e-6)


def test_network_steps_are_full_batch(spark):
    from stayloom.operators.network import Adam, Network, fit_network

    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3)) * [1, 100, 0.01]
    y = (x[:, 0] > 0).astype(float)
    df = frame(spark, np.column_stack([x, y]), list("abcy")).repartition(4)
    net = fit_network(df, list("abc"), "y", key="id", steps=3, rate=0.01, dropped=0.0, seed=4)
    plain = Network.start(3, 2, (96, 64, 16), (False, True, True, False), 4)
    plain.mean, plain.scale = x.mean(axis=0), x.std(axis=0)
    adam, target = Adam(plain.weights, 0.01), np.column_stack([y, 1 - y])
    for _ in range(3):
        adam.step(plain.weights, plain.gradient(x, target)[1])
    for a, b in zip(net.weights, plain.weights):
        np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-9)


def test_network_step_in_parts_equals_one_over_all_rows(spark, monkeypatch):
    from stayloom.operators import network
    from stayloom.operators.network import HIDDEN, SIGMOID, Network, _blocks, _masks, summed_gradient

    monkeypatch.setattr(network, "BLOCK_CELLS", 60)
    monkeypatch.setattr(network, "PART_ROWS", 7)
    rng = np.random.default_rng(5)
    x, y, ids = rng.normal(size=(101, 3)), rng.integers(0, 2, 101).astype(float), rng.integers(-2**62, 2**62, 101)
    df = spark.createDataFrame([(int(i), [float(v) for v in r], float(t)) for i, r, t in zip(ids, x, y)], "id bigint, x array<double>, y double")
    blocks = _blocks(df.repartition(3), 3)
    assert blocks.count() >= 6  # several rows to a record, and no record with all of them
    net = Network.start(3, 2, HIDDEN, SIGMOID, 1)
    loss, gradient = summed_gradient(blocks, net, 3, 0.1, 9)
    want = net.gradient(x, np.column_stack([y, 1 - y]), _masks(ids, net, 0.1, 9))
    assert loss == pytest.approx(want[0])
    for a, b in zip(gradient, want[1]):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("alone", [0, 1 << 16])
@pytest.mark.parametrize("sigmoid", [(False, True, True, False), (False, False, False, True), (True, False, False, False)])
def test_network_by_jobs_and_by_one_task_takes_the_same_steps(spark, monkeypatch, alone, sigmoid):
    """Each step is the plain gradient over all rows with the units dropped that the row's hash names."""
    from stayloom.operators import network

    jobs, run = [], network._gradient_job
    monkeypatch.setattr(network, "ALONE_ROWS", alone)
    monkeypatch.setattr(network, "BLOCK_CELLS", 60)
    monkeypatch.setattr(network, "_gradient_job", lambda *a: jobs.append(1) or run(*a))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 3)) * [1, 100, 0.01] + 5
    y = (x[:, 0] > 5).astype(float)
    df = frame(spark, np.column_stack([x, y]), list("abcy")).repartition(3)
    net = network.fit_network(df, list("abc"), "y", key="id", steps=5, rate=0.01, dropped=0.2, sigmoid=sigmoid, seed=4)
    ids = np.array([r[0] for r in df.select(F.xxhash64("id"), "id").orderBy("id").collect()])
    plain = network.Network.start(3, 2, network.HIDDEN, sigmoid, 4)
    plain.mean, plain.scale = x.mean(axis=0), x.std(axis=0)
    adam, target = network.Adam(plain.weights, 0.01), np.column_stack([y, 1 - y])
    for turn in range(5):
        adam.step(plain.weights, plain.gradient(x, target, network._masks(ids, plain, 0.2, 4 + turn))[1])
    for a, b in zip(net.weights, plain.weights):
        np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-9)
    assert len(jobs) == (0 if alone else 5)


@pytest.mark.parametrize("name", ["mlp_classify", "predictions_table"])
def test_queries_fit_the_whole_network(spark, monkeypatch, name):
    """The steps, rate, layers and dropped share of the study, and every train row."""
    from types import SimpleNamespace

    from stayloom.operators import network
    from verification import model_queries

    taken = []

    def descend(net, steps, rate, gradient):
        taken.append((steps, rate, [w.shape for w in net.weights], net.sigmoid))

    def fit(train, *args, **options):
        asked = inspect.signature(network.fit_network).bind(train, *args, **options)
        asked.apply_defaults()
        taken.append((train.count(), asked.arguments["dropped"]))
        return network.fit_network(train, *args, **options)

    monkeypatch.setattr(network, "ALONE_ROWS", 0)
    monkeypatch.setattr(network, "_descend", descend, raising=False)
    monkeypatch.setattr(classify, "fit_network", fit)
    monkeypatch.setattr(classify, "MODELS", {"dnn_model": classify.MODELS["dnn_model"]})
    rows = [(i, float(i), 2.0, 0.1 * i, None if i == 3 else 1.0, i % 7.0, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, f1 double, f2 double, f3 double, f4 double, f5 double, label int")
    got = getattr(model_queries, name)(SimpleNamespace(features=lambda: df))
    assert got.count() == 4
    assert taken == [(16, 0.01), (12_000, 0.0002, [(6, 96), (97, 64), (65, 16), (17, 2)], (False, True, True, False))]


def test_network_drops_by_the_share_of_the_hash():
    from stayloom.operators.network import _least_kept

    for dropped in (0.0, 0.01, 0.3, 0.5, 0.9):
        least = int(_least_kept(dropped))
        hashes = np.array([h for h in range(least - 3, least + 3) if h >= 0], np.uint64)
        assert ((hashes.astype(np.float64) / 2.0 ** 64 >= dropped) == (hashes >= np.uint64(least))).all()


@pytest.mark.parametrize("share", [0.25, 0.5, 1.0])
def test_boosting_ways_to_grow_agree(spark, monkeypatch, share):
    """Joint bins, levels and tasks give one and the same model; no tree of one or two columns groups its rows."""
    from stayloom.operators import boosting

    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4)).round(1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=400)) > 0).astype(float)
    df = classify.assemble_features(frame(spark, np.column_stack([x, y]), list("abcdy")).repartition(3), list("abcd"), label="y")
    options = dict(trees=4, depth=4, step=0.3, column_share=share, absolute=0.5, seed=3, write_every=2)
    models = []
    for joint, finish in ((0, 0), (0, 1 << 20), (2, 0)):
        monkeypatch.setattr(boosting, "JOINT_COLUMNS", joint)
        models.append(boosting.fit_boosted_trees(df, "y", finish_rows=finish, **options))
    if share < 1:
        monkeypatch.setattr(boosting, "_finish", None)
        monkeypatch.setattr(boosting, "_histograms", None)
        models.append(boosting.fit_boosted_trees(df, "y", **options))
    for model in models[1:]:
        for a, b in zip(models[0].trees, model.trees):
            assert a.column.tolist() == b.column.tolist() and a.code.tolist() == b.code.tolist()
            np.testing.assert_allclose(a.value, b.value, rtol=1e-9, atol=1e-12)
    assert any((t.column >= 0).sum() > 3 for t in models[0].trees)


def test_neighbours_look_into_near_boxes_only(monkeypatch):
    """Of a pair of blocks, few distances are computed."""
    rng = np.random.default_rng(8)
    t, q = rng.uniform(size=(4000, 2)).round(3), rng.uniform(size=(500, 2)).round(3)
    count, real = [0], neighbours.squared_distances
    monkeypatch.setattr(neighbours, "squared_distances", lambda a, b: (count.__setitem__(0, count[0] + len(a) * len(b)), real(a, b))[1])
    train = neighbours._table(neighbours.POINT, np.ones(4000, np.int64), np.arange(4000), t[:, 0], neighbours.pa.array(list(t)), np.zeros(4000))
    asked = neighbours._table(neighbours.VISIT, np.arange(500), neighbours.pa.array(list(q)), np.ones(500, np.int64), np.full(500, np.inf), np.zeros(500))
    got = neighbours._block_search(5)(train, asked).to_pandas()
    d = real(q, t)
    want = np.lexsort((np.broadcast_to(np.arange(4000), d.shape), d), axis=1)[:, :5]
    assert got.sort_values(["query_key", "distance", "key"])["key"].tolist() == want.ravel().tolist()
    assert count[0] < 500 * 4000 / 5


def test_growing_a_tree_takes_little_memory():
    import tracemalloc

    from stayloom.operators.trees import grow

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(100_000, 5)).round(2), rng.integers(0, 2, 100_000)
    x[:, 1:] = 0.0
    tracemalloc.start()
    grow(x, y, 2, range(5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * len(x)
