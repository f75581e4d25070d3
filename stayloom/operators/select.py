"""Feature ranking and selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayloom.operators.impute import Imputed, impute_runs
from stayloom.operators.moments import Moments, column_means, group_moments
from stayloom.operators.ranks import order_statistics


def label_correlations(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of every column with the label, one row per column, from a single aggregate."""
    one = df.agg(*[F.corr(c, label).alias(c) for c in columns])
    return one.unpivot([], list(columns), "feature", "corr")


def feature_vote(picks: DataFrame, *, top: int, seen: Column) -> DataFrame:
    """Features picked most often over repeated runs; equal counts go to the one seen first."""
    return picks.groupBy("feature").agg(F.count("*").alias("votes"), F.min(seen).alias("first_seen")).orderBy(
        F.desc("votes"), "first_seen").limit(top)


@dataclass
class LassoFit:
    columns: list[str]
    alpha: float
    alphas: np.ndarray
    cv_error: np.ndarray  # mean squared error per alpha, averaged over folds
    coef: np.ndarray
    corr: np.ndarray

    def selected(self, top: int) -> list[str]:
        """Columns with a non-zero coefficient, by absolute correlation with the label."""
        kept = [i for i in range(len(self.columns)) if abs(self.coef[i]) > 0]
        kept.sort(key=lambda i: -abs(self.corr[i]))
        return [self.columns[i] for i in kept[:top]]


def soft_threshold_descent(gram: np.ndarray, xy: np.ndarray, penalty: float, start: np.ndarray,
                           tol: float = 1e-9, sweeps: int = 20_000) -> np.ndarray:
    """Minimise ``w'Gw/2 - w'c + penalty * |w|_1`` by cyclic coordinate descent."""
    w = start.copy()
    residual = xy - gram @ w
    diagonal = np.diag(gram)
    usable = np.flatnonzero(diagonal > 0)
    active = usable
    for sweep in range(sweeps):
        largest = 0.0
        for j in active:
            pull = residual[j] + diagonal[j] * w[j]
            updated = np.sign(pull) * max(abs(pull) - penalty, 0.0) / diagonal[j]
            step = updated - w[j]
            if step:
                residual -= gram[:, j] * step
                w[j] = updated
                largest = max(largest, abs(step) * np.sqrt(diagonal[j]))
        scale = np.sqrt(diagonal.max(initial=0.0)) * np.abs(w).max(initial=0.0)
        if largest <= tol * max(scale, 1e-300):
            if len(active) == len(usable):
                break
            active = usable  # the working set has settled: look at every column once more
        elif sweep % 10 == 9:
            active = np.flatnonzero(w) if np.any(w) else usable
    return w


def key_folds(df: DataFrame, key: str, folds: int) -> Column:
    """The number of the contiguous block of the integer key that a row lies in (runs counting jobs)."""
    def last_ranks(total: int) -> list[int]:
        sizes = [total // folds + (1 if i < total % folds else 0) for i in range(folds)]
        return [int(e) for e in np.cumsum(sizes)[:-1]]

    fold = F.lit(folds - 1)
    for i, (last, _, _) in reversed(list(enumerate(order_statistics(df, F.col(key), last_ranks)))):
        fold = F.when(F.col(key) <= last, F.lit(i)).otherwise(fold)
    return fold


def lasso_from_folds(parts: Sequence[Moments], columns: Sequence[str], *, n_alphas: int = 100, eps: float = 1e-3) -> LassoFit:
    """Lasso with the penalty chosen by cross-validation, from the moments of columns and label in every fold.

    The moments of a training part are the total minus the fold, so neither the path of each fold nor the final fit looks at
    a row.
    """
    whole = sum(parts[1:], start=parts[0])
    centered = whole.centered()
    gram, xy = centered[:-1, :-1], centered[:-1, -1]
    top = np.abs(xy).max() / whole.n
    alphas = np.geomspace(top, top * eps, n_alphas) if top > 0 else np.full(n_alphas, np.finfo(float).resolution)
    error = np.zeros((len(parts), n_alphas))
    for f, held_out in enumerate(parts):
        train = whole - held_out
        c = train.centered()
        test = held_out.centered(train.mean)
        w = np.zeros(len(columns))
        for a, alpha in enumerate(alphas):
            w = soft_threshold_descent(c[:-1, :-1], c[:-1, -1], train.n * alpha, w)
            residual = np.append(-w, 1.0)
            error[f, a] = residual @ test @ residual / held_out.n
    cv_error = error.mean(axis=0)
    best = int(np.argmin(cv_error))
    w = np.zeros(len(columns))
    for alpha in alphas[: best + 1]:
        w = soft_threshold_descent(gram, xy, whole.n * alpha, w)
    return LassoFit(list(columns), float(alphas[best]), alphas, cv_error, w, whole.correlation()[:-1, -1])


def lasso_cv(df: DataFrame, columns: Sequence[str], label: str, *, key: str, folds: int = 5, n_alphas: int = 100,
             eps: float = 1e-3) -> LassoFit:
    """Lasso with the penalty chosen by cross-validation over contiguous blocks of the integer key (runs jobs).

    One pass collects the moments of every fold; see ``lasso_from_folds``.
    """
    names = [*columns, label]
    parts = group_moments(df, names, group=key_folds(df, key, folds), shift=column_means(df, names))
    return lasso_from_folds(list(parts.values()), columns, n_alphas=n_alphas, eps=eps)


def lasso_table(df: DataFrame, fit: LassoFit, top: int) -> DataFrame:
    """The selected features with rank, coefficient and correlation (at most one row per column)."""
    rows = [(i, c, float(fit.coef[fit.columns.index(c)]), float(fit.corr[fit.columns.index(c)]))
            for i, c in enumerate(fit.selected(top))]
    return df.sparkSession.createDataFrame(rows, "rank int, feature string, coef double, corr double")


def run_moments(runs: Imputed, label: str, fold: Column) -> dict[int, list[Moments]]:
    """Per imputation run the moments of its completed columns and the label in every fold; one job for all runs.

    Rows without a label are left out.
    """
    names = [*runs.names, label]
    shift = np.array(column_means(runs.state.select(*[F.nanvl(F.get("x", F.lit(i)), F.lit(None).cast("double")).alias(c) for i, c in enumerate(runs.names)],
                                                    F.col(label).cast("double").alias(label)), names))
    i, j = np.triu_indices(len(names) + 1)

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            rows = runs_rows(batch)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            folds = batch.column("fold").to_numpy()
            for run in range(count):
                z = np.column_stack([np.ones(len(y)), np.column_stack([rows.completed(run), y]) - shift])
                for f in np.unique(folds):
                    part = z[(folds == f) & ~np.isnan(y)]
                    sums[run, int(f)] = sums.get((run, int(f)), 0) + part.T @ part
        for (run, f), m in sums.items():
            n = len(i)
            yield pa.RecordBatch.from_pydict({"run": np.full(n, run, np.int32), "fold": np.full(n, f, np.int32), "i": i.astype(np.int32),
                                              "j": j.astype(np.int32), "v": m[i, j]})

    runs_rows, count = runs.rows, len(runs.seeds)
    data = runs.state.select("x", "fills", F.col(label).cast("double").alias("y"), fold.cast("int").alias("fold"))
    summed = data.mapInArrow(partial_sums, "run int, fold int, i int, j int, v double").groupBy("run", "fold", "i", "j").agg(F.sum("v").alias("v"))
    cross: dict[tuple[int, int], np.ndarray] = {}
    for r in summed.collect():
        m = cross.setdefault((r["run"], r["fold"]), np.zeros((len(names) + 1,) * 2))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return {run: [Moments(names, shift, m) for (s, _), m in sorted(cross.items()) if s == run and m[0, 0] > 0] for run in range(count)}


def stable_features(df: DataFrame, columns: Sequence[str], label: str, *, key: str, seeds: Sequence[int] = range(10), top: int = 10,
                    folds: int = 5, max_iter: int = 100, tol: float = 0.1, nearest: int = 3) -> DataFrame:
    """Impute and select once per seed, then keep the features picked most often (runs jobs).

    All imputations advance in one state table, and the moments of every (seed, fold) come from one pass over it, so ten seeds
    take as many jobs as one. Only the names picked per run become rows of the vote.
    """
    runs = impute_runs(df, columns, key=key, seeds=list(seeds), max_iter=max_iter, tol=tol, nearest=nearest, also=[label])
    parts = run_moments(runs, label, key_folds(df, key, folds))
    picks = [(run, position, name) for run in sorted(parts) for position, name in enumerate(lasso_from_folds(parts[run], columns).selected(top))]
    table = df.sparkSession.createDataFrame(picks, "run int, pos int, feature string")
    return feature_vote(table, top=top, seen=F.col("run") * 1000 + F.col("pos"))
