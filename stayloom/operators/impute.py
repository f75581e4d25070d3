"""Chained-equation imputation on distributed sums.

Every incomplete column is in turn regressed on a few other columns over the rows where it was observed, and its missing
cells are replaced by the prediction; rounds repeat until the largest row change is small. A column waits only for those
of its predictors that come before it in the round, so the columns of a round fall into few levels, and one aggregate
gives the regression sums of all columns of a level, for all seeds at once. Rows with gaps carry their filled cells, one set per
seed. The state is written every few rounds, which also cuts the lineage; in between, tasks apply the rounds since then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayloom.operators.moments import group_moments
from stayloom.operators.prepare import present
from stayloom.session import LoopState


class ImputationError(ValueError):
    """The imputed table does not cover every cell of the input."""


def cell_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and filled cells per column, one row per column, from one aggregate."""
    one = df.agg(F.count("*").alias("_rows"), *[F.count_if(present(df, c)).alias(c) for c in columns])
    return one.unpivot(["_rows"], list(columns), "column", "filled").select(
        "column", F.col("_rows").alias("rows"), "filled")


def check_imputed(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> None:
    """Raise unless ``after`` has as many rows as ``before`` and no missing cell (runs two jobs)."""
    rows = before.count()
    for r in cell_summary(after, columns).collect():
        if r["rows"] != rows or r["filled"] != rows:
            raise ImputationError(f"{r['column']}: {r['filled']} of {rows} cells after imputation")


def mean_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill the missing cells of each column with its mean (runs one aggregate for all columns)."""
    means = df.agg(*[F.avg(F.when(present(df, c), F.col(c))).alias(c) for c in columns]).first()
    empty = [c for c in columns if means[c] is None]
    if empty:
        raise ImputationError(f"no observed value in {empty}")
    return df.withColumns({c: F.coalesce(F.when(present(df, c), F.col(c)), F.lit(float(means[c]))) for c in columns})


def bayesian_ridge(gram: np.ndarray, xy: np.ndarray, yy: float, n: float, *, rounds: int = 300,
                   tol: float = 1e-3) -> np.ndarray:
    """Coefficients of a ridge regression whose penalty is the evidence estimate (MacKay 1992), from centred sums."""
    prior = 1e-6
    eigenvalues, vectors = np.linalg.eigh(gram)
    eigenvalues = np.clip(eigenvalues, 0, None)
    rotated = vectors.T @ xy
    noise, weight = 1.0 / (yy / n + np.finfo(float).eps), 1.0

    def solve() -> np.ndarray:
        return vectors @ (rotated / (eigenvalues + weight / noise))

    previous = None
    for _ in range(rounds):
        coef = solve()
        sse = max(yy - 2 * coef @ xy + coef @ gram @ coef, 0.0)
        effective = np.sum(noise * eigenvalues / (weight + noise * eigenvalues))
        weight = (effective + 2 * prior) / (coef @ coef + 2 * prior)
        noise = (n - effective + 2 * prior) / (sse + 2 * prior)
        if previous is not None and np.abs(previous - coef).sum() < tol:
            break
        previous = coef
    return solve()


def _draw_predictors(weights: np.ndarray, target: int, count: int, rng: np.random.Generator | None) -> list[int]:
    """Indices of the predictor columns: the most correlated ones, or a draw weighted by correlation."""
    others = [i for i in range(len(weights)) if i != target]
    if len(others) <= count:
        return others
    w = weights[others, target] + 1e-12
    if rng is None:
        return [others[i] for i in np.argsort(-w, kind="stable")[:count]]
    return [others[i] for i in rng.choice(len(others), size=count, replace=False, p=w / w.sum())]


@dataclass(frozen=True)
class _Equation:
    """One regression of a round: column numbers, and which predictors take the value this round has given them."""

    target: int
    predictors: tuple[int, ...]
    fresh: tuple[bool, ...]
    level: int


def _round_equations(weights: np.ndarray, gaps: Sequence[int], nearest: int, rng: np.random.Generator | None) -> list[_Equation]:
    """The regressions of a round in order; the level of one is above those of the predictors that come before it."""
    levels: dict[int, int] = {}
    equations = []
    for target in gaps:
        chosen = _draw_predictors(weights, target, nearest, rng)
        fresh = tuple(p in levels for p in chosen)
        levels[target] = 1 + max([levels[p] for p in chosen if p in levels], default=-1)
        equations.append(_Equation(target, tuple(chosen), fresh, levels[target]))
    return equations


class _Rows:
    """A batch of the state: observed values (NaN where missing) and the filled cells per seed and incomplete column."""

    def __init__(self, batch: pa.RecordBatch, width: int, gaps: Sequence[int], seeds: int):
        self.values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
        self.missing = np.isnan(self.values)
        self.holed = np.flatnonzero(self.missing.any(axis=1))
        self.fills = batch.column("fills").flatten().to_numpy(zero_copy_only=False).reshape(len(self.holed), seeds, len(gaps)).copy()
        self.gaps = list(gaps)

    def completed(self, seed: int) -> np.ndarray:
        out = self.values.copy()
        for g, c in enumerate(self.gaps):
            rows = np.flatnonzero(self.missing[self.holed, c])
            out[self.holed[rows], c] = self.fills[rows, seed, g]
        return out

    def solved(self, old: np.ndarray, equations: Sequence[_Equation], fits: dict[int, tuple[list[float], float]]) -> np.ndarray:
        """The values after the regressions that are known."""
        new = old.copy()
        for e in equations:
            if e.target in fits:
                slopes, intercept = fits[e.target]
                rows = np.flatnonzero(self.missing[:, e.target])
                predicted = np.full(len(rows), intercept)
                for slope, x in zip(slopes, self.inputs(old, new, e)):
                    predicted += slope * x[rows]
                new[rows, e.target] = predicted
        return new

    @staticmethod
    def inputs(old: np.ndarray, new: np.ndarray, e: _Equation) -> list[np.ndarray]:
        return [(new if fresh else old)[:, p] for p, fresh in zip(e.predictors, e.fresh)]


Fits = dict[int, dict[int, tuple[list[float], float]]]  # per seed and target the slopes and the intercept
Round = tuple[dict[int, list[_Equation]], Fits]  # a whole round: the regressions of every run and what they gave
WRITE_EVERY = 4


def _caught_up(rows: _Rows, pending: Sequence[Round], seeds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The completed values of every run after the rounds since the state was written, and what the last round changed in
    each row with gaps."""
    values, moved = [], np.zeros((len(rows.holed), seeds))
    for s in range(seeds):
        new = rows.completed(s)
        for plans, fits in pending:
            if s in plans:
                old, new = new, rows.solved(new, plans[s], fits[s])
                moved[:, s] = np.abs(new - old)[rows.holed].sum(axis=1)
        values.append(new)
    return values, moved


def _level_sums(state: DataFrame, pending: Sequence[Round], plans: dict[int, list[_Equation]], fits: Fits, level: int, shift: np.ndarray,
                rows_of: Callable[[pa.RecordBatch], _Rows], seeds: int, size: int) -> tuple[dict[tuple[int, int], np.ndarray], np.ndarray]:
    """Cross products of (1, predictors, target) over the observed rows, per (seed, target) of the level, and per seed the
    largest change of the round before: one job."""
    i, j = np.triu_indices(size)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(s, e.target): np.zeros((len(e.predictors) + 2,) * 2) for s, plan in plans.items() for e in plan if e.level == level}
        moved = np.zeros(seeds)
        for batch in batches:
            rows = rows_of(batch)
            values, change = _caught_up(rows, pending, seeds)
            moved = np.maximum(moved, change.max(axis=0, initial=0.0))
            for s, plan in plans.items():
                wanted = [e for e in plan if e.level == level]
                if not wanted:
                    continue
                old = values[s]
                new = rows.solved(old, plan, fits[s])
                for e in wanted:
                    seen = ~rows.missing[:, e.target]
                    z = np.column_stack([np.ones(seen.sum()), *[x[seen] - shift[p] for x, p in zip(rows.inputs(old, new, e), e.predictors)],
                                         old[seen, e.target] - shift[e.target]])
                    sums[s, e.target] += z.T @ z
        found = [(s, t, {f"v{n}": m[a, b] for n, (a, b) in enumerate(zip(i, j)) if max(a, b) < len(m)}) for (s, t), m in sums.items()]
        found += [(s, -1, {"v0": moved[s]}) for s in range(seeds)]
        yield pa.RecordBatch.from_pylist([{"seed": s, "target": t, **v} for s, t, v in found], schema=schema)

    schema = pa.schema([("seed", pa.int32()), ("target", pa.int32()), *[(f"v{n}", pa.float64()) for n in range(len(i))]])
    ddl = "seed int, target int, " + ", ".join(f"v{n} double" for n in range(len(i)))
    grouped = state.mapInArrow(work, ddl).groupBy("seed", "target").agg(F.max("v0").alias("most"), *[F.sum(f"v{n}").alias(f"v{n}") for n in range(len(i))])
    cross, change = {}, np.zeros(seeds)
    for r in grouped.collect():
        if r["target"] < 0:
            change[r["seed"]] = r["most"]
            continue
        m = np.zeros((size, size))
        m[i, j] = [r[f"v{n}"] or 0.0 for n in range(len(i))]
        cross[r["seed"], r["target"]] = m + np.triu(m, 1).T
    return cross, change


def _solve(m: np.ndarray, e: _Equation, shift: np.ndarray) -> tuple[list[float], float]:
    """Slopes and intercept from the cross products of (1, predictors, target)."""
    p = len(e.predictors)
    n, s, q = m[0, 0], m[0, 1:p + 2], m[1:p + 2, 1:p + 2]
    c = q - np.outer(s, s) / n
    coef = bayesian_ridge(c[:-1, :-1], c[:-1, -1], float(c[-1, -1]), n)
    means = s / n + shift[[*e.predictors, e.target]]
    return [float(v) for v in coef], float(means[-1] - coef @ means[:-1])


@dataclass
class Imputed:
    """The completed columns of several runs in one table: key, observed values ``x`` (NaN where missing) and ``fills``."""

    state: DataFrame
    key: str
    names: list[str]
    gaps: list[int]
    seeds: list[int | None]
    rounds: list[int]

    @property
    def rows(self) -> Callable[[pa.RecordBatch], _Rows]:
        """A reader of batches of the state, for use in tasks."""
        return partial(_Rows, width=len(self.names), gaps=self.gaps, seeds=len(self.seeds))

    def filled(self, run: int) -> DataFrame:
        """Key and the filled value of every incomplete column (NULL in rows without gaps) of one run."""
        at = [F.get("fills", F.lit(run * len(self.gaps) + g)).alias(f"_fill_{self.names[c]}") for g, c in enumerate(self.gaps)]
        return self.state.select(self.key, *at)

    def complete(self, df: DataFrame, run: int = 0) -> DataFrame:
        """``df`` with the missing cells of one run filled; all other cells and columns as they are."""
        names = [self.names[c] for c in self.gaps]
        joined = df.join(self.filled(run), self.key, "left")
        cell = {c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.col(f"_fill_{c}")).otherwise(F.col(c).cast("double")) for c in names}
        return joined.withColumns(cell).select(*df.columns)


def impute_runs(df: DataFrame, columns: Sequence[str], *, key: str, seeds: Sequence[int | None] = (0,), max_iter: int = 100, tol: float = 0.1,
                nearest: int = 3, also: Sequence[str] = (), write_every: int = WRITE_EVERY) -> Imputed:
    """Impute ``columns`` once per seed, all runs side by side in one state (runs jobs: one per level and round, and a
    write every ``write_every`` rounds).

    ``nearest`` predictors are drawn per column and round with weights given by their correlation, from the seed; with
    seed None the most correlated ones are always taken. Columns with the fewest gaps go first. A run whose largest row
    change falls below ``tol`` times the largest absolute value is not advanced any more. The columns ``also`` stay in the state.
    """
    names = list(columns)
    values = df.select(key, *also, *[F.col(c).cast("double").alias(c) for c in names if c not in also and c != key])
    values = values.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})
    stats = values.agg(
        F.count("*").alias("rows"), *[F.count(c).alias(f"n_{c}") for c in names],
        *[F.avg(c).alias(f"m_{c}") for c in names], *[F.max(F.abs(c)).alias(f"x_{c}") for c in names]).first()
    empty = [c for c in names if not stats[f"n_{c}"]]
    if empty:
        raise ImputationError(f"no observed value in {empty}")
    means = np.array([float(stats[f"m_{c}"]) for c in names])
    count = {c: stats["rows"] - stats[f"n_{c}"] for c in names}
    gaps = [names.index(c) for c in sorted((c for c in names if count[c]), key=count.get)]
    runs = len(seeds)
    start = F.array(*[F.lit(float(means[c])) for _ in range(runs) for c in gaps]) if gaps else F.array().cast("array<double>")
    none = F.array().cast("array<double>")
    holed = F.greatest(*[F.col(names[c]).isNull() for c in gaps], F.lit(False), F.lit(False))
    x = F.array(*[F.coalesce(F.col(c), F.lit(float("nan"))) for c in names])
    rounds = LoopState("impute")
    state = rounds.advance(values.select(key, *also, x.alias("x"), F.when(holed, start).otherwise(none).alias("fills")))
    out = Imputed(state, key, names, gaps, list(seeds), [0] * runs)
    if not gaps:
        return out
    weights = np.nan_to_num(np.abs(_start_correlation(state, out, means)))
    limit = tol * max(float(stats[f"x_{c}"]) for c in names)
    draws = [None if seed is None else np.random.default_rng(seed) for seed in seeds]
    size = min(nearest, len(names) - 1) + 2
    active = list(range(runs))
    pending: list[Round] = []
    for turn in range(max_iter):
        plans = {s: _round_equations(weights, gaps, nearest, draws[s]) for s in active}
        fits: Fits = {s: {} for s in active}
        for level in range(1 + max(e.level for plan in plans.values() for e in plan)):
            cross, moved = _level_sums(out.state, pending, plans, fits, level, means, out.rows, runs, size)
            if level == 0 and turn:  # whether the round before was the last one of a run shows in the first pass of the next
                active = [s for s in active if not moved[s] < limit]
                plans = {s: plans[s] for s in active}
                if len(pending) == write_every and active:
                    out.state, pending = rounds.advance(_next_state(out.state, pending, out.rows, runs)), []
            if not active:
                break
            for s, plan in plans.items():
                fits[s].update({e.target: _solve(cross[s, e.target], e, means) for e in plan if e.level == level})
        if not active:
            break
        pending.append((plans, {s: fits[s] for s in active}))
        for s in active:
            out.rounds[s] = turn + 1
    if pending:
        out.state = rounds.advance(_next_state(out.state, pending, out.rows, runs))
    return out


def _start_correlation(state: DataFrame, runs: Imputed, means: np.ndarray) -> np.ndarray:
    """Correlation of the columns with every gap at its mean."""
    x = [F.get("x", F.lit(i)) for i in range(len(means))]
    flat = state.select(*[F.when(F.isnan(c), F.lit(float(m))).otherwise(c).alias(n) for n, c, m in zip(runs.names, x, means)])
    return group_moments(flat, runs.names, shift=means)[0].correlation()


def _next_state(state: DataFrame, pending: Sequence[Round], rows_of: Callable[[pa.RecordBatch], _Rows], runs: int) -> DataFrame:
    """The state with the pending rounds in its fills."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = rows_of(batch)
            for s, new in enumerate(_caught_up(rows, pending, runs)[0]):
                rows.fills[:, s] = new[np.ix_(rows.holed, rows.gaps)]
            has = np.zeros(batch.num_rows, np.int64)
            has[rows.holed] = 1
            columns = {**dict(zip(batch.schema.names, batch.columns)), "fills": _lists(rows.fills, has)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return state.mapInArrow(work, state.schema)


def _lists(cells: np.ndarray, has: np.ndarray) -> pa.Array:
    """One list per row: a row of ``cells`` where ``has`` is 1, else none."""
    width = int(np.prod(cells.shape[1:]))
    offsets = np.concatenate([[0], np.cumsum(has * width)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel()))


def iterative_impute(df: DataFrame, columns: Sequence[str], *, key: str, max_iter: int = 100, tol: float = 0.1,
                     nearest: int = 3, seed: int | None = 0) -> DataFrame:
    """Fill the missing cells of ``columns``; all other cells and columns come back unchanged (runs jobs; see ``impute_runs``)."""
    runs = impute_runs(df, columns, key=key, seeds=(seed,), max_iter=max_iter, tol=tol, nearest=nearest)
    return runs.complete(df) if runs.gaps else df
