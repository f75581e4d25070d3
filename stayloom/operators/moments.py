"""Second moments of numeric columns, summed where the rows are.

Only the (p+1) x (p+1) sums per group leave the executors, so regressions and correlations over any number of rows need
one pass and a driver result whose size depends on the column count alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Moments:
    """Count, sums and cross products of ``columns`` after subtracting ``shift``; addable and re-centrable."""

    def __init__(self, columns: Sequence[str], shift: np.ndarray, cross: np.ndarray):
        self.columns = list(columns)
        self.shift = shift
        self.cross = cross

    @property
    def n(self) -> float:
        return self.cross[0, 0]

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.cross[0, 1:] / self.n

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.columns, self.shift, self.cross + other.cross)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.columns, self.shift, self.cross - other.cross)

    def centered(self, center: np.ndarray | None = None) -> np.ndarray:
        """Cross products of the columns around ``center`` (their own mean by default)."""
        c = (self.mean if center is None else center) - self.shift
        sums = self.cross[0, 1:]
        return self.cross[1:, 1:] - np.outer(c, sums) - np.outer(sums, c) + self.n * np.outer(c, c)

    def correlation(self) -> np.ndarray:
        s = self.centered()
        spread = np.sqrt(np.clip(np.diag(s), 0, None))
        with np.errstate(divide="ignore", invalid="ignore"):
            return s / np.outer(spread, spread)


def group_moments(df: DataFrame, columns: Sequence[str], *, group: Column | None = None,
                  shift: Sequence[float] | None = None) -> dict[int, Moments]:
    """Moments per integer group (0 when ungrouped) of rows without NULLs in ``columns``; runs one job.

    ``shift`` is subtracted first; values near the column means keep the sums accurate.
    """
    names = list(columns)
    offset = np.zeros(len(names)) if shift is None else np.asarray(shift, dtype=float)
    size = len(names) + 1

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch[names].to_numpy(dtype=float) - offset
            x = np.hstack([np.ones((len(x), 1)), x])
            groups = batch["_group"].to_numpy()
            for g in np.unique(groups):
                rows = x[groups == g]
                sums[int(g)] = sums.get(int(g), 0) + rows.T @ rows
        i, j = np.triu_indices(size)
        for g, m in sums.items():
            yield pd.DataFrame({"g": g, "i": i, "j": j, "v": m[i, j]})

    rows = (
        df.select((F.lit(0) if group is None else group).cast("int").alias("_group"),
                  *[F.col(c).cast("double").alias(c) for c in names])
        .dropna(subset=names)
        .mapInPandas(partial_sums, "g int, i int, j int, v double")
        .groupBy("g", "i", "j").agg(F.sum("v").alias("v")).collect()
    )
    cross: dict[int, np.ndarray] = {}
    for r in rows:
        m = cross.setdefault(r["g"], np.zeros((size, size)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return {g: Moments(names, offset, m) for g, m in cross.items()}


def column_means(df: DataFrame, columns: Sequence[str]) -> list[float]:
    row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return [0.0 if row[c] is None else float(row[c]) for c in columns]
