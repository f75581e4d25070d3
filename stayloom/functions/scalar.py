"""Scalar column expressions shared by the cohort, cleaning and modelling operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def as_double(col: Column) -> Column:
    """Text to double; unreadable text becomes NULL instead of failing the job."""
    return col.try_cast("double")


def parse_timestamp(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to a timestamp without zone, NULL when unreadable."""
    return text.try_cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours with their fraction (a whole-hour difference would let 24 h 59 m pass as 24)."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(MICROS_PER_HOUR))


def days_between(start: Column, end: Column) -> Column:
    return hours_between(start, end) / F.lit(24.0)


def hours(n: int | Column) -> Column:
    """An interval of ``n`` hours."""
    count = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(F.lit(0), count.cast("int"))


def clean_numeric(text: Column, junk: Sequence[str]) -> Column:
    """Remove every junk text, read an empty rest as NULL, and convert the rest to double."""
    for token in junk:
        text = F.replace(text, F.lit(token), F.lit(""))
    return as_double(F.nullif(text, F.lit("")))


def midpoint(low: Column, high: Column) -> Column:
    return (low + high) / F.lit(2.0)


def mean_arterial_pressure(systolic: Column, diastolic: Column) -> Column:
    return (systolic - diastolic) / F.lit(3.0) + diastolic


def larger_of(a: Column, b: Column, missing: int | float = 0) -> Column:
    """The larger of two values, a missing one counted as ``missing``."""
    return F.greatest(F.coalesce(a, F.lit(missing)), F.coalesce(b, F.lit(missing)))


def or_false(cond: Column) -> Column:
    """A predicate with an else branch: unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def presence(col: Column) -> Column:
    return col.isNotNull()


def rate(amount: Column, units: Column) -> Column:
    """Amount per unit; NULL for zero units."""
    return F.try_divide(amount, units)


def round_half_even(col: Column) -> Column:
    return F.rint(col)


def prefix(code: Column, length: int = 3) -> Column:
    return F.substring(code, 1, length)


def recode(df: DataFrame, mapping: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Recode text categories to numbers, column by column, for the columns that exist.

    Text outside a column's mapping is read as a number where it is one, else NULL. Boolean columns become 1 and 0 and
    numeric ones stay.
    """
    types = dict(df.dtypes)
    exprs = {}
    for name, values in mapping.items():
        kind = types.get(name)
        if kind == "boolean":
            exprs[name] = F.col(name).cast("int")
        elif kind == "string":
            expr = F.col(name).try_cast("int")
            for text, number in values.items():
                expr = F.when(F.col(name) == text, F.lit(number)).otherwise(expr)
            exprs[name] = expr
    return df.withColumns(exprs) if exprs else df


def sum_flags(columns: Sequence[str]) -> Column:
    """Sum of text flags; a missing or unreadable flag counts as zero."""
    total = F.lit(0.0)
    for name in columns:
        total = total + F.coalesce(as_double(F.col(f"`{name}`")), F.lit(0.0))
    return total


def one_hot(label: Column) -> Column:
    """Two-class target: ``[1, 0]`` from 0.5 upwards, otherwise ``[0, 1]``."""
    return F.when(label >= 0.5, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))


def nearer_corner(first: Column, second: Column) -> Column:
    """Decode a two-value output to the class of the nearer one-hot corner; a tie gives class 1."""
    to_one = (first - 1) * (first - 1) + second * second
    to_zero = first * first + (second - 1) * (second - 1)
    return F.when(to_one > to_zero, F.lit(0)).otherwise(F.lit(1))


def threshold_score(value: Column, cuts: Sequence[tuple[float, int]], *, when: str, missing: int | None = 0,
                    otherwise: int = 0) -> Column:
    """Score by the first cut that holds. ``when`` is the comparison (``lt``, ``gt`` or ``ge``).

    ``missing`` is the score of a NULL value; pass None to keep it NULL.
    """
    compare = {"lt": lambda c: value < c, "gt": lambda c: value > c, "ge": lambda c: value >= c}[when]
    expr = F.when(value.isNull(), F.lit(missing).cast("int"))
    for cut, score in cuts:
        expr = expr.when(compare(F.lit(float(cut))), F.lit(score))
    return expr.otherwise(F.lit(otherwise))
