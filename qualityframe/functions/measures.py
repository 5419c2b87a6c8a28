"""Aggregate and scalar building blocks shared by every question.

Rounding: doubles are rounded once, half-up, on the decimal value people read (0.285 -> 0.29,
0.284999999999 -> 0.28), not on the binary neighbour of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qualityframe.functions.columns import ColumnLike, to_col


def round_half_up(col: ColumnLike, digits: int) -> Column:
    """ROUND half-up on the decimal reading of a double; result is DOUBLE."""
    return F.round(to_col(col).cast("double"), digits)


def count_where(predicate: Column) -> Column:
    """Number of rows where ``predicate`` holds (0 on no match, never NULL)."""
    return F.count_if(predicate)


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """numerator / denominator as DOUBLE, NULL when the denominator is 0 or NULL."""
    den = to_col(denominator).cast("double")
    return to_col(numerator).cast("double") / F.nullif(den, F.lit(0.0))


def rate_pct(numerator: ColumnLike, denominator: ColumnLike, digits: int | None = 1) -> Column:
    """100 * numerator / denominator, rounded half-up; NULL on an empty group."""
    value = F.lit(100.0) * ratio(numerator, denominator)
    return value if digits is None else round_half_up(value, digits)


def mean(col: ColumnLike, digits: int | None = None) -> Column:
    """AVG, optionally rounded half-up."""
    value = F.avg(to_col(col))
    return value if digits is None else round_half_up(value, digits)


def harmonic_mean(a: ColumnLike, b: ColumnLike) -> Column:
    """2ab / (a + b); NULL when a + b is 0 or either side is NULL."""
    a, b = to_col(a).cast("double"), to_col(b).cast("double")
    return F.lit(2.0) * a * b / F.nullif(a + b, F.lit(0.0))


def clamp(col: ColumnLike, lo: float, hi: float) -> Column:
    """Bound ``col`` to [lo, hi]; NULL stays NULL (GREATEST/LEAST alone would skip it)."""
    c = to_col(col)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c.cast("double")))
    )


def bucket(ts: ColumnLike, grain: str) -> Column:
    """Calendar bucket of a date or timestamp as a DATE (day, week, month, quarter, year).

    ``trunc`` on the DATE keeps the result independent of the session time zone,
    for both TIMESTAMP and TIMESTAMP_NTZ inputs.
    """
    day = F.to_date(to_col(ts))
    grain = grain.lower()
    if grain == "day":
        return day
    if grain in ("week", "month", "quarter", "year"):
        return F.trunc(day, grain)
    raise ValueError(f"unsupported grain {grain!r}")
