"""Calendar spines, panels (every key x date cell), densification and date validity.

Sizes: a spine has one row per day or month between its bounds, so it is bounded by
the calendar (about 3,700 rows per decade of days), not by the fact table. Panels are
generated per key row with ``explode`` rather than joined, so the keyed side keeps its
partitioning and no join of any kind is planned.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityframe.functions.columns import ColumnLike, to_col
from qualityframe.operators.sizes import broadcast_if_small
from qualityframe.session import default_parallelism

_STEPS = ("day", "month")


def _as_date(value: dt.date | str) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


def _months_between(start: dt.date, end: dt.date) -> int:
    return (end.year - start.year) * 12 + (end.month - start.month)


def date_spine(
    spark: SparkSession,
    start: dt.date | str,
    end: dt.date | str,
    step: str = "day",
    name: str = "d",
    num_partitions: int | None = None,
) -> DataFrame:
    """One row per day (or month start) in [start, end], built in parallel from ``range``.

    ``EXPLODE(SEQUENCE(..))`` would build the whole calendar inside one task; ``range``
    spreads it over ``num_partitions`` tasks, so work keyed by the calendar starts out parallel.
    """
    if step not in _STEPS:
        raise ValueError(f"step must be one of {_STEPS}")
    s, e = _as_date(start), _as_date(end)
    if step == "month":
        s = s.replace(day=1)
        e = e.replace(day=1)
        n = _months_between(s, e) + 1
    else:
        n = (e - s).days + 1
    n = max(n, 0)
    parts = num_partitions or max(1, min(default_parallelism(spark), n or 1))
    base = spark.range(0, n, 1, parts)
    if step == "day":
        col = F.date_add(F.lit(s), F.col("id").cast("int"))
    else:
        col = F.add_months(F.lit(s), F.col("id").cast("int"))
    return base.select(col.alias(name))


def spine_from_bounds(
    bounds: DataFrame,
    start: ColumnLike,
    end: ColumnLike,
    step: str = "day",
    name: str = "d",
) -> DataFrame:
    """Spine whose bounds come from data (a one-row frame, e.g. ``agg(min, max)``).

    No value travels through the driver: the bounds row is exploded into the calendar
    where it lies. The output is calendar-sized (see module note).
    """
    if step not in _STEPS:
        raise ValueError(f"step must be one of {_STEPS}")
    s, e = F.to_date(to_col(start)), F.to_date(to_col(end))
    if step == "month":
        s, e = F.trunc(s, "month"), F.trunc(e, "month")
        interval = F.expr("INTERVAL 1 MONTH")
    else:
        interval = F.expr("INTERVAL 1 DAY")
    return bounds.select(F.explode(F.sequence(s, e, interval)).alias(name))


def weekdays_only(df: DataFrame, col: ColumnLike) -> DataFrame:
    """Monday..Friday rows (Spark ``dayofweek``: 1 = Sunday, so weekdays are 2..6)."""
    return df.filter(F.dayofweek(to_col(col)).between(2, 6))


def calendar(start: ColumnLike | dt.date | str, end: ColumnLike | dt.date | str, step: str = "day") -> Column:
    """ARRAY of the days (or month starts) in [start, end]. Bounds may be literals, row
    columns or scalar subqueries (``df.select(F.min(..)).scalar()``)."""
    if step not in _STEPS:
        raise ValueError(f"step must be one of {_STEPS}")

    def bound(v):
        if isinstance(v, (dt.date, dt.datetime)):
            return F.lit(_as_date(v))
        if isinstance(v, str):
            return F.to_date(F.lit(v))
        return F.to_date(v)

    s, e = bound(start), bound(end)
    if step == "month":
        return F.sequence(F.trunc(s, "month"), F.trunc(e, "month"), F.expr("INTERVAL 1 MONTH"))
    return F.sequence(s, e, F.expr("INTERVAL 1 DAY"))


def panel(
    base: DataFrame,
    calendar_bounds: tuple | None = None,
    step: str = "day",
    name: str = "d",
    values: Mapping[str, Sequence[object]] | None = None,
) -> DataFrame:
    """Skeleton with one row per (base row, value of each inline list, calendar day).

    Every combination is generated per base row with ``explode`` (a Generate inside the
    scan stage), not with a join: ``base`` keeps its partitioning, nothing is broadcast
    and the output grows linearly with the base rows. ``calendar_bounds`` is (start, end)
    as literals or scalar subqueries; ``values`` maps new column names to inline lists.
    """
    out = base
    for col, vals in (values or {}).items():
        out = out.withColumn(col, F.explode(F.array(*[F.lit(v) for v in vals])))
    if calendar_bounds is not None:
        start, end = calendar_bounds
        out = out.withColumn(name, F.explode(calendar(start, end, step)))
    return out


def densify(
    facts: DataFrame,
    skeleton: DataFrame,
    keys: Sequence[str],
    fill: Mapping[str, object],
) -> DataFrame:
    """Give every skeleton cell a row: left join the facts, fill their measures.

    ``facts`` must have at most one row per key cell (aggregate first). Both sides are
    hash-partitioned on the keys, or the facts are broadcast when AQE sees they are small.
    """
    joined = skeleton.join(facts, list(keys), "left")
    return joined.fillna(dict(fill))


def effective_from(
    df: DataFrame,
    key: str,
    date_col: ColumnLike,
    schedule: DataFrame,
    valid_from: str = "valid_from",
    broadcast_schedule: bool = False,
) -> DataFrame:
    """Keep rows whose ``key`` is already in effect on their date (date >= valid_from).

    The schedule is one row per key (e.g. per model version); keys missing from it are
    dropped. ``broadcast_schedule`` asks for a broadcast, which a count of the schedule
    must allow; otherwise Spark's size-checked join selection decides.
    """
    sched = schedule.select(F.col(key), F.col(valid_from).alias("_qf_valid_from"))
    if broadcast_schedule:
        sched = broadcast_if_small(sched)
    joined = df.join(sched, key, "inner")
    return joined.filter(F.to_date(to_col(date_col)) >= F.col("_qf_valid_from")).drop("_qf_valid_from")
