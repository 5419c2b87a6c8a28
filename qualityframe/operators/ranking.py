"""Latest-period snapshots, explicit ranks and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualityframe.functions.columns import ColumnLike, to_col
from qualityframe.functions.measures import bucket
from qualityframe.operators.ids import sequence_id


def latest_snapshot(
    df: DataFrame, date_col: ColumnLike, grain: str | None = None, subquery: bool = False
) -> DataFrame:
    """Rows of the latest date (or latest ``grain`` bucket: 'month', 'day', ...).

    Ties are all kept; an empty input gives an empty output. ``subquery=True`` applies
    the maximum as a scalar-subquery filter instead (best when ``df`` is a plain scan:
    the subquery reads only the date column).
    """
    target = bucket(date_col, grain) if grain else to_col(date_col)
    if subquery:
        latest = df.select(F.max(target)).scalar()
        return df.filter(target == latest)
    # One-row max joined back: both sides share the same source subtree, so Spark plans
    # the source's exchanges once and reuses them (a subquery would recompute the source).
    # NULL dates can never equal the max; dropping them up front keeps both branches
    # identical (otherwise the optimizer infers the filter for one branch only and the
    # shared exchanges are no longer reused).
    src = df.filter(target.isNotNull())
    top = F.broadcast(src.agg(F.max(target).alias("_qf_latest")))
    return src.join(top, target == F.col("_qf_latest"), "inner").drop("_qf_latest")


def latest_period(df: DataFrame, ts: str, grain: str) -> DataFrame:
    """Rows of the latest ``grain`` period of column ``ts`` (rows without a time drop out).

    The period's start is computed inside a scalar subquery and compared with the raw column, so a
    scan can skip row groups, and nothing of earlier periods reaches what follows.
    """
    start = df.select(bucket(F.max(ts), grain).cast(df.schema[ts].dataType)).scalar()
    return df.filter(F.col(ts) >= start)


def top_k(df: DataFrame, order_by: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows in ``order_by`` order (give a tie-break for a stable answer).

    Planned as TakeOrderedAndProject: each task keeps its own k best rows and only those
    k x tasks rows meet in the final merge; the input is never fully sorted or shuffled.
    """
    if k < 0:
        raise ValueError("k must be >= 0")
    return df.orderBy(*order_by).limit(k)


def ranked(
    df: DataFrame,
    order_by: Sequence[Column],
    keys: Sequence[str],
    name: str = "rank",
    method: str = "rank",
    tie_break: Sequence[ColumnLike] = (),
    bounded: bool = False,
) -> DataFrame:
    """Add an explicit rank following ``order_by`` over the values of ``keys``.

    * ``row``: 1..n, ties broken by ``tie_break``;
    * ``dense``: equal key values share a rank, no gaps;
    * ``rank``: equal key values share the smallest row number (gaps after ties).

    By default built from ``sequence_id`` (parallel), never a window over one partition.
    ``bounded=True`` is for inputs whose size the caller can prove small, such as one row
    per value of a fixed dimension domain: those are ranked with an ordinary window in a
    single task, which avoids the extra jobs of the parallel form.
    """
    if method not in ("row", "dense", "rank"):
        raise ValueError("method must be 'row', 'dense' or 'rank'")
    if bounded:
        fn = {"row": F.row_number, "dense": F.dense_rank, "rank": F.rank}[method]
        order = [*order_by, *[to_col(c) for c in tie_break]] if method == "row" else list(order_by)
        return df.withColumn(name, fn().over(Window.orderBy(*order)).cast("long"))
    if method == "row":
        return sequence_id(df, [*order_by, *tie_break], start=1, name=name)
    if method == "dense":
        values = df.select(*keys).distinct()
        ids = sequence_id(values, order_by, start=1, name=name)
        return _join_null_safe(df, ids.select(*keys, name), keys)
    numbered = sequence_id(df, [*order_by, *tie_break], start=1, name="_qf_rn")
    first = numbered.groupBy(*keys).agg(F.min("_qf_rn").alias(name))
    return _join_null_safe(numbered, first, keys).drop("_qf_rn")


def _join_null_safe(df: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join ``ranks`` (one row per key value) back to ``df``; NULL key values match too,
    so rows with a NULL measure keep their rank instead of disappearing."""
    r = ranks.select(*[F.col(k).alias(f"_qf_k_{k}") for k in keys], *[c for c in ranks.columns if c not in keys])
    cond = [df[k].eqNullSafe(r[f"_qf_k_{k}"]) for k in keys]
    return df.join(r, cond, "inner").drop(*[f"_qf_k_{k}" for k in keys])
