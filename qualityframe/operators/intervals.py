"""Validity intervals: every row gets the interval in force at its time.

Intervals of a key may overlap, leave gaps, and be open on either side; where several hold, the
one that began last is in force (then the one that ends later, an open end being the latest; then the greater attributes).
They are first cut into segments that do not overlap. Rows and segments are then united and
sorted by time, and each row takes the last segment before it: one window, no range join. The
windows are cut by calendar period and by salt, so that a key with a third of all rows is spread; a segment
is repeated in every period that it reaches into.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FIRST, _LAST = "DATE'0001-01-01'", "DATE'9999-12-31'"


def segments(intervals: DataFrame, key: str, start: str, end: str, attributes: Sequence[str]) -> DataFrame:
    """(key, seg_start, seg_end, attributes): what is in force between neighbouring starts and ends of a key.

    ``start`` is included, ``end`` excluded; NULL means open. Gaps give no rows, nor do intervals
    that end before they begin. Intervals of one key meet in an array: a schedule, not facts.
    """
    own = intervals.filter(F.col(key).isNotNull()).select(
        key, F.coalesce(F.col(start).cast("date"), F.expr(_FIRST)).alias("s"),
        F.coalesce(F.col(end).cast("date"), F.expr(_LAST)).alias("e"), F.struct(*attributes).alias("a"),
    ).filter("s < e")
    per_key = own.groupBy(key).agg(F.collect_set(F.struct("s", "e", "a")).alias("all"))
    bounds = F.array_sort(F.array_distinct(F.concat(F.transform("all", lambda i: i["s"]), F.transform("all", lambda i: i["e"]))))
    per_key = per_key.withColumn("bounds", bounds)
    cut = F.transform(
        "bounds",
        lambda b, k: F.struct(
            b.alias("seg_start"), F.get("bounds", k + 1).alias("seg_end"),
            F.array_max(F.filter("all", lambda i: (i["s"] <= b) & (b < i["e"])))["a"].alias("a"),
        ),
    )
    out = per_key.select(key, F.explode(cut).alias("seg")).filter("seg.a IS NOT NULL AND seg.seg_end IS NOT NULL")
    return out.select(key, "seg.seg_start", "seg.seg_end", "seg.a.*")


def in_force(
    facts: DataFrame,
    key: str,
    ts: str,
    intervals: DataFrame,
    start: str,
    end: str,
    attributes: Sequence[str],
    grain: str = "month",
    salts: int = 8,
) -> DataFrame:
    """Rows of ``facts`` with the ``attributes`` of the interval in force on their day; rows that none covers drop out.

    ``intervals`` has ``key``, ``start``, ``end`` (dates, see ``segments``) and ``attributes``, whose
    names must not be those of fact columns. Rows with a NULL key or time are covered by none.
    """
    clash = sorted(set(attributes) & set(facts.columns))
    if clash:
        raise ValueError(f"attributes are named like fact columns: {clash}")
    day = F.to_date(F.col(ts))
    rows = facts.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)).cast("int")
    tagged = rows.select(
        F.col(key).alias("_key"), F.trunc(day, grain).alias("_period"), spread.alias("_salt"), day.alias("_at"), F.lit(1).alias("_tag"),
        F.struct(*rows.columns).alias("_row"),
    )
    # segments are repeated in the periods of the facts that they reach into, once for every salt
    span = rows.select(F.struct(F.trunc(F.min(day), grain).alias("lo"), F.max(day).alias("hi"))).scalar()
    seg = segments(intervals, key, start, end, attributes).withColumns({"lo": span["lo"], "hi": span["hi"]})
    seg = seg.withColumns({
        "lo": F.greatest(F.trunc("seg_start", grain), "lo"), "hi": F.least(F.date_sub("seg_end", 1), "hi"),
    }).filter("lo <= hi")
    step = F.expr({"week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}[grain])
    seg = seg.withColumn("_period", F.explode(F.sequence("lo", "hi", step)))
    seg = seg.select(
        F.col(key).alias("_key"), "_period", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
        F.greatest("seg_start", "_period").alias("_at"), F.lit(0).alias("_tag"),
        F.struct(F.col("seg_end").alias("until"), F.struct(*attributes).alias("a")).alias("_seg"),
    )
    both = tagged.unionByName(seg, allowMissingColumns=True)
    window = Window.partitionBy("_key", "_period", "_salt").orderBy("_at", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_seg", F.last("_seg", ignorenulls=True).over(window)).filter("_tag = 1 AND _at < _seg.until")
    return found.select("_row.*", "_seg.a.*")
