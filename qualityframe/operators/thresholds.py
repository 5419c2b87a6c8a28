"""Confusion counts at every threshold from one histogram of the score.

A version predicts a positive where the score exceeds its threshold. Instead of four counts
for each version, rows are counted once by the interval between neighbouring thresholds
that their score lies in; sums over the intervals above a threshold give all its counts. The
aggregate has the same two counts however many versions there are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many thresholds are compared one by one (compiled); more are searched by halving.
FEW = 8


def interval_of(score: Column, cuts: Sequence[float]) -> Column:
    """How many of the ascending ``cuts`` lie below ``score``; NULL for a NULL score."""
    if len(cuts) <= FEW:
        at = F.lit(0)
        for c in cuts:
            at = at + (score > F.lit(float(c))).cast("int")
        return at + F.when(score.isNull(), F.lit(None).cast("int")).otherwise(0)
    table = F.array(*[F.lit(float(c)) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    found = F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when((at + step <= len(cuts)) & (score > F.get(table, at + step - 1)), at + step).otherwise(at),
    )
    return F.when(score.isNotNull(), found)


def _up_to(counts: Column) -> Column:
    """Running sums of an array."""
    first = F.array().cast("array<bigint>")
    return F.aggregate(counts, first, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))


def _filled(held: Column, intervals: Column, count: str) -> Column:
    """The counts of all intervals, 0 where a group has no rows."""
    return F.transform(intervals, lambda k: F.coalesce(F.try_element_at(held, k)[count], F.lit(0).cast("bigint")))


def confusion_by_threshold(
    df: DataFrame,
    keys: Sequence[str],
    score: Column,
    positive: Column,
    versions: Sequence[tuple[str, float]],
    sums: Mapping[str, Column],
    via: tuple[Sequence[str], Callable[[DataFrame], DataFrame], Sequence[str]] | None = None,
) -> DataFrame:
    """(keys, model_version, _tp, _fp, _fn, _tn, sums): counts of every version in every group.

    ``sums`` are further aggregates of the whole group that add up (counts, sums). ``via`` =
    (fact keys, attach, attached columns) counts by fact keys first, then attaches the
    dimension and merges. Rows with a NULL score or truth are in no count, but in the ``sums``.
    Groups hold one row per interval at most (versions + 1) before they become arrays.
    """
    ordered = sorted({float(t) for _, t in versions})
    place = {t: k for k, t in enumerate(ordered)}
    binned = df.withColumns({"_bin": interval_of(score, ordered), "_pos": positive})
    parts = {"_p": F.count_if(F.col("_pos")), "_q": F.count_if(~F.col("_pos")), **sums}
    names = list(parts)
    if via is not None:
        fact_keys, attach, attached = via
        binned = attach(binned.groupBy(*fact_keys, *keys, "_bin").agg(*[c.alias(a) for a, c in parts.items()]))
        keys = [*keys, *attached]
        parts = {a: F.sum(a) for a in names}
    bins = binned.groupBy(*keys, "_bin").agg(*[c.alias(a) for a, c in parts.items()])
    held = F.when(F.col("_bin").isNotNull(), F.struct(F.col("_bin").alias("k"), F.struct("_p", "_q").alias("v")))
    groups = bins.groupBy(*keys).agg(F.map_from_entries(F.collect_list(held)).alias("_at"), *[F.sum(a).alias(a) for a in sums])
    every = F.sequence(F.lit(0), F.lit(len(ordered)))
    groups = groups.withColumns({f"_below{c}": _up_to(_filled(F.col("_at"), every, c)) for c in ("_p", "_q")}).drop("_at")
    told = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(place[float(t)]).alias("k")) for v, t in versions])
    out = groups.withColumn("_v", F.explode(told))
    fn, tn = F.get("_below_p", F.col("_v.k")), F.get("_below_q", F.col("_v.k"))
    return out.select(
        *keys, F.col("_v.v").alias("model_version"), (F.element_at("_below_p", -1) - fn).alias("_tp"),
        (F.element_at("_below_q", -1) - tn).alias("_fp"), fn.alias("_fn"), tn.alias("_tn"), *sums,
    )
