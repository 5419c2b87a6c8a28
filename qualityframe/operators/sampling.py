"""Reproducible hash sampling: constant rate, per-row (stratified) rate, whole clusters.

A row is kept iff ``hash_fraction(seed, salt, keys) < rate``. Because the decision is
a pure function of the key values it is a plain Filter: Catalyst can push it into a
join condition, it never shuffles, and the same rows come back whatever the
partitioning, row order, retry or cluster size. Nested rates give nested samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualityframe.functions.columns import ColumnLike, lit_or_col
from qualityframe.functions.hashing import FULL_GRID, hash_fraction, key_columns


def sample_fraction(
    keys: Sequence[ColumnLike], seed: int | str = 42, salt: str = "sample", method: str = "murmur3",
    grid: int | None = None,
) -> Column:
    return hash_fraction(seed, salt, *keys, grid=grid, method=method)


def hash_sample(
    df: DataFrame,
    rate: float | Column,
    keys: Sequence[ColumnLike],
    seed: int | str = 42,
    salt: str = "sample",
    method: str = "murmur3",
    grid: int | None = None,
) -> DataFrame:
    """Keep rows whose key fraction is below ``rate``.

    * constant sample: ``rate`` a float, ``keys`` the row key;
    * stratified sample: ``rate`` a Column (e.g. a ``classify`` rule on the stratum);
    * cluster sample: ``keys`` the group key only, so a group is kept or dropped whole.
    """
    if isinstance(rate, (int, float)) and not 0.0 <= float(rate) <= 1.0:
        raise ValueError("rate must lie in [0, 1]")
    if isinstance(rate, (int, float)):
        steps = float(rate) * (grid or FULL_GRID[method])
        if 0 < steps < 1 or (grid and abs(steps - round(steps)) > 1e-6):
            raise ValueError(f"rate {rate} cannot be held on a grid of {grid or FULL_GRID[method]} steps")
    if not keys:
        raise ValueError("hash_sample needs at least one key column")
    frac = sample_fraction(keys, seed=seed, salt=salt, method=method, grid=grid)
    rate_col = lit_or_col(float(rate) if isinstance(rate, (int, float)) else rate)
    return df.filter(frac < rate_col.cast("double"))


def sample_exact(
    df: DataFrame,
    k: int | Column,
    strata: Sequence[str],
    keys: Sequence[ColumnLike],
    seed: int = 42,
    salt: str = "exact",
    slices: int = 64,
) -> DataFrame:
    """Exactly ``k`` rows of every stratum (all of a smaller one): those least by the md5 of their keys.

    ``k`` may be an expression of the strata's columns. No task sorts a stratum: each keeps its
    least rows of every slice of a stratum (Spark applies the limit before the shuffle), and
    the ``k`` x ``slices`` rows that are left of a stratum are ranked, so a hot stratum costs as much as any other.
    Equal keys are told apart by the other columns; NULL strata are a stratum.
    """
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in key_columns(seed, salt, tuple(keys))]))
    marked = df.withColumn("_qf_md5", digest)
    marked = marked.withColumn("_qf_slice", F.pmod(F.xxhash64("_qf_md5"), F.lit(slices)).cast("int"))
    for group in ([*strata, "_qf_slice"], [*strata]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("_qf_md5", *df.columns))
        marked = marked.withColumn("_qf_rank", rank).filter(F.col("_qf_rank") <= k).drop("_qf_rank")
    return marked.drop("_qf_md5", "_qf_slice")
