"""Difference of two tables by a tree of order-free digests.

Each side is aggregated once to digests of key ranges (row count and two sums of row hashes,
which do not depend on the order of rows). Ranges of ranges add up to a tree. The sides'
trees are compared from the top, and only ranges that differ are entered; only rows of differing
leaf ranges are shuffled and compared one by one. Digests can be kept with a published table, which
then need not be read where it has not changed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from qualityframe.operators.compare import diff_results
from qualityframe.session import ensure_checkpoint_dir

#: Keys of a leaf range; ranges of a node; levels above the leaves.
WIDTH, FAN_OUT, LEVELS = 1024, 64, 3
#: Differing leaves that are broadcast to the rows; with more of them nearly everything is shuffled anyway.
BROADCAST_LEAVES = 200_000
_SUMS = ("n", "d1", "d2")


def leaf_of(df: DataFrame, keys: Sequence[str], width: int) -> Column:
    """The leaf range of a row: ``width`` neighbouring values of a single whole-number key, else a share of the key's hashes."""
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, IntegralType):
        return F.coalesce(F.expr(f"`{keys[0]}` div {width}"), F.lit(-(1 << 62)))
    return F.pmod(F.xxhash64(*keys), F.lit(FAN_OUT**LEVELS))


def key_digests(df: DataFrame, keys: Sequence[str], columns: Sequence[str], width: int = WIDTH) -> DataFrame:
    """(leaf, n, d1, d2): rows and digests of every leaf range of ``df``; one partial aggregate, small enough to store."""
    hashes = [F.xxhash64(F.lit(seed), *[F.struct(F.col(c), F.col(c).isNull()) for c in [*keys, *columns]]) for seed in (1, 2)]
    return df.groupBy(leaf_of(df, keys, width).alias("leaf")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(h.cast("decimal(20,0)")).alias(d) for h, d in zip(hashes, _SUMS[1:])]
    )


def _checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _level(digests: DataFrame, height: int) -> DataFrame:
    node = F.expr(f"leaf div {FAN_OUT**height}")
    return digests.groupBy(node.alias("node")).agg(*[F.sum(c).alias(c) for c in _SUMS])


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes whose digests differ or that one side lacks."""
    r = right.select(F.col("node").alias("_node"), *[F.col(c).alias(f"_{c}") for c in _SUMS])
    both = left.join(r, left["node"] == r["_node"], "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SUMS])
    return both.filter(~same).select(F.coalesce("node", "_node").alias("node"))


def differing_leaves(left: DataFrame, right: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(leaf): leaf ranges in which two ``key_digests`` differ, found from the top of the tree down (a stored frame)."""
    nodes = _checkpointed(_differing(_level(left, levels), _level(right, levels)))
    for height in range(levels - 1, -1, -1):
        parent = F.expr(f"leaf div {FAN_OUT ** (height + 1)}")
        sides = [side.join(nodes, parent == nodes["node"], "left_semi") for side in (left, right)]
        nodes = _checkpointed(_differing(*[_level(side, height) for side in sides]))
    return nodes.select(F.col("node").alias("leaf"))


def diff_by_digest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str] | None = None,
    width: int = WIDTH,
    left_digests: DataFrame | None = None,
    right_digests: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``diff_results(left, right, keys, compare)``, comparing rows only where digests differ.

    Digests of a side may be handed in (``key_digests`` with the same keys, columns and width,
    stored earlier). Two ranges are equal if counts and two 64-bit hash sums are. NULL keys form a
    range. A repeated key is reported only where its range differs, as equal ranges are not entered.
    """
    columns = list(compare) if compare is not None else [c for c in left.columns if c not in keys]
    wanted = [*keys, *columns]
    sides = [left.select(*wanted), right.select(*wanted)]
    given = [left_digests, right_digests]
    digests = [d if d is not None else _checkpointed(key_digests(s, keys, columns, width)) for s, d in zip(sides, given)]
    leaves = differing_leaves(*digests)
    if leaves.count() > BROADCAST_LEAVES:
        return diff_results(*sides, keys, columns)
    few = F.broadcast(leaves)
    sides = [s.join(few, leaf_of(s, keys, width) == few["leaf"], "left_semi") for s in sides]
    return diff_results(*sides, keys, columns)
