"""Connected components of a link table, by alternating star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gathered, release, within


def _both(first: tuple[str, str], second: tuple[str, str], *names: str) -> Column:
    """Two rows of each: its columns ``first``, and its columns ``second``. Unlike a union, it stays in the parts of the rows."""
    return F.inline(F.array(*[F.struct(*(F.col(c).alias(n) for c, n in zip(pair, names))) for pair in (first, second)]))


def _stars(pairs: DataFrame, down: bool) -> DataFrame:
    """Every node points its neighbours (the larger, or for ``down`` the smaller ones) at its least neighbour."""
    if down:
        near = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = pairs.select(_both(("a", "b"), ("b", "a"), "u", "v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = within(near.join(least, "u"), pairs)
    if down:
        out = out.select(_both(("v", "m"), ("u", "m"), "a", "b"))
    else:
        out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (a, b); the component is its smallest node.

    Rows with a null or a loop are passed over; direction and repeats do not matter. Each
    round contracts every path by more than half; a round is checkpointed, and the table of
    links never grows. Hubs are safe: a node's minimum is pre-aggregated in every task. Links in one part
    (``gathered``) are kept in one.
    """
    pairs = gathered(links.filter("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct())
    mark = None
    while True:
        got = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (got["n"], got["x"]) == mark or not got["n"]:
            break
        mark = (got["n"], got["x"])
        pairs = gathered(_stars(_stars(pairs, down=False), down=True))
        release(links.sparkSession)
    roots = pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
