"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a counted side may be broadcast.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count (that stops at ``limit``) proves it small, else as it is: Spark shuffles the join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
