"""Small helpers for accepting either column names or Column expressions."""

from __future__ import annotations

from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Union[Column, str]


def to_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(v: object) -> Column:
    """Column as is, plain Python values as literals (floats become DOUBLE literals)."""
    return v if isinstance(v, Column) else F.lit(v)
