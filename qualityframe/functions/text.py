"""Identifier and timestamp helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qualityframe.functions.columns import ColumnLike, lit_or_col, to_col


def slugify(col: ColumnLike) -> Column:
    """Part before '@', runs of non-alphanumerics -> '_', outer '_' stripped, lower case.

    An input that leaves nothing (e.g. '@@') gives NULL instead of an error, so a bad row
    cannot fail a whole job.
    """
    head = F.substring_index(to_col(col), "@", 1)
    joined = F.regexp_replace(head, r"[^A-Za-z0-9]+", "_")
    stripped = F.lower(F.regexp_replace(joined, r"^_+|_+$", ""))
    return F.when(stripped == "", F.lit(None).cast("string")).otherwise(stripped)


def format_id(prefix: str, n: ColumnLike, width: int = 7) -> Column:
    """``prefix`` + n left-padded with zeros to ``width``; wider numbers are kept whole.

    Plain LPAD truncates (12345678 -> '1234567'), which silently makes ids collide once a
    table outgrows the width; here the id just gets longer.
    """
    s = to_col(n).cast("string")
    padded = F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))
    return F.concat(F.lit(prefix), padded)


def assemble_timestamp(date: ColumnLike, hour: object, minute: object, second: object = 0) -> Column:
    """TIMESTAMP_NTZ from a date and clock parts; independent of the session time zone."""
    d = to_col(date)
    return F.make_timestamp_ntz(
        F.year(d), F.month(d), F.dayofmonth(d), lit_or_col(hour), lit_or_col(minute), lit_or_col(second)
    )
