"""Row counts and extremes from Parquet footers, without reading a column.

Spark's second-generation Parquet source answers COUNT, MIN and MAX of numbers, dates and
booleans from the files' footers when nothing but partition filters stands in between. It is used through
a session of its own, so that the caller's settings stay. Timestamps and strings are
not answered that way (their footers may be inexact); such columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityframe.sources.versions import pointer

_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_session(spark: SparkSession) -> SparkSession:
    """A session over the same application whose Parquet aggregates come from footers."""
    own = spark.newSession()
    for key, value in _SETTINGS.items():
        own.conf.set(key, value)
    return own


def footer_bounds(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """One row: ``rows`` and, for each column, ``min_<column>`` and ``max_<column>``, of the Parquet files in ``path``."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return footer_session(spark).read.parquet(path).agg(*aggs)


def table_path(spark: SparkSession, name: str, schema: str) -> str:
    """Where the rows of a published table are (of all its loads, also one that is being written)."""
    at = pointer(spark, name, schema)
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {schema}.{at.current if at else name}").collect()
    return next(r["data_type"] for r in rows if r["col_name"] == "Location")


def latest_from_footers(spark: SparkSession, name: str, schema: str, column: str) -> DataFrame:
    """Rows of ``schema.name`` with the latest value of ``column``, which the footers tell (one value to the driver).

    The value becomes a literal, so it reaches the scan as a pushed filter. An empty table gives no rows.
    Take a table that is written whole, not one in loads.
    """
    at = footer_bounds(spark, table_path(spark, name, schema), [column]).first()[f"max_{column}"]
    rows = spark.table(f"{schema}.{name}")
    return rows.filter(F.lit(False) if at is None else F.col(column) == F.lit(at))
