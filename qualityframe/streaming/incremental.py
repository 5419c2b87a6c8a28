"""Q4 (inspections, passes, failures per day) over a stream of item rows."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityframe.functions import measures as M


def read_table_stream(spark: SparkSession, source: str, name: str, max_files_per_trigger: int = 16) -> DataFrame:
    """Stream the parquet files of table ``name`` (schema taken from the batch table).

    A table stored as a folder is streamed as that folder; a single-file table is streamed
    from its parent folder with a file-name filter (file streams watch folders).
    """
    path = os.path.join(source, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def _wall_time_as_utc(ts: Column) -> Column:
    """The instant whose UTC wall clock equals a TIMESTAMP_NTZ value (zone-independent);
    watermarks need an instant, and day windows then align with wall-clock days."""
    return F.make_timestamp(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts), F.lit("UTC")
    )


def daily_trend_stream(items: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Per-day totals of a streaming item frame (``jobs.item_facts`` applied to a stream).

    The watermark bounds the state: a day is emitted once events are ``lateness`` past it.
    Days are wall-clock days of the item timestamps whatever the session time zone.
    """
    start_day = F.date_from_unix_date((F.unix_seconds(F.col("w.start")) / F.lit(86400)).cast("int"))
    return (
        items.withColumn("_event_time", _wall_time_as_utc(F.col("inspection_timestamp")))
        .withWatermark("_event_time", lateness)
        .groupBy(F.window("_event_time", "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total_inspections"),
            M.count_where(F.col("result") == "pass").alias("passed"),
            M.count_where(F.col("result") == "fail").alias("failed"),
        )
        .select(start_day.alias("inspection_date"), "total_inspections", "passed", "failed")
    )
