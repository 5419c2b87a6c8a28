"""Registered queries over tables that they publish first, each in a schema of its own.

The published tables are derived from the input tables in full. Results are checkpointed before the
schema is dropped, so nothing is left behind and runs do not meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityframe.functions import measures as M
from qualityframe.plans import deploy, jobs
from qualityframe.plans.catalog import _facilities, _items, _metrics, _scans, _t, query
from qualityframe.plans.partials import DAY, MONTH, answer_from_partials, append_partials, publish_partials
from qualityframe.plans.registry import REGISTRY
from qualityframe.session import ensure_checkpoint_dir
from qualityframe.sources.footers import footer_bounds, latest_from_footers
from qualityframe.sources.publish import publish
from qualityframe.sources.tables import TABLE_NAMES
from qualityframe.sources.versions import commit_version, scratch_schema


def _kept(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _midpoint(df: DataFrame, column: str):
    """The day halfway between the first and the last of ``column``, a scalar subquery."""
    lo, hi = F.to_date(F.min(column)), F.to_date(F.max(column))
    return df.select(F.date_add(lo, (F.date_diff(hi, lo) / F.lit(2)).cast("int"))).scalar()


@query
def q_publish_summary(spark: SparkSession, source: str) -> DataFrame:
    """Publish T1-T3 as commented tables; rows that the published tables hold."""
    with scratch_schema(spark) as schema:
        deploy.deploy(spark, _t(spark, source), schema=schema)
        counts = [
            spark.table(f"{schema}.{name}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
            for name in deploy.TABLES
        ]
        return _kept(reduce(DataFrame.unionByName, counts))


@query
def q_scan_ids_in_loads(spark: SparkSession, source: str) -> DataFrame:
    """Shipments of the first half of the dates published, then all of them appended: new ids go on, old ones stay."""
    scans = _scans(_t(spark, source)).drop("o_orderpriority")
    early = scans.filter(F.col("scan_date") < _midpoint(scans, "scan_date"))
    with scratch_schema(spark) as schema:
        commit_version(jobs.scan_ids(early, deploy.SCAN_ID_BASE), "dock_scans", schema, loads=True, ids_after=deploy.SCAN_ID_BASE)
        deploy.append_shipments(spark, schema, scans)
        return _kept(spark.table(f"{schema}.dock_scans").select("scan_id", "shipment_id", "scan_date", "status"))


@query
def q_metric_by_month_stored(spark: SparkSession, source: str) -> DataFrame:
    """The answer of ``q_metric_by_month`` from stored parts by day and type: half of the days, then the rest appended."""
    items = _items(_t(spark, source))
    names = ("total_inspections", "avg_confidence", "defect_rate_pct", "pass_rate")
    measures, keys = [REGISTRY.measures[n] for n in names], [DAY, "inspection_type"]
    early = F.coalesce(F.to_date("inspection_timestamp") < _midpoint(items, "inspection_timestamp"), F.lit(False))
    with scratch_schema(spark) as schema:
        publish_partials(items.filter(early), measures, keys, "item_parts", schema)
        append_partials(items.filter(~early), measures, keys, "item_parts", schema)
        return _kept(answer_from_partials(spark, "item_parts", schema, measures, by=[MONTH]))


def items_of_shipments(items: DataFrame, scans: DataFrame) -> DataFrame:
    """Failed items and least confidence of every shipment that was flagged or rejected; no shuffle over published T1 and T2."""
    open_ones = scans.filter(F.col("status") != "completed").select("shipment_id", "status")
    joined = items.hint("merge").join(open_ones, "shipment_id")
    return joined.groupBy("shipment_id", "status").agg(
        M.count_where(F.col("result") == "fail").alias("failed_items"), F.min("confidence_score").alias("least_confidence")
    )


@query
def q_items_of_shipments(spark: SparkSession, source: str) -> DataFrame:
    with scratch_schema(spark) as schema:
        t = _t(spark, source)
        stored = {"bucket_by": (int(spark.conf.get("spark.sql.shuffle.partitions")), ["shipment_id"])}
        publish(_items(t), "inspection_events", schema, **stored)
        publish(_scans(t).drop("o_orderpriority"), "dock_scans", schema, **stored)
        return _kept(items_of_shipments(spark.table(f"{schema}.inspection_events"), spark.table(f"{schema}.dock_scans")))


@query
def q_latest_snapshot_from_footers(spark: SparkSession, source: str) -> DataFrame:
    """The answer of ``q_latest_snapshot_avg`` over published metrics, whose latest month the footers tell."""
    with scratch_schema(spark) as schema:
        publish(_metrics(_t(spark, source)), "model_performance", schema)
        latest = latest_from_footers(spark, "model_performance", schema, "evaluation_date")
        return _kept(latest.groupBy("facility_id").agg(M.mean("false_positive_rate_pct", 1).alias("avg_fp_rate")))


@query
def q_row_counts(spark: SparkSession, source: str) -> DataFrame:
    """Rows of every input table, from footers alone."""
    counts = [
        footer_bounds(spark, f"{source}/{name}.parquet").select(F.lit(name).alias("table_name"), "rows") for name in TABLE_NAMES
    ]
    return reduce(DataFrame.unionByName, counts)
