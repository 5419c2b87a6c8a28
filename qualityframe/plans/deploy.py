"""Build and publish the three tables in one call, add later loads, and remove them again.

``deploy`` resolves the target (existing catalog or the current one; schema given or
derived from the user) and publishes T1 once; T2 and T3 are built from the published T1. T1 and
T2 are stored in sorted buckets of the shipment, so that items meet their shipments without a
shuffle. Row counts come from the writes themselves. ``append_shipments`` adds new shipments to T2
with ids that go on from the stored mark. A plain dict is returned that ``teardown`` accepts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from qualityframe.plans import jobs
from qualityframe.sources.publish import drop_dataset, open_target, publish_all, resolve_target
from qualityframe.sources.tables import Tables
from qualityframe.sources.versions import append_load, pointer, version_table

TABLES = ("inspection_events", "dock_scans", "model_performance")
#: Stored with T1 for later builds, not shown: what the rollup and the model metrics need besides T1's columns.
STORED_ONLY = ("l_linenumber", "l_discount", "l_quantity")
SCAN_ID_BASE = 10000


def build_tables(t: Tables, schema: str) -> dict[str, DataFrame | Callable[[], DataFrame]]:
    """T1 over the input tables; T2 and T3, built when their turn comes, over the published T1."""
    def published() -> DataFrame:
        return version_table(t.spark, "inspection_events", schema)

    return {
        "inspection_events": jobs.item_outcomes(t.lineitem, t.part, t.supplier, t.nation, extra=STORED_ONLY),
        "dock_scans": lambda: jobs.scan_ids(
            jobs.shipment_scans(jobs.shipment_rollup(published()), t.orders, t.customer), SCAN_ID_BASE
        ),
        "model_performance": lambda: jobs.model_metrics_monthly(published(), facility="facility_id"),
    }


def layouts(buckets: int, partition_by: Mapping[str, Sequence[str]]) -> dict[str, dict[str, object]]:
    """How T1 and T2 are stored; a table that the caller partitions is not bucketed as well."""
    out: dict[str, dict[str, object]] = {
        "inspection_events": {"columns": jobs.ITEM_COLUMNS},
        "dock_scans": {"loads": True, "ids_after": SCAN_ID_BASE},
    }
    for name in out:
        if name not in partition_by:
            out[name]["bucket_by"] = (buckets, ["shipment_id"])
    return out


def deploy(
    spark: SparkSession,
    source: str | Tables,
    catalog: str | None = None,
    schema: str | None = None,
    partition_by: Mapping[str, Sequence[str]] | None = None,
    buckets: int | None = None,
) -> dict:
    """Publish T1-T3 built from ``source`` (a folder of parquet tables, ``catalog:<schema>``
    or a ``Tables``); returns the target, per-table row counts and the total.

    ``buckets`` defaults to the session's shuffle partitions: size it so that a bucket of
    items fits a task. A catalog that refuses the schema is replaced by the current one.
    """
    t = source if isinstance(source, Tables) else Tables(spark, source)
    before = spark.catalog.currentCatalog()
    number = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        target = open_target(spark, resolve_target(spark, catalog, schema), before, "Quality-control analytics tables")
        plain = target["catalog"] != "spark_catalog"  # buckets and loads are a matter of Spark's own catalog
        summary = publish_all(
            spark, build_tables(t, target["schema"]), schema=target["schema"], partition_by=partition_by,
            layouts={} if plain else layouts(number, partition_by or {}),
        )
    finally:
        spark.catalog.setCurrentCatalog(before)
    return {**target, **summary}


def append_shipments(spark: SparkSession, schema: str, scans: DataFrame) -> int:
    """Add the shipments of ``scans`` (``jobs.shipment_scans``) that T2 does not have yet; returns their number.

    Published ids never change. New ones go on from the stored high-water mark in T2's
    order, so all loads together are dense and unique. Shipments arrive whole: lines that
    follow later do not change a published one. A repeated call adds nothing.
    """
    at = pointer(spark, "dock_scans", schema)
    if at is None or at.high_water is None:
        raise ValueError(f"{schema}.dock_scans is not published in numbered loads")
    known = version_table(spark, "dock_scans", schema).select("shipment_id")
    new = scans.join(known, "shipment_id", "left_anti")
    return append_load(jobs.scan_ids(new, at.high_water), "dock_scans", schema)


def teardown(spark: SparkSession, schema: str, catalog: str | None = None, **_: object) -> dict:
    """Drop the published schema of the catalog it was published to (``teardown(spark, **deploy(...))`` works)."""
    return drop_dataset(spark, schema, catalog)
