"""Publishing tables: schema, column comments, row counts, drop.

* Writes are staged and committed by one swap (``versions``); columns and table are
  documented by the statement that commits them.
* Row counts come from an ``Observation`` attached to the write: no second scan.
* Identifiers are validated before any DDL (full-match, no trailing newline accepted).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from qualityframe.sources.versions import commit_version, sql_text, validate_identifier

#: What the columns of the three published tables hold here, and which input they come from.
COLUMN_COMMENTS: dict[str, dict[str, str]] = {
    "inspection_events": {
        "inspection_id": "INS- and the rank of the row by ship date, order and line",
        "inspection_timestamp": "Ship date of the order line",
        "facility_id": "Nation of the line's supplier; NULL if the supplier is not listed",
        "dock_id": "Supplier key",
        "shipment_id": "Order key",
        "item_sku": "Part key",
        "product_name": "Name of the part; NULL if the part is not listed",
        "product_category": "Type of the part",
        "inspection_type": "By line number modulo 3",
        "result": "By return flag: R fail, A warning, N pass",
        "confidence_score": "1 minus the discount",
        "defect_type": "By inspection type and tax rate; NULL for a pass",
        "severity": "By quantity; NULL for a pass",
        "processing_time_ms": "Quantity of the line",
    },
    "dock_scans": {
        "scan_id": "SCN- and a number that stays with the shipment when later loads are added",
        "shipment_id": "Order key",
        "scan_date": "Latest ship date among the lines",
        "facility_id": "Nation of the dock's supplier; NULL if the supplier is not listed",
        "dock_id": "Supplier key of the lowest line",
        "direction": "inbound for the two urgent order priorities, else outbound; NULL if the order is not listed",
        "carrier_name": "Market segment of the ordering customer",
        "expected_item_count": "Highest line number",
        "verified_item_count": "Lines found",
        "items_passed": "Lines with flag N",
        "items_failed": "Lines with flag R",
        "items_warning": "Lines with flag A",
        "sku_match_rate_pct": "100 x lines without sku_mismatch / lines",
        "damage_rate_pct": "100 x lines with a damage defect / lines",
        "total_scan_duration_seconds": "First to last ship date, in seconds",
        "status": "By the share of failed lines",
    },
    "model_performance": {
        "evaluation_date": "Month of the ship date, as its first day",
        "model_name": "Model that serves the inspection type",
        "model_version": "Version whose discount threshold predicts a failure",
        "inspection_type": "By line number modulo 3",
        "facility_id": "Nation of the supplier",
        "precision_pct": "100 x true positives / predicted failures",
        "recall_pct": "100 x true positives / failures",
        "f1_score_pct": "2 P R / (P + R) of the two columns before",
        "false_positive_rate_pct": "100 x false positives / lines that did not fail",
        "false_negative_rate_pct": "100 x false negatives / failures",
        "total_inferences": "Lines in the group",
        "avg_latency_ms": "Mean quantity of the lines",
    },
}


#: Table documentation of the three published tables.
TABLE_COMMENTS: dict[str, str] = {
    "inspection_events": "One row per inspected item: outcome, defect, severity and confidence",
    "dock_scans": "One row per shipment: item counts, match and damage rates, scan status",
    "model_performance": "One row per month, model, version and facility: confusion-matrix metrics",
}


DEFAULT_SCHEMA_BASENAME = "quality_qc"


def current_user_slug(spark: SparkSession) -> str:
    """Slug of ``current_user()`` (part before '@', non-alphanumerics -> '_', lower case)."""
    from qualityframe.functions.text import slugify

    slug = spark.range(1).select(slugify(F.current_user()).alias("s")).first()["s"]
    if not slug:
        raise ValueError("could not derive a schema name from current_user(); pass one explicitly")
    return slug


def resolve_target(spark: SparkSession, catalog: str | None = None, schema: str | None = None) -> dict:
    """Where to publish: ``catalog`` if it exists (else the current catalog: catalogs are
    not created from Spark SQL), ``schema`` or ``<basename>_<user slug>``."""
    current = spark.catalog.currentCatalog()
    wanted = catalog or current
    validate_identifier(wanted, "catalog")
    names = {c.name for c in spark.catalog.listCatalogs()}
    resolved = wanted if wanted in names else current
    name = schema or f"{DEFAULT_SCHEMA_BASENAME}_{current_user_slug(spark)}"
    validate_identifier(name, "schema")
    return {
        "catalog": resolved,
        "schema": name,
        "fqn": f"{resolved}.{name}",
        "catalog_fallback": resolved != wanted,
    }


def with_comments(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    """Attach column comments as metadata (lands in DESCRIBE after a saveAsTable)."""
    for col, text in comments.items():
        if col in df.columns:
            df = df.withMetadata(col, {"comment": text})
    return df


#: Errors of a catalog that does not let this user create or see a schema: the current catalog is tried instead.
REFUSED = ("PERMISSION", "UNAUTHORIZED", "FORBIDDEN", "ACCESS_DENIED", "NOT_SUPPORTED", "UNSUPPORTED", "READ_ONLY", "CATALOG_NOT_FOUND")


def ensure_schema(spark: SparkSession, schema: str, comment: str | None = None) -> str:
    validate_identifier(schema, "schema")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}" + (f" COMMENT {sql_text(comment)}" if comment else ""))
    return schema


def open_target(spark: SparkSession, target: Mapping[str, object], fallback: str, comment: str | None = None) -> dict:
    """Make ``target``'s schema, in ``fallback`` if its own catalog refuses; the catalog that has it becomes the current one.

    Other errors, and a refusal of the fallback itself, are raised. ``catalog_fallback`` tells.
    """
    spark.catalog.setCurrentCatalog(str(target["catalog"]))
    try:
        ensure_schema(spark, str(target["schema"]), comment)
    except Exception as exc:
        refused = any(word in re.sub(r"[ -]", "_", str(exc).upper()) for word in REFUSED)
        if not refused or target["catalog"] == fallback:
            raise
        spark.catalog.setCurrentCatalog(fallback)
        ensure_schema(spark, str(target["schema"]), comment)
        return {**target, "catalog": fallback, "fqn": f"{fallback}.{target['schema']}", "catalog_fallback": True}
    return dict(target)


def publish(
    df: DataFrame,
    name: str,
    schema: str,
    comments: Mapping[str, str] | None = None,
    partition_by: Sequence[str] = (),
    table_comment: str | None = None,
    **layout: object,
) -> int:
    """Write ``df`` as ``schema.name`` (full replace, see ``versions``); return its row count.

    ``layout`` takes the further arguments of ``versions.commit_version``. A catalog other than
    Spark's own has its own way of replacing a table at once, which is used there.
    """
    validate_identifier(name, "table")
    validate_identifier(schema, "schema")
    spark = df.sparkSession
    if spark.catalog.currentCatalog() == "spark_catalog":
        return commit_version(df, name, schema, comments, table_comment, partition_by, **layout)
    told = Observation(f"rows_{name}")
    writer = with_comments(df, comments or {}).observe(told, F.count(F.lit(1)).alias("rows")).writeTo(f"{schema}.{name}")
    if partition_by:
        writer = writer.partitionedBy(*[F.col(c) for c in partition_by])
    if table_comment:
        writer = writer.tableProperty("comment", table_comment)
    writer.createOrReplace()
    return int(told.get["rows"])


def publish_all(
    spark: SparkSession,
    tables: Mapping[str, DataFrame | Callable[[], DataFrame]],
    schema: str,
    comments: Mapping[str, Mapping[str, str]] = COLUMN_COMMENTS,
    schema_comment: str = "Quality-control analytics tables",
    partition_by: Mapping[str, Sequence[str]] | None = None,
    table_comments: Mapping[str, str] = TABLE_COMMENTS,
    layouts: Mapping[str, Mapping[str, object]] | None = None,
) -> dict:
    """Publish several tables into one schema; return a run summary.

    Each table is one write job whose row count is observed during the write; tables are
    written in order, and one given as a function is built when its turn comes, so that it can
    read those before it.
    """
    ensure_schema(spark, schema, schema_comment)
    counts: dict[str, int] = {}
    for name, df in tables.items():
        counts[name] = publish(
            df() if callable(df) else df, name, schema, comments.get(name), (partition_by or {}).get(name, ()),
            table_comments.get(name), **(layouts or {}).get(name, {}),
        )
    return {
        "catalog": spark.catalog.currentCatalog(),
        "schema": schema,
        "tables": counts,
        "total_rows": sum(counts.values()),
        "table_names": [f"{schema}.{n}" for n in counts],
    }


def drop_dataset(spark: SparkSession, schema: str, catalog: str | None = None) -> dict:
    """DROP SCHEMA .. CASCADE in ``catalog`` (the current one by default); failures are reported, not raised."""
    validate_identifier(schema, "schema")
    full = f"{validate_identifier(catalog, 'catalog')}.{schema}" if catalog else schema
    notes: list[str] = []
    try:
        spark.sql(f"DROP SCHEMA IF EXISTS {full} CASCADE")
        dropped = True
    except Exception as exc:  # reported to the caller, as a teardown should not half-fail
        dropped = False
        notes.append(str(exc))
    return {"schema": schema, "dropped": dropped, "notes": notes}
