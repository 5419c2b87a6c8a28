"""The recurring analytic questions (Q1-Q16) as DataFrame functions.

Inputs are the job outputs: ``items`` (``jobs.item_facts``), ``scans`` (``jobs.shipment_scans``)
and ``metrics`` (``jobs.model_metrics_monthly``). Questions that group by a product or
facility attribute take the dimension and pre-aggregate by its key (``registry.Via``).
House rules: percentages 1 dp, confidence 3 dp, durations 0 dp, fail and warning
counted separately, "current" means the latest available period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualityframe.functions import measures as M
from qualityframe.operators.ranking import latest_period, latest_snapshot, ranked, top_k
from qualityframe.plans.jobs import model_metrics_monthly
from qualityframe.plans.registry import REGISTRY as R
from qualityframe.plans.registry import Dimension, Filter, Via, count_measure, evaluate, mean_measure, rate_measure


def _product_via(products: DataFrame) -> Via:
    return Via(["item_sku"], products, ["p_partkey"])


def _facility_via(facilities) -> Via:
    """``facilities``: an attach function (``jobs.facility_attach``) or an
    (s_suppkey, facility_id) frame."""
    if callable(facilities):
        return Via(["dock_id"], attach=facilities)
    return Via(["dock_id"], facilities, ["s_suppkey"])


def defect_rate_by_category(items: DataFrame, products: DataFrame) -> DataFrame:
    """Q1: inspections, failures and failure % per product category, worst first."""
    m = R.measures
    out = evaluate(
        items,
        [m["total_inspections"], m["failures"], m["defect_rate_pct"]],
        by=["product_category"],
        via=_product_via(products),
    )
    return out.orderBy(F.desc("defect_rate_pct"), F.asc("product_category"))


def this_period_rate(items: DataFrame, products: DataFrame, grain: str = "month") -> DataFrame:
    """Q9: Q1 per product, restricted to the latest period.

    The latest period is a range on the raw timestamp whose bound is a scalar subquery (it
    reads only that column).
    """
    m = R.measures
    latest = latest_period(items, "inspection_timestamp", grain)
    out = evaluate(
        latest,
        [m["total_inspections"], m["failures"], m["defect_rate_pct"]],
        by=["item_sku", "product_name"],
        via=_product_via(products),
    )
    return out.orderBy(F.desc("defect_rate_pct"), F.asc("item_sku"))


def latest_fp_rate(metrics: DataFrame, subquery: bool = False) -> DataFrame:
    """Q2: mean false-positive rate per facility in the latest evaluation month.

    ``subquery=True`` suits a published table partitioned by ``evaluation_date``: the
    maximum becomes a runtime partition filter, so only the latest month's files are read.
    """
    latest = latest_snapshot(metrics, "evaluation_date", subquery=subquery)
    out = latest.groupBy("facility_id").agg(M.mean("false_positive_rate_pct", 1).alias("avg_fp_rate"))
    return out.orderBy(F.desc_nulls_last("avg_fp_rate"), F.asc("facility_id"))


def latest_fp_rate_of_items(items: DataFrame, facilities) -> DataFrame:
    """Q2 from item facts: only the latest month's items are counted and compared."""
    latest = latest_period(items, "inspection_timestamp", "month")
    metrics = model_metrics_monthly(latest, facilities)
    out = metrics.groupBy("facility_id").agg(M.mean("false_positive_rate_pct", 1).alias("avg_fp_rate"))
    return out.orderBy(F.desc_nulls_last("avg_fp_rate"), F.asc("facility_id"))


def flagged_carriers(scans: DataFrame) -> DataFrame:
    """Q11: carriers by flagged shipments, most first, with their share of the carrier's shipments."""
    flagged = lambda: F.col("status") == "flagged"
    out = evaluate(
        scans, [count_measure("flagged_shipments", flagged), count_measure("total_scans"), rate_measure("flagged_pct", flagged, 1)],
        by=["carrier_name"],
    )
    return out.orderBy(F.desc("flagged_shipments"), F.asc("carrier_name"))


def carrier_ranking(scans: DataFrame, bounded: bool = False) -> DataFrame:
    """Q3: scans, mean damage %, flagged and rejected shipments per carrier, ranked.

    ``bounded=True``: the caller knows the carriers to be few (one task ranks them).
    """
    out = evaluate(
        scans,
        [
            count_measure("total_scans"),
            mean_measure("avg_damage_rate", "damage_rate_pct", 1),
            count_measure("flagged_shipments", lambda: F.col("status") == "flagged"),
            count_measure("rejected_shipments", lambda: F.col("status") == "rejected"),
        ],
        by=["carrier_name"],
    )
    return ranked(
        out, [F.desc_nulls_last("avg_damage_rate")], keys=["avg_damage_rate"], name="damage_rank",
        method="rank", tie_break=[F.asc("carrier_name")], bounded=bounded,
    )


def daily_trend(items: DataFrame) -> DataFrame:
    """Q4: inspections, passes and failures per day."""
    out = items.groupBy(M.bucket("inspection_timestamp", "day").alias("inspection_date")).agg(
        F.count(F.lit(1)).alias("total_inspections"),
        M.count_where(F.col("result") == "pass").alias("passed"),
        M.count_where(F.col("result") == "fail").alias("failed"),
    )
    return out.orderBy("inspection_date")


def version_comparison(metrics: DataFrame, model_name: str = "damage_detector") -> DataFrame:
    """Q5: mean F1, precision, recall (1 dp) and latency (0 dp) per version of one model."""
    out = (
        metrics.filter(F.col("model_name") == model_name)
        .groupBy("model_version")
        .agg(
            M.mean("f1_score_pct", 1).alias("avg_f1"),
            M.mean("precision_pct", 1).alias("avg_precision"),
            M.mean("recall_pct", 1).alias("avg_recall"),
            M.mean("avg_latency_ms", 0).alias("avg_latency"),
        )
    )
    return out.orderBy("model_version")


def best_version(metrics: DataFrame, model_name: str = "damage_detector") -> DataFrame:
    """Q6: versions of one model by mean F1, best first."""
    out = (
        metrics.filter(F.col("model_name") == model_name)
        .groupBy("model_version")
        .agg(M.mean("f1_score_pct", 1).alias("avg_f1"))
    )
    return out.orderBy(F.desc_nulls_last("avg_f1"), F.asc("model_version"))


def accuracy_by_facility(metrics: DataFrame, inspection_type: str = "damage_check") -> DataFrame:
    """Q10: "accuracy" = mean precision and recall per facility for one inspection type."""
    out = (
        metrics.filter(F.col("inspection_type") == inspection_type)
        .groupBy("facility_id")
        .agg(M.mean("precision_pct", 1).alias("avg_precision"), M.mean("recall_pct", 1).alias("avg_recall"))
    )
    return out.orderBy(F.desc_nulls_last("avg_precision"), F.asc("facility_id"))


def mean_duration_by_facility(scans: DataFrame, facilities: DataFrame) -> DataFrame:
    """Q7: mean scan duration of shipments (seconds, 0 dp) per facility."""
    out = evaluate(
        scans, [mean_measure("avg_scan_seconds", "total_scan_duration_seconds", 0)], by=["facility_id"],
        via=_facility_via(facilities),
    )
    return out.orderBy(F.desc("avg_scan_seconds"), F.asc("facility_id"))


def mean_duration_by_dock(scans: DataFrame, facilities: DataFrame) -> DataFrame:
    """Q12: mean scan duration of shipments (seconds, 0 dp) per (facility, dock)."""
    out = evaluate(
        scans, [mean_measure("avg_scan_seconds", "total_scan_duration_seconds", 0)], by=["facility_id", "dock_id"],
        via=_facility_via(facilities),
    )
    return out.orderBy(F.desc("avg_scan_seconds"), F.asc("facility_id"), F.asc("dock_id"))


def top_critical_items(items: DataFrame, products: DataFrame, k: int | None = None, critical: Filter | None = None) -> DataFrame:
    """Q8: SKUs by critical defects (ties broken by SKU): all of them, or the first ``k``.

    ``critical`` may replace the registry filter with an equivalent raw-column form
    (``jobs.severity_is``) so that part of it reaches the parquet scan."""
    out = evaluate(
        items, [count_measure("critical_defects")], by=["item_sku", "product_name"],
        where=[critical or R.filters["critical defects"]], via=_product_via(products),
    )
    order = [F.desc("critical_defects"), F.asc("item_sku")]
    return out.orderBy(*order) if k is None else top_k(out, order, k)


def inbound_rejected_rate(scans: DataFrame, inbound: Filter | None = None) -> DataFrame:
    """Q13: share of inbound shipments that were rejected (global, 1 dp); ``inbound`` may
    give a raw-column form of the registry filter."""
    rejected = lambda: F.col("status") == "rejected"
    return evaluate(
        scans,
        [
            count_measure("inbound_shipments"),
            count_measure("rejected_shipments", rejected),
            rate_measure("rejected_pct", rejected, 1),
        ],
        where=[inbound or R.filters["inbound shipments"]],
    )


def critical_trend(items: DataFrame, grain: str = "month", critical: Filter | None = None) -> DataFrame:
    """Q14: critical defects per period (``critical`` as in ``top_critical_items``)."""
    dim = R.dimensions["inspection_month"]
    if grain != "month":
        dim = Dimension(f"inspection_{grain}", lambda: M.bucket("inspection_timestamp", grain))
    out = evaluate(
        items, [count_measure("critical_defects")], by=[dim], where=[critical or R.filters["critical defects"]]
    )
    return out.orderBy(dim.name)


def mismatch_items(items: DataFrame, products: DataFrame, mismatch: Filter | None = None) -> DataFrame:
    """Q15: SKUs by number of label mismatches (``mismatch`` may give a raw-column form)."""
    mismatch = mismatch or Filter("label mismatches", lambda: F.col("defect_type") == "sku_mismatch")
    out = evaluate(
        items, [count_measure("mismatches")], by=["item_sku", "product_name"], where=[mismatch],
        via=_product_via(products),
    )
    return out.orderBy(F.desc("mismatches"), F.asc("item_sku"))


def mean_score_by_type(df: DataFrame, type_col: str, score_col: str, name: str = "avg_confidence") -> DataFrame:
    """Q16: mean score (3 dp) per type."""
    out = df.groupBy(type_col).agg(M.mean(score_col, 3).alias(name))
    return out.orderBy(type_col)


def metric_summary(items: DataFrame, by, via: Via | None = None) -> DataFrame:
    """Registry measures (count, confidence, defect rate, pass rate) per ``by``."""
    m = R.measures
    return evaluate(
        items,
        [m["total_inspections"], m["avg_confidence"], m["defect_rate_pct"], m["pass_rate"]],
        by=by,
        via=via,
    )


def defect_categories(items: DataFrame) -> DataFrame:
    """Items per defect group (Physical Damage, Label Issue, Count Error, None)."""
    return evaluate(items, [R.measures["total_inspections"]], by=[R.dimensions["defect_category"]])
