"""
invariants that must hold on any input."""

from conftest import SF001
from pyspark.sql import functions as F

from qualityframe.plans import jobs
from qualityframe.plans.catalog import QUERIES, _facilities, _items, _t


def test_shipment_rollup_matches_survey_figures(spark):
    r = QUERIES["q_shipment_rollup"](spark, SF001)
    assert dict(r.groupBy("status").count().collect()) == {"completed": 6837, "flagged": 5834, "rejected": 2072}
    assert r.filter(F.col("expected_item_count") != F.col("verified_item_count")).count() == 12733
    bad = r.filter(F.col("items_passed") + F.col("items_failed") + F.col("items_warning") != F.col("verified_item_count"))
    assert bad.count() == 0


def test_model_metrics_invariants(spark):
    m = QUERIES["q_model_metrics_monthly"](spark, SF001)
    assert m.filter(F.abs(F.col("false_negative_rate_pct") + F.col("recall_pct") - 100) > 0.1001).count() == 0
    for c in ("precision_pct", "recall_pct", "f1_score_pct", "false_positive_rate_pct", "false_negative_rate_pct"):
        assert m.filter((F.col(c) < 0) | (F.col(c) > 100)).count() == 0
    # every item is scored by every version
    assert m.agg(F.sum("total_inferences")).first()[0] == 3 * 60000


def test_wide_metrics_equal_long_form(spark):
    t = _t(spark, SF001)
    items = _items(t)
    wide = jobs.model_metrics_monthly(items)  # per dock, no facility join
    preds = jobs.predictions(items).withColumn("evaluation_date", F.trunc(F.to_date("ts"), "month"))
    long = jobs.model_metrics(
        preds.withColumnRenamed("dock_id", "facility_id"),
        ["evaluation_date", "model_name", "model_version", "inspection_type", "facility_id"],
    )
    cols = wide.columns
    assert wide.exceptAll(long.select(*cols)).count() == 0
    assert long.select(*cols).exceptAll(wide).count() == 0


def test_item_classification_is_total(spark):
    items = _items(_t(spark, SF001))
    out = items.agg(
        F.count_if(F.col("result").isNull()).alias("no_result"),
        F.count_if(F.col("inspection_type").isNull()).alias("no_type"),
        F.count_if((F.col("result") != "pass") & (F.col("defect_type").isNull() | F.col("severity").isNull())).alias("x"),
        F.count_if((F.col("result") == "pass") & (F.col("defect_type").isNotNull() | F.col("severity").isNotNull())).alias("y"),
    ).first()
    assert tuple(out) == (0, 0, 0, 0)


def test_facility_preaggregation_equals_row_join(spark):
    t = _t(spark, SF001)
    via = jobs.model_metrics_monthly(_items(t), _facilities(t))
    joined = jobs.with_facility(_items(t), t.supplier, t.nation)
    direct = jobs.model_metrics_monthly(joined.drop("dock_id").withColumnRenamed("facility_id", "dock_id"))
    assert via.exceptAll(direct.select(*via.columns)).count() == 0
