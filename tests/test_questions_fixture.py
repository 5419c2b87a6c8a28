"""Questions on the hand-made rows of FIXTURES.md (section 2A/2B/2C) with hand answers."""

from conftest import d
from pyspark.sql import functions as F

from qualityframe.plans import jobs, questions
from qualityframe.plans.registry import REGISTRY, Via, count_measure, evaluate, mean_measure


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_q1_defect_rate_by_category(items, products):
    out = questions.defect_rate_by_category(items, products)
    assert [tuple(r) for r in out.collect()] == [
        ("Food", 3, 2, 66.7),
        ("Electronics", 2, 1, 50.0),
        ("Home", 1, 0, 0.0),
    ]


def test_q4_daily_trend(items):
    out = questions.daily_trend(items)
    assert [tuple(r) for r in out.collect()] == [
        (d("2025-11-03"), 2, 1, 1),
        (d("2025-11-04"), 1, 0, 0),
        (d("2025-12-01"), 2, 1, 1),
        (d("2025-12-02"), 1, 0, 1),
    ]


def test_q8_top_critical_ties_by_sku(items, products):
    out = questions.top_critical_items(items, products, k=10)
    assert [(r.item_sku, r.critical_defects) for r in out.collect()] == [("K1", 1), ("K2", 1)]
    assert questions.top_critical_items(items, products, k=1).count() == 1


def test_q9_latest_month_by_product(items, products):
    out = questions.this_period_rate(items, products)
    assert rows(out, "item_sku", "total_inspections", "defect_rate_pct") == [("K2", 2, 100.0), ("K3", 1, 0.0)]


def test_q14_critical_trend(items):
    out = questions.critical_trend(items)
    assert [tuple(r) for r in out.collect()] == [(d("2025-11-01"), 1), (d("2025-12-01"), 1)]


def test_q15_mismatch_items(items, products):
    out = questions.mismatch_items(items, products)
    assert [(r.item_sku, r.mismatches) for r in out.collect()] == [("K1", 1)]


def test_q16_mean_confidence_by_type(items):
    out = questions.mean_score_by_type(items, "inspection_type", "confidence_score")
    assert dict((r[0], r[1]) for r in out.collect()) == {"damage_check": 0.6, "item_count": 0.9, "label_scan": 0.5}


def test_registry_whole_table(items):
    m = REGISTRY.measures
    out = evaluate(items, [m["total_inspections"], m["avg_confidence"], m["defect_rate_pct"], m["pass_rate"]])
    assert tuple(out.first()) == (6, 0.617, 50.0, 33.3)



def test_defect_groups(items):
    out = questions.defect_categories(items)
    assert dict((r[0], r[1]) for r in out.collect()) == {"Label Issue": 2, "Physical Damage": 2, "None": 2}


def test_via_equals_direct_join(items, products):
    m = REGISTRY.measures
    ms = [m["total_inspections"], m["avg_confidence"], m["defect_rate_pct"]]
    via = evaluate(items, ms, by=["product_category"], via=Via(["item_sku"], products, ["p_partkey"]))
    joined = items.join(products, items.item_sku == products.p_partkey)
    direct = evaluate(joined, ms, by=["product_category"])
    assert sorted(map(tuple, via.collect())) == sorted(map(tuple, direct.collect()))


def test_via_direct_join_equals_preaggregation(items, products):
    m = REGISTRY.measures
    ms = [m["total_inspections"], m["avg_confidence"], m["defect_rate_pct"]]
    pre = evaluate(items, ms, by=["product_category"], via=Via(["item_sku"], products, ["p_partkey"]))
    direct = evaluate(items, ms, by=["product_category"],
                      via=Via(["item_sku"], products, ["p_partkey"], broadcast=True, preaggregate=False))
    assert sorted(map(tuple, pre.collect())) == sorted(map(tuple, direct.collect()))


def test_shipment_rollup(items):
    out = jobs.shipment_rollup(items, reject_above=0.85, flag_above=0.70)
    got = {
        r.shipment_id: (r.verified_item_count, r.items_passed, r.items_failed, r.items_warning, r.sku_match_rate_pct,
                        r.damage_rate_pct, r.total_scan_duration_seconds, r.status)
        for r in out.collect()
    }
    assert got == {
        "S1": (2, 1, 1, 0, 50.0, 0.0, 2700, "completed"),
        "S2": (1, 0, 0, 1, 100.0, 0.0, 0, "completed"),
        "S3": (3, 1, 2, 0, 100.0, 66.7, 122040, "completed"),
    }
    for r in out.collect():
        assert r.items_passed + r.items_failed + r.items_warning == r.verified_item_count


def test_shipment_status_thresholds(items):
    out = jobs.shipment_rollup(items, reject_above=0.6, flag_above=0.4)
    assert dict((r.shipment_id, r.status) for r in out.collect()) == {
        "S1": "flagged", "S2": "completed", "S3": "rejected",
    }


SCAN_ROWS = [
    (d("2025-11-03"), "WH-A", "D1", "inbound", 0, 10.0, 120, "completed"),
    (d("2025-11-04"), "WH-A", "D2", "inbound", 1, 5.0, 300, "flagged"),
    (d("2025-12-01"), "WH-B", "D1", "outbound", 0, 0.0, 180, "completed"),
    (d("2025-12-02"), "WH-B", "D1", "inbound", 1, 7.5, 240, "rejected"),
]
SCAN_SCHEMA = (
    "scan_date date, facility_id string, dock_id string, direction string, o_custkey int, damage_rate_pct double, "
    "total_scan_duration_seconds int, status string"
)


def test_q3_q11_carrier_ranking(spark):
    scans = spark.createDataFrame(SCAN_ROWS, SCAN_SCHEMA)
    carriers = spark.createDataFrame([(0, "Alpha"), (1, "Beta")], "c_custkey int, carrier_name string")
    scans = scans.join(carriers, F.col("o_custkey") == F.col("c_custkey"))
    flagged = questions.flagged_carriers(scans)
    assert [tuple(r) for r in flagged.collect()] == [("Beta", 1, 2, 50.0), ("Alpha", 0, 2, 0.0)]
    for bounded in (True, False):
        out = questions.carrier_ranking(scans, bounded=bounded)
    got = sorted(tuple(r[c] for c in ("carrier_name", "total_scans", "avg_damage_rate", "flagged_shipments",
                                       "rejected_shipments", "damage_rank")) for r in out.collect())
    assert got == [("Alpha", 2, 5.0, 0, 0, 2), ("Beta", 2, 6.3, 1, 1, 1)]


def test_q7_q12_q13_scans(spark):
    scans = spark.createDataFrame(SCAN_ROWS, SCAN_SCHEMA)
    secs = mean_measure("avg_scan_seconds", "total_scan_duration_seconds", 0)
    by_fac = evaluate(scans, [secs], by=["facility_id"])
    assert rows(by_fac, "facility_id", "avg_scan_seconds") == [("WH-A", 210.0), ("WH-B", 210.0)]
    by_dock = evaluate(scans, [secs], by=["facility_id", "dock_id"])
    assert rows(by_dock, "facility_id", "dock_id", "avg_scan_seconds") == [
        ("WH-A", "D1", 120.0), ("WH-A", "D2", 300.0), ("WH-B", "D1", 210.0)]
    assert tuple(questions.inbound_rejected_rate(scans).first()) == (3, 1, 33.3)
    flagged = evaluate(scans, [count_measure("flagged", lambda: F.col("status") == "flagged")], by=["o_custkey"])
    assert rows(flagged, "o_custkey", "flagged") == [(0, 0), (1, 1)]


PRED_SCHEMA = "ts timestamp_ntz, model_name string, model_version string, facility_id string, predicted int, actual int"


def _pred_rows():
    import datetime as _dt

    out = []
    jan, feb = _dt.datetime(2025, 1, 10), _dt.datetime(2025, 2, 10)
    out += [(jan, "M", "v1.0", "WH-A", 1, 1)] * 3 + [(jan, "M", "v1.0", "WH-A", 1, 0)]
    out += [(jan, "M", "v1.0", "WH-A", 0, 1)] + [(jan, "M", "v1.0", "WH-A", 0, 0)] * 5
    out += [(feb, "M", "v1.0", "WH-A", 0, 0)] * 2
    out += [(feb, "M", "v1.1", "WH-A", 1, 1), (feb, "M", "v1.1", "WH-A", 0, 1)]
    return out


def test_confusion_metrics(spark):
    from qualityframe.functions.measures import bucket

    preds = spark.createDataFrame(_pred_rows(), PRED_SCHEMA).withColumn("evaluation_date", bucket("ts", "month"))
    out = jobs.model_metrics(preds, ["evaluation_date", "model_version", "facility_id"], with_latency=False)
    got = sorted(
        (str(r.evaluation_date), r.model_version, r.precision_pct, r.recall_pct, r.f1_score_pct,
         r.false_positive_rate_pct, r.false_negative_rate_pct, r.total_inferences)
        for r in out.collect()
    )
    assert got == [
        ("2025-01-01", "v1.0", 75.0, 75.0, 75.0, 16.7, 25.0, 10),
        ("2025-02-01", "v1.0", None, None, None, 0.0, None, 2),
        ("2025-02-01", "v1.1", 100.0, 50.0, 66.7, None, 50.0, 2),
    ]
    q2 = questions.latest_fp_rate(out)
    assert [tuple(r) for r in q2.collect()] == [("WH-A", 0.0)]


def test_shared_product_name_keeps_skus_apart(spark, items):
    products = spark.createDataFrame(
        [("K1", "Same", "Electronics"), ("K2", "Same", "Food"), ("K3", "Bulb", "Home")],
        "p_partkey string, product_name string, product_category string",
    )
    out = questions.top_critical_items(items, products, k=10)
    assert [(r.item_sku, r.product_name, r.critical_defects) for r in out.collect()] == [
        ("K1", "Same", 1), ("K2", "Same", 1)]


def test_q9_day_grain(items, products):
    out = questions.this_period_rate(items, products, grain="day")
    assert rows(out, "item_sku", "total_inspections", "failures") == [("K2", 1, 1)]
