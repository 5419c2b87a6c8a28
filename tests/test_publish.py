"""Publishing: comments land as metadata, counts come from the write, drop reports."""

import pytest
from pyspark.sql import functions as F

from qualityframe.sources.publish import (
    drop_dataset,
    publish_all,
    resolve_target,
    validate_identifier,
)


def test_publish_all_comments_counts_and_drop(spark):
    schema = "qf_test_publish"
    a = spark.range(0, 1234).select(F.col("id").alias("shipment_id"), (F.col("id") % 3).alias("status"))
    b = spark.range(0, 7).select(F.col("id").alias("evaluation_date"))
    summary = publish_all(
        spark,
        {"dock_scans": a, "model_performance": b},
        schema=schema,
        comments={"dock_scans": {"shipment_id": "Shipment identifier"}},
    )
    assert summary["tables"] == {"dock_scans": 1234, "model_performance": 7}
    assert summary["total_rows"] == 1241
    desc = {r.col_name: r.comment for r in spark.sql(f"DESCRIBE TABLE {schema}.dock_scans").collect()}
    assert desc["shipment_id"] == "Shipment identifier"
    assert spark.table(f"{schema}.dock_scans").count() == 1234
    props = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {schema}.dock_scans").collect()}
    assert "One row per shipment" in props.get("Comment", "")
    # republish replaces, never appends
    publish_all(spark, {"dock_scans": a.limit(10)}, schema=schema)
    assert spark.table(f"{schema}.dock_scans").count() == 10
    out = drop_dataset(spark, schema)
    assert out["dropped"] and not out["notes"]
    assert schema not in [d.name for d in spark.catalog.listDatabases()]


def test_identifiers_are_validated(spark):
    for bad in ("a\n", "a b", "1abc", "x;DROP", ""):
        with pytest.raises(ValueError):
            validate_identifier(bad)
    assert validate_identifier("_ok_1") == "_ok_1"
    with pytest.raises(ValueError):
        drop_dataset(spark, "bad name")


def test_resolve_target_falls_back_to_current_catalog(spark):
    t = resolve_target(spark, catalog="no_such_catalog", schema="qc_demo")
    assert t["catalog"] == spark.catalog.currentCatalog() and t["catalog_fallback"]
    d = resolve_target(spark)
    assert d["schema"].startswith("quality_qc_") and not d["catalog_fallback"]


def test_latest_snapshot_prunes_published_partitions(spark):
    from conftest import SF0001

    from qualityframe.plans import questions
    from qualityframe.plans.catalog import QUERIES, _metrics, _t

    schema = "qf_test_pruning"
    metrics = _metrics(_t(spark, SF0001))
    publish_all(spark, {"model_performance": metrics}, schema=schema,
                partition_by={"model_performance": ["evaluation_date"]})
    table = spark.table(f"{schema}.model_performance")
    q = questions.latest_fp_rate(table, subquery=True)
    plan = q._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters: [isnotnull(evaluation_date" in line)
    assert "Subquery" in scan  # the latest month is applied as a runtime partition filter
    expected = sorted(tuple(r) for r in QUERIES["q_latest_snapshot_avg"](spark, SF0001).collect())
    assert sorted(tuple(r) for r in q.collect()) == expected
    drop_dataset(spark, schema)


def test_deploy_and_teardown(spark):
    from conftest import SF0001

    from qualityframe.plans.deploy import deploy, teardown

    result = deploy(spark, SF0001, schema="qf_test_deploy")
    assert set(result["tables"]) == {"inspection_events", "dock_scans", "model_performance"}
    assert result["tables"]["inspection_events"] == spark.table("qf_test_deploy.inspection_events").count()
    out = teardown(spark, **result)
    assert out["dropped"]
