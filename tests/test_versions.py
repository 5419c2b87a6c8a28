"""Published versions: staged writes, swaps, loads, ids that go on, refused schemas."""

import pytest
from pyspark.sql import functions as F

from qualityframe.plans import deploy, jobs
from qualityframe.sources import publish as publishing
from qualityframe.sources.versions import (
    append_load,
    commit_version,
    pointer,
    scratch_schema,
    sweep,
    version_table,
)


def rows(spark, name):
    return sorted(tuple(r) for r in spark.table(name).collect())


def failing(df, at):
    """``df`` whose task fails at row ``at``, after other rows were written."""
    return df.withColumn("id", F.when(F.col("id") == at, F.raise_error(F.lit("no more"))).otherwise(F.col("id")).cast("long"))


def test_failed_write_leaves_the_old_rows(spark):
    with scratch_schema(spark, "qf_test") as s:
        assert commit_version(spark.range(5).withColumn("v", F.lit("old")), "t", s) == 5
        before = rows(spark, f"{s}.t")
        with pytest.raises(Exception, match="no more"):
            commit_version(failing(spark.range(0, 100000, 1, 8), 99999).withColumn("v", F.lit("new")), "t", s)
        assert rows(spark, f"{s}.t") == before
        assert [t.name for t in spark.catalog.listTables(s) if "__v" in t.name] == [pointer(spark, "t", s).current]


def test_swap_changes_rows_and_schema_at_once_and_keeps_one_version(spark):
    with scratch_schema(spark, "qf_test") as s:
        commit_version(spark.range(3), "t", s, {"id": "it's one"}, "a \\ table")
        reader = spark.table(f"{s}.t")
        first = pointer(spark, "t", s).current
        commit_version(spark.range(4).select((F.col("id") * 2).alias("twice"), F.lit(1).alias("hidden")), "t", s, columns=["twice"])
        assert reader.count() == 3  # a reader of the old version goes on
        assert spark.table(f"{s}.t").columns == ["twice"] and version_table(spark, "t", s).columns == ["twice", "hidden"]
        assert pointer(spark, "t", s).previous == first
        commit_version(spark.range(1), "t", s)
        assert not spark.catalog.tableExists(f"{s}.{first}")
        assert spark.table(f"{s}.t").count() == 1


def test_comments_and_a_plain_table_of_the_name(spark):
    with scratch_schema(spark, "qf_test") as s:
        spark.range(2).write.saveAsTable(f"{s}.t")
        commit_version(spark.range(3), "t", s, {"id": "it's \\ one"}, "what's this")
        desc = spark.sql(f"DESCRIBE TABLE EXTENDED {s}.t").collect()
        assert next(r.comment for r in desc if r.col_name == "id") == "it's \\ one"
        assert "what's this" in {r.data_type for r in desc if r.col_name == "Comment"}
        assert spark.table(f"{s}.t").count() == 3


def test_loads_show_whole_or_not_at_all(spark):
    with scratch_schema(spark, "qf_test") as s:
        commit_version(spark.range(3), "t", s, loads=True, ids_after=10, bucket_by=(2, ["id"]))
        assert append_load(spark.range(3, 6), "t", s) == 3
        with pytest.raises(Exception, match="no more"):
            append_load(failing(spark.range(6, 100000, 1, 8), 99999), "t", s)
        assert rows(spark, f"{s}.t") == [(k,) for k in range(6)]
        assert append_load(spark.range(6, 8), "t", s) == 2  # what the failed attempt left is replaced
        assert rows(spark, f"{s}.t") == [(k,) for k in range(8)] and pointer(spark, "t", s).high_water == 18
        commit_version(spark.range(1), "whole", s)
        with pytest.raises(ValueError):
            append_load(spark.range(1), "whole", s)


def test_sweep_drops_only_versions_without_a_name(spark):
    with scratch_schema(spark, "qf_test") as s:
        commit_version(spark.range(1), "t", s)
        spark.range(1).write.saveAsTable(f"{s}.t__v0000000000001_0123abcd")
        assert sweep(spark, s) == ["t__v0000000000001_0123abcd"] and spark.table(f"{s}.t").count() == 1


def scans(spark, ids, day):
    values = {c: F.lit(None).cast("string") for c in jobs.SCAN_COLUMNS[1:]}
    values |= {"shipment_id": F.col("id"), "scan_date": F.lit(day).cast("date"), "facility_id": F.lit("F"), "dock_id": F.col("id") % 2}
    return spark.createDataFrame([(i,) for i in ids], "id long").select(*[values[c].alias(c) for c in jobs.SCAN_COLUMNS[1:]])


def test_scan_ids_go_on_and_old_ones_stay(spark):
    with scratch_schema(spark, "qf_test") as s:
        commit_version(jobs.scan_ids(scans(spark, [5, 3, 4], "2025-01-02"), 10000), "dock_scans", s, loads=True, ids_after=10000)
        first = dict(spark.table(f"{s}.dock_scans").select("shipment_id", "scan_id").collect())
        assert first == {4: "SCN-0010001", 3: "SCN-0010002", 5: "SCN-0010003"}
        # an earlier day that comes later, and shipments that are known
        assert deploy.append_shipments(spark, s, scans(spark, [1, 2, 3], "2025-01-01")) == 2
        assert deploy.append_shipments(spark, s, scans(spark, [1, 2, 3], "2025-01-01")) == 0
        now = dict(spark.table(f"{s}.dock_scans").select("shipment_id", "scan_id").collect())
        assert {k: now[k] for k in first} == first and sorted(now.values()) == [f"SCN-00{10000 + k}" for k in range(1, 6)]
        assert pointer(spark, "dock_scans", s).high_water == 10005


def test_a_refused_schema_falls_back_to_the_current_catalog(spark, monkeypatch):
    asked = []

    def refuse(session, schema, comment=None):
        asked.append(spark.catalog.currentCatalog())
        if len(asked) == 1:
            raise RuntimeError("[PERMISSION_DENIED] CREATE SCHEMA")

    monkeypatch.setattr(publishing, "ensure_schema", refuse)
    monkeypatch.setattr(type(spark.catalog), "setCurrentCatalog", lambda self, name: None)
    target = {"catalog": "elsewhere", "schema": "x", "fqn": "elsewhere.x", "catalog_fallback": False}
    got = publishing.open_target(spark, target, "spark_catalog")
    assert got == {"catalog": "spark_catalog", "schema": "x", "fqn": "spark_catalog.x", "catalog_fallback": True}
    asked.clear()
    with pytest.raises(RuntimeError):  # nowhere else to go
        publishing.open_target(spark, {**target, "catalog": "spark_catalog"}, "spark_catalog")

    def broken(session, schema, comment=None):
        raise RuntimeError("disk full")

    monkeypatch.setattr(publishing, "ensure_schema", broken)
    with pytest.raises(RuntimeError, match="disk full"):
        publishing.open_target(spark, target, "spark_catalog")


def test_partitioned_publish_writes_few_files(spark):
    with scratch_schema(spark, "qf_test") as s:
        df = spark.range(0, 4000, 1, 16).select("id", (F.col("id") % 4).alias("day"))
        commit_version(df, "t", s, partition_by=["day"])
        files = spark.table(f"{s}.t").inputFiles()
        assert len(files) == 4 and spark.table(f"{s}.t").count() == 4000
