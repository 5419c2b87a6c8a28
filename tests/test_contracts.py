"""Driver-facing contracts: bench.py output shape, catalog-backed sources."""

import json
import os
import subprocess
import sys

from conftest import ROOT, SF0001

from qualityframe.sources.publish import drop_dataset, publish
from qualityframe.sources.tables import Tables


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF0001, BENCH_CPUS="2", BENCH_REPEAT="1",
               BENCH_QUERIES="q_slugify,q_defect_rate_by_category", BENCH_DRIVER_MEMORY="2g")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], capture_output=True, text=True,
                         env=env, cwd=ROOT, timeout=600)
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1, out.stdout + out.stderr[-2000:]
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["failed"] == {}
    assert set(d["queries"]) == {"q_slugify", "q_defect_rate_by_category"}
    assert abs(d["value"] - sum(d["queries"].values())) < 1e-2


def test_catalog_source(spark):
    schema = "qf_test_catalog_src"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    publish(Tables(spark, SF0001).supplier, "supplier", schema)
    t = Tables(spark, f"catalog:{schema}")
    assert t.supplier.count() == Tables(spark, SF0001).supplier.count()
    drop_dataset(spark, schema)
