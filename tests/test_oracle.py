"""Every registered query against its DuckDB oracle at sf0.01: rows, columns and exact
values (order-insensitive), the same gate the driver applies."""

import os
import sys

import duckdb
import pytest
from conftest import SF001

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import canon  # noqa: E402
from qualityframe.sources.tables import TABLE_NAMES  # noqa: E402

# the queries of the reference's own operators; the others have their tests beside them
ORACLE = {name: sql for name, sql in E.oracle_sql().items() if name.startswith("q_")}
ROWS_ONLY = sorted(name for name in E.queries() if name.startswith("q_") and name not in ORACLE)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_oracle():
    assert ROWS_ONLY == []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    ocols = [c[0] for c in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert canon(df.columns, srows) == canon(ocols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["product_category", "total_inspections", "failures", "defect_rate_pct"]


def test_rows_only_queries_run(spark):
    s = E.queries()["q_sample_murmur3"](spark, SF001)
    n = s.count()
    assert 0.10 * 15000 < n < 0.14 * 15000


def test_publish_summary_counts(spark):
    out = {r.table_name: r.rows for r in E.queries()["q_publish_summary"](spark, SF001).collect()}
    assert out == {"inspection_events": 60000, "dock_scans": 14743, "model_performance": 18360}
