import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from qualityframe.session import get_session  # noqa: E402

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", app_name="qualityframe-tests", shuffle_partitions=8)
    yield s


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


ITEM_SCHEMA = (
    "inspection_timestamp timestamp_ntz, facility_id string, dock_id string, shipment_id string, item_sku string, "
    "l_linenumber int, inspection_type string, result string, confidence_score double, defect_type string, "
    "severity string, processing_time_ms int"
)

# FIXTURES.md section 2A (linenumber added: position of the item in its shipment)
ITEM_ROWS = [
    (ts("2025-11-03 08:15:00"), "WH-A", "D1", "S1", "K1", 1, "label_scan", "fail", 0.40, "sku_mismatch", "critical", 100),
    (ts("2025-11-03 09:00:00"), "WH-A", "D1", "S1", "K2", 2, "damage_check", "pass", 0.95, None, None, 200),
    (ts("2025-11-04 10:30:00"), "WH-A", "D2", "S2", "K1", 1, "label_scan", "warning", 0.60, "torn_label", "minor", 120),
    (ts("2025-12-01 06:05:00"), "WH-B", "D1", "S3", "K2", 1, "damage_check", "fail", 0.35, "water_damage", "major", 250),
    (ts("2025-12-01 07:45:00"), "WH-B", "D1", "S3", "K3", 2, "item_count", "pass", 0.90, None, None, 60),
    (ts("2025-12-02 15:59:00"), "WH-B", "D1", "S3", "K2", 3, "damage_check", "fail", 0.50, "crushed_corner", "critical", 140),
]
PRODUCT_ROWS = [("K1", "Speaker", "Electronics"), ("K2", "Water", "Food"), ("K3", "Bulb", "Home")]


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame(ITEM_ROWS, ITEM_SCHEMA)


@pytest.fixture(scope="session")
def products(spark):
    return spark.createDataFrame(PRODUCT_ROWS, "p_partkey string, product_name string, product_category string")
