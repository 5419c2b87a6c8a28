"""The batch rule operators and the daily trend run unchanged on a stream."""

import tempfile

from conftest import SF0001

from qualityframe.plans import jobs, questions
from qualityframe.sources.tables import Tables
from qualityframe.streaming import daily_trend_stream, read_table_stream


import pytest


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_stream_daily_trend_matches_batch(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        _check_stream_matches_batch(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def _check_stream_matches_batch(spark):
    stream_items = jobs.item_facts(read_table_stream(spark, SF0001, "lineitem"))
    agg = daily_trend_stream(stream_items)
    ckpt = tempfile.mkdtemp(prefix="qf-stream-")
    q = (
        agg.writeStream.outputMode("complete").format("memory").queryName("qf_daily_trend")
        .option("checkpointLocation", ckpt).start()
    )
    try:
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("SELECT * FROM qf_daily_trend").collect())
    finally:
        q.stop()
    batch = questions.daily_trend(jobs.item_facts(Tables(spark, SF0001).lineitem))
    assert got == sorted(tuple(r) for r in batch.collect())
