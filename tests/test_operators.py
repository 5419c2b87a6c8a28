"""Operators: spines, panels, validity, sampling, ids, rules, text, compare, edges."""

import datetime as dt

import pytest
from conftest import SF001, d
from pyspark.sql import Window
from pyspark.sql import functions as F

from qualityframe.functions import measures as M
from qualityframe.functions.hashing import hash_bucket, hash_fraction, hash_int
from qualityframe.functions.rules import classify, map_groups, version_key
from qualityframe.functions.text import assemble_timestamp, format_id, slugify
from qualityframe.operators.compare import check_answer, diff_multiset, diff_results, value_dictionary
from qualityframe.operators.ids import assign_by_index, sequence_id
from qualityframe.operators.ranking import latest_snapshot, ranked, top_k
from qualityframe.operators.sampling import hash_sample
from qualityframe.operators.spine import (
    date_spine,
    densify,
    effective_from,
    panel,
    spine_from_bounds,
    weekdays_only,
)
from qualityframe.plans import jobs
from qualityframe.plans.registry import DEFECT_GROUPS
from qualityframe.sources.tables import Tables, dimension

# ---------------------------------------------------------------- spines (FIXTURES 2D)


def test_day_spine_and_weekdays(spark):
    days = date_spine(spark, "2025-01-01", "2025-12-31", "day", "d")
    assert days.count() == 365
    assert weekdays_only(days, "d").count() == 261
    assert days.rdd.getNumPartitions() > 1  # built in parallel, not in one task


def test_month_spine(spark):
    months = date_spine(spark, "2025-01-15", "2025-12-03", "month", "m")
    got = [r.m for r in months.orderBy("m").collect()]
    assert len(got) == 12 and got[0] == d("2025-01-01") and got[-1] == d("2025-12-01")


def test_spine_from_bounds_matches_range_spine(spark):
    bounds = spark.createDataFrame([(dt.datetime(2024, 2, 27, 13), dt.datetime(2024, 3, 2, 1))], "lo timestamp_ntz, hi timestamp_ntz")
    a = sorted(r.d for r in spine_from_bounds(bounds, "lo", "hi", "day", "d").collect())
    b = sorted(r.d for r in date_spine(spark, "2024-02-27", "2024-03-02").collect())
    assert a == b and len(a) == 5  # leap day included


def test_version_eligibility_months(spark):
    grid = panel(spark.range(1), ("2025-01-01", "2025-12-01"), "month", "m",
                 values={"model_version": ["v1.0", "v1.1", "v1.2"]}).drop("id")
    schedule = spark.createDataFrame(
        [("v1.0", d("2025-01-01")), ("v1.1", d("2025-05-01")), ("v1.2", d("2025-09-01"))],
        "model_version string, valid_from date",
    )
    out = effective_from(grid, "model_version", "m", schedule)
    assert dict(out.groupBy("model_version").count().collect()) == {"v1.0": 12, "v1.1": 8, "v1.2": 4}


def test_panel_densify(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    skeleton = panel(keys, ("2025-01-01", "2025-01-02"))
    facts = spark.createDataFrame([(d("2025-01-02"), "b", 4)], "d date, k string, n long")
    out = densify(facts, skeleton, ["d", "k"], {"n": 0})
    vals = [r.n for r in out.collect()]
    assert len(vals) == 6 and vals.count(0) == 5 and 4 in vals


# ---------------------------------------------------------------- hashing and sampling


def test_md5_fraction_fixture(spark):
    df = spark.createDataFrame([(d("2025-01-02"),)], "day date")
    row = df.select(
        hash_int(7, "x", "day", modulo=10000, method="md5").alias("b"),
        hash_fraction(7, "x", "day", grid=10000, method="md5").alias("f"),
    ).first()
    assert (row.b, row.f) == (9269, 0.9269)


def test_hash_bucket_offset(spark):
    df = spark.range(2000)
    hours = df.select(hash_bucket(1, "hour", "id", modulo=10, offset=6).alias("h"))
    lo, hi = hours.agg(F.min("h"), F.max("h")).first()
    assert (lo, hi) == (6, 15)


@pytest.mark.parametrize("method", ["murmur3", "md5"])
def test_sampling_properties(spark, method):
    base = spark.range(0, 200000).withColumnRenamed("id", "k")
    s12 = hash_sample(base, 0.12, ["k"], method=method)
    n = s12.count()
    assert abs(n - 24000) < 4 * (200000 * 0.12 * 0.88) ** 0.5  # within 4 sigma
    # deterministic and independent of partitioning / order
    shuffled = base.repartition(13).orderBy(F.rand(3))
    assert hash_sample(shuffled, 0.12, ["k"], method=method).exceptAll(s12).count() == 0
    # nested: the 0.05 sample is inside the 0.12 sample
    assert hash_sample(base, 0.05, ["k"], method=method).exceptAll(s12).count() == 0
    assert hash_sample(base, 0.0, ["k"], method=method).count() == 0
    assert hash_sample(base, 1.0, ["k"], method=method).count() == 200000


def test_cluster_sampling_keeps_whole_groups(spark):
    df = spark.range(0, 5000).select((F.col("id") % 50).alias("g"), F.col("id"))
    s = hash_sample(df, 0.5, ["g"], salt="cluster", method="md5")
    sizes = s.groupBy("g").count().collect()
    assert all(r["count"] == 100 for r in sizes) and 0 < len(sizes) < 50


def test_stratified_rate_column(spark):
    df = spark.range(0, 100000).select(F.col("id"), (F.col("id") % 2).alias("stratum"))
    rate = classify([(F.col("stratum") == 0, 0.5)], 0.1)
    counts = dict(hash_sample(df, rate, ["id"], method="md5").groupBy("stratum").count().collect())
    assert abs(counts[0] - 25000) < 800 and abs(counts[1] - 5000) < 400


def test_sample_rejects_bad_rate(spark):
    with pytest.raises(ValueError):
        hash_sample(spark.range(3), 1.5, ["id"])


# ---------------------------------------------------------------- ids


def test_sequence_id_equals_row_number(spark):
    ev = Tables(spark, SF001).events.select("event_id", "ts", "user_id")
    ours = sequence_id(ev, ["ts", "event_id"], start=1, name="rn", num_partitions=7)
    ref = ev.withColumn("rn", F.row_number().over(Window.orderBy("ts", "event_id")).cast("long"))
    assert ours.exceptAll(ref).count() == 0 and ref.exceptAll(ours).count() == 0
    stats = ours.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn"), F.count("*")).first()
    assert tuple(stats) == (1, 10000, 10000, 10000)  # dense and gap-free


def test_sequence_id_hot_leading_key(spark):
    # one leading value holds most rows: the remaining sort column still spreads them
    df = spark.range(0, 30000).select(F.when(F.col("id") < 20000, F.lit(1)).otherwise(F.col("id")).alias("k"), "id")
    out = sequence_id(df, ["k", "id"], start=10001, name="sid", num_partitions=8)
    assert out.agg(F.min("sid"), F.max("sid"), F.countDistinct("sid")).first() == (10001, 40000, 30000)
    first = out.filter(F.col("sid") == 10001).first()
    assert (first.k, first.id) == (1, 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # fact rows come from the checkpointed range-partitioned copy; the only single-partition
    # exchange is the per-partition count table (one row per partition)
    assert "ExistingRDD" in plan and "row_number" not in plan.lower()
    assert plan.count("SinglePartition") <= 1


def test_sequence_id_spreads_a_hot_duplicated_key(spark):
    # 20,000 of 30,000 rows share the whole sort key: they must not all land in one task
    df = spark.range(0, 30000).select(F.when(F.col("id") < 20000, F.lit(1)).otherwise(F.col("id")).alias("k"))
    out = sequence_id(df, ["k"], start=1, name="sid", num_partitions=8)
    assert out.agg(F.min("sid"), F.max("sid"), F.countDistinct("sid")).first() == (1, 30000, 30000)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 10000
    # ids still follow the key order
    assert out.filter(F.col("k") == 1).agg(F.max("sid")).first()[0] == 20000


def test_format_id_never_truncates(spark):
    df = spark.createDataFrame([(10001,), (12345678,)], "n long")
    got = [r[0] for r in df.select(format_id("INS-", "n", 7)).collect()]
    assert got == ["INS-0010001", "INS-12345678"]


def test_sequence_ids_on_fixture_items(spark, items):
    order = [F.to_date("inspection_timestamp"), "facility_id", "dock_id", "item_sku", "inspection_type"]
    out = sequence_id(items, order, start=10001, name="n").select(format_id("INS-", "n").alias("id"), "inspection_timestamp")
    got = [r.id for r in out.orderBy("inspection_timestamp").collect()]
    assert got == [f"INS-00{10001 + i}" for i in range(6)]


def test_assign_by_index(spark):
    carriers = dimension(spark, [("Beta",), ("Alpha",), ("Gamma",)], "carrier_name string")
    facts = spark.createDataFrame([(1, 0), (2, 2), (3, 1)], "id int, idx int")
    out = assign_by_index(facts, "idx", carriers, ["carrier_name"])
    assert dict((r.id, r.carrier_name) for r in out.collect()) == {1: "Alpha", 2: "Gamma", 3: "Beta"}


# ---------------------------------------------------------------- rules


def test_classify_first_match_and_total(spark):
    df = spark.createDataFrame([(3, "a"), (12, "a"), (12, "b"), (None, "b")], "n int, k string")
    size = classify([((F.col("k") == "b") & (F.col("n") > 10), "big b"), (F.col("n") > 10, "big")], "rest")
    assert [r[0] for r in df.select(size).collect()] == ["rest", "big", "big b", "rest"]


def test_map_groups_null_is_none(spark):
    df = spark.createDataFrame([("torn_label",), (None,), ("count_discrepancy",), ("x",)], "t string")
    got = [r[0] for r in df.select(map_groups("t", DEFECT_GROUPS)).collect()]
    assert got == ["Label Issue", "None", "Count Error", "None"]


def test_clamp_and_harmonic_mean(spark):
    df = spark.createDataFrame([(120.0, 1.0), (None, 2.0), (-5.0, 0.0), (0.0, 0.0)], "a double, b double")
    out = df.select(M.clamp("a", 0.0, 100.0).alias("c"), M.harmonic_mean("a", "b").alias("h")).collect()
    assert [r.c for r in out] == [100.0, None, 0.0, 0.0]
    assert out[3].h is None and out[1].h is None


def test_round_half_up_decimal_reading(spark):
    df = spark.createDataFrame([(1.005,), (0.285,), (6.25,), (-0.0,)], "x double")
    got = [r[0] for r in df.select(M.round_half_up("x", 2).alias("r")).collect()]
    assert got[:2] == [1.01, 0.29]
    assert df.select(M.round_half_up("x", 1)).collect()[2][0] == 6.3


def test_rate_pct_zero_denominator(spark):
    df = spark.createDataFrame([(0, 0), (1, 3)], "n long, d long")
    assert [r[0] for r in df.select(M.rate_pct("n", "d")).collect()] == [None, 33.3]


def test_version_rank_numeric(spark):
    df = spark.createDataFrame([("v2.10",), ("v2.2",), ("v10.0",), ("v2.2",), ("v2.2.10",), ("v2.2.9",), (None,)], "v string")
    vals = df.select("v", version_key("v").alias("p"))
    for bounded in (False, True):
        out = ranked(vals.filter("p IS NOT NULL"), [F.asc("p")], keys=["p"], name="r", method="dense", bounded=bounded)
        assert dict((r.v, r.r) for r in out.collect()) == {"v2.2": 1, "v2.2.9": 2, "v2.2.10": 3, "v2.10": 4, "v10.0": 5}
    assert vals.filter("v IS NULL").first()["p"] is None


def test_sampling_rates_below_the_old_grid(spark):
    df = spark.range(2_000_000)
    for method in ("murmur3", "md5"):
        n = hash_sample(df, 0.00015, ["id"], method=method).count()
        assert 200 < n < 400
    with pytest.raises(ValueError):
        hash_sample(df, 0.00015, ["id"], grid=10_000)
    with pytest.raises(ValueError):
        hash_sample(df, 1e-12, ["id"])


def test_diff_with_null_keys_finds_nothing(spark):
    df = spark.createDataFrame([(None, 1), ("a", None), ("b", 2)], "k string, v int")
    assert diff_results(df, df, ["k"]).count() == 0
    assert check_answer(df, df, ["k"])["passed"] and check_answer(df, df)["passed"]
    other = spark.createDataFrame([(None, 5), ("a", None), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in diff_results(df, other, ["k"]).collect()] == [(None, "changed", "v")]


def test_missing_dimension_rows_keep_the_facts(spark, items, products):
    got = jobs.with_product(items.withColumn("item_sku", F.col("item_sku")), products.limit(1).withColumnsRenamed(
        {"product_name": "p_name", "product_category": "p_type"}))
    assert got.count() == items.count()


def test_tables_see_appended_files(spark, tmp_path):
    path = str(tmp_path / "orders.parquet")
    spark.range(3).withColumnRenamed("id", "o_orderkey").write.parquet(path)
    assert Tables(spark, str(tmp_path)).orders.count() == 3
    spark.range(2).withColumnRenamed("id", "o_orderkey").write.mode("append").parquet(path)
    assert Tables(spark, str(tmp_path)).orders.count() == 5


def test_rank_with_ties_parallel_and_bounded(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 7.0), ("c", 5.0), ("d", 1.0)], "k string, m double")
    for bounded in (False, True):
        out = ranked(df, [F.desc("m")], keys=["m"], name="r", method="rank", tie_break=[F.asc("k")], bounded=bounded)
        assert dict((r.k, r.r) for r in out.collect()) == {"b": 1, "a": 2, "c": 2, "d": 4}


def test_rank_keeps_null_measures(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None), ("c", 7.0)], "k string, m double")
    for method in ("rank", "dense"):
        for bounded in (False, True):
            out = ranked(df, [F.desc_nulls_last("m")], keys=["m"], name="r", method=method,
                         tie_break=[F.asc("k")], bounded=bounded)
            assert dict((r.k, r.r) for r in out.collect()) == {"c": 1, "a": 2, "b": 3}


def test_top_k_tie_break(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "k string, n int")
    assert [r.k for r in top_k(df, [F.desc("n"), F.asc("k")], 2).collect()] == ["a", "b"]


def test_latest_snapshot_ties_and_empty(spark):
    df = spark.createDataFrame([(d("2025-01-31"), 1), (d("2025-02-03"), 2), (d("2025-02-20"), 3), (None, 4)],
                               "day date, v int")
    assert sorted(r.v for r in latest_snapshot(df, "day", "month").collect()) == [2, 3]
    assert [r.v for r in latest_snapshot(df, "day").collect()] == [3]
    assert [r.v for r in latest_snapshot(df, "day", subquery=True).collect()] == [3]
    assert latest_snapshot(df.limit(0), "day", "month").count() == 0


# ---------------------------------------------------------------- text and timestamps


def test_slugify(spark):
    df = spark.createDataFrame([("Jane.Doe@example.com",), ("__A  b--C__",), ("@@",), ("Supplier#000000001",)], "u string")
    assert [r[0] for r in df.select(slugify("u")).collect()] == ["jane_doe", "a_b_c", None, "supplier_000000001"]


def test_assemble_timestamp_is_zone_independent(spark):
    df = spark.createDataFrame([(d("2025-03-09"), 23, 59)], "day date, h int, m int")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        values = []
        for zone in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            values.append(df.select(assemble_timestamp("day", F.col("h"), F.col("m"))).first()[0])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert values[0] == values[1] == dt.datetime(2025, 3, 9, 23, 59)


def test_bucket_near_midnight_any_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 31, 23, 30),)], "t timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert df.select(M.bucket("t", "month")).first()[0] == d("2025-01-01")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


# ---------------------------------------------------------------- compare


def test_diff_results(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, None, 3.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.5), (3, None, 3.0), (4, "z", 4.0)], "k int, s string, v double")
    out = {r.k: (r.diff, r.changed_columns) for r in diff_results(a, b, ["k"]).collect()}
    assert out == {2: ("changed", "v"), 4: ("only_right", "")}
    assert diff_results(a, a, ["k"]).count() == 0


def test_diff_results_duplicate_keys_are_reported_not_paired(spark):
    a = spark.createDataFrame([(1, 1.0)] * 500 + [(2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0)] * 400 + [(2, 2.0)], "k int, v double")
    out = {r.k: r.diff for r in diff_results(a, b, ["k"]).collect()}
    assert out == {1: "duplicate_key"}


def test_diff_multiset(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    got = sorted(tuple(r) for r in diff_multiset(a, b).collect())
    assert got == [(1, 2, 1), (2, 1, 0), (3, 0, 1)]


def test_value_dictionary(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x")], "c1 string, c2 string")
    got = sorted(((r.column_name, r.value or "", r.rows) for r in value_dictionary(df, ["c1", "c2"], "t").collect()))
    assert got == [("c1", "a", 2), ("c1", "b", 1), ("c2", "", 1), ("c2", "x", 2)]


# ---------------------------------------------------------------- edges


def test_empty_inputs(spark, items, products):
    from qualityframe.plans import jobs, questions

    empty = items.limit(0)
    assert questions.defect_rate_by_category(empty, products).count() == 0
    assert jobs.shipment_rollup(empty).count() == 0
    assert sequence_id(empty, ["inspection_timestamp"]).count() == 0
    assert hash_sample(empty, 0.5, ["item_sku"]).count() == 0


def test_null_group_key(spark):
    from qualityframe.plans.registry import REGISTRY, evaluate

    df = spark.createDataFrame([(None, "fail"), (None, "pass")], "g string, result string")
    out = evaluate(df, [REGISTRY.measures["defect_rate_pct"]], by=["g"]).first()
    assert (out.g, out.defect_rate_pct) == (None, 50.0)


def test_single_date_table(spark):
    import datetime as _dt

    from qualityframe.plans import jobs

    day = _dt.datetime(2025, 6, 2, 0, 0)
    rows = [(day, "WH-A", "D1", f"S{i % 3}", f"K{i}", i % 4 + 1, "label_scan", ["pass", "fail"][i % 2], 0.9,
             None if i % 2 == 0 else "torn_label", None if i % 2 == 0 else "minor", 10) for i in range(40)]
    from conftest import ITEM_SCHEMA

    items = spark.createDataFrame(rows, ITEM_SCHEMA)
    assert latest_snapshot(items, "inspection_timestamp", "month").count() == 40
    ids = sequence_id(items, ["inspection_timestamp", "item_sku"], start=1, name="n", num_partitions=4)
    assert ids.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first() == (1, 40, 40)
    assert spine_from_bounds(items.agg(F.min("inspection_timestamp").alias("a"), F.max("inspection_timestamp").alias("b")),
                             "a", "b").count() == 1
    r = jobs.shipment_rollup(items)
    assert r.agg(F.sum("verified_item_count"), F.max("total_scan_duration_seconds")).first() == (40, 0)


def test_round_half_up_matches_decimal_reading(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rnd = random.Random(7)
    values = [rnd.uniform(0, 1000) for _ in range(500)] + [round(rnd.uniform(0, 100), 3) for _ in range(500)]
    values += [0.05, 0.15, 0.25, 1.005, 2.675, 0.285, 66.65, 99.95, 6.25, 33.35]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [(r.x, r.r1, r.r3) for r in df.select("x", M.round_half_up("x", 1).alias("r1"),
                                                M.round_half_up("x", 3).alias("r3")).collect()]

    def expect(x, digits):
        d = Decimal(repr(x)).quantize(Decimal("1e-8"), ROUND_HALF_UP)
        return float(d.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))

    bad = [(x, r1, r3) for x, r1, r3 in got if r1 != expect(x, 1) or r3 != expect(x, 3)]
    assert not bad, bad[:5]


def test_classify_is_equals_classify_filter(spark):
    from qualityframe.functions.rules import classify_is

    rows = [(f, q) for f in ("R", "A", "N", None) for q in (1.0, 7.9, 8.0, 25.9, 26.0, 40.0, None)]
    df = spark.createDataFrame(rows, "flag string, q double")
    result = classify([(F.col("flag") == "R", "fail"), (F.col("flag") == "N", "pass")], "warning")
    rules = [(result == "pass", None), (F.col("q") < 8.0, "critical"), (F.col("q") < 26.0, "major")]
    sev = classify([(c, F.lit(None).cast("string") if v is None else v) for c, v in rules], "minor")
    for value in ("critical", "major", "minor", "absent"):
        a = sorted(map(tuple, df.filter(sev == value).collect()), key=str)
        b = sorted(map(tuple, df.filter(classify_is(rules, "minor", value)).collect()), key=str)
        assert a == b, value
