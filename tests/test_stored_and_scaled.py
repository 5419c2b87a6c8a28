"""Stored parts, digest differences, bucketed joins, footers, spells, thresholds, exact samples, frequent values."""

import datetime as dt
import random

import pytest
from conftest import SF0001, SF001
from pyspark.sql import functions as F

from qualityframe.functions.measures import round_half_up
from qualityframe.operators import digests
from qualityframe.operators.compare import diff_results, frequent_values
from qualityframe.operators.digests import diff_by_digest, key_digests
from qualityframe.operators.intervals import in_force, segments
from qualityframe.operators.sampling import sample_exact
from qualityframe.operators.thresholds import confusion_by_threshold, interval_of
from qualityframe.plans import jobs, published, questions
from qualityframe.plans.catalog import QUERIES, _facilities, _items, _scans, _t
from qualityframe.plans.partials import DAY, MONTH, answer_from_partials, append_partials, publish_partials
from qualityframe.plans.registry import REGISTRY, Filter, Via
from qualityframe.sources.footers import footer_bounds, footer_session
from qualityframe.sources.publish import publish
from qualityframe.sources.versions import scratch_schema


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- stored parts ------------------------------------------------------------------


def test_stored_parts_answer_without_the_facts(spark):
    t = _t(spark, SF0001)
    measures = [REGISTRY.measures[n] for n in ("total_inspections", "avg_confidence", "pass_rate")]
    keys = [DAY, "item_sku", "inspection_type"]
    items = _items(t)
    with scratch_schema(spark, "qf_test") as s:
        publish_partials(items.filter("shipment_id % 2 = 0"), measures, keys, "parts", s)
        append_partials(items.filter("shipment_id % 2 = 1"), measures, keys, "parts", s)  # the same days again: parts merge
        got = answer_from_partials(spark, "parts", s, measures, by=[MONTH])
        assert "lineitem" not in plan(got)
        want = questions.evaluate(items, measures, by=[REGISTRY.dimensions["inspection_month"]])
        assert tuples(got) == tuples(want)
        some = Filter("labels", lambda: F.col("inspection_type") == "label_scan")
        via = Via(["item_sku"], jobs.product_dim(t.part), ["p_partkey"])
        got = answer_from_partials(spark, "parts", s, measures, by=["product_category"], where=[some], via=via)
        assert tuples(got) == tuples(questions.evaluate(items, measures, by=["product_category"], where=[some], via=via))
        with pytest.raises(ValueError, match="parts"):
            answer_from_partials(spark, "parts", s, [REGISTRY.measures["failures"]], by=[MONTH])


# --- difference by digests -----------------------------------------------------------


def test_digest_difference_equals_the_keyed_one(spark):
    rng = random.Random(4)
    left = [(k, rng.choice("ab"), rng.choice([None, 1.5])) for k in range(-300, 3000)] + [(None, "n", 1.0), (7, "twice", None)]
    right = [(k, "c" if k in (5, 999) else a, v) for k, a, v in left if k not in (100, 2500)] + [(5000, "new", None)]
    schema = "k long, a string, v double"
    lf, rf = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    want = tuples(diff_results(lf, rf, ["k"]))
    assert len(want) == 6  # two changed, two gone, one new, one key that is repeated
    for width in (1, 16, 100000):
        got = tuples(diff_by_digest(lf, rf, ["k"], width=width))
        # a repeated key whose rows are equal on both sides is in no differing range, unless others are
        assert [r for r in got if r[1] != "duplicate_key"] == [r for r in want if r[1] != "duplicate_key"]
    assert tuples(diff_by_digest(lf, lf, ["k"], width=16)) == []
    two = [lf.withColumn("s", F.col("k").cast("string")), rf.withColumn("s", F.col("k").cast("string"))]
    got = [r for r in tuples(diff_by_digest(*two, ["s", "k"], ["a", "v"])) if r[2] != "duplicate_key"]
    assert {(r[1], r[2]) for r in got} == {(r[0], r[1]) for r in want if r[1] != "duplicate_key"}


def test_rows_of_equal_ranges_are_filtered_before_the_shuffle(spark):
    left = spark.range(0, 100000).select("id", (F.col("id") % 7).alias("v"))
    right = left.withColumn("v", F.when(F.col("id") == 4242, 0).otherwise(F.col("v")))
    stored = key_digests(left, ["id"], ["v"], 256).checkpoint()
    got = diff_by_digest(left, right, ["id"], width=256, left_digests=stored)
    p = plan(got)
    assert "BroadcastHashJoin" in p and "LeftSemi" in p
    assert got.count() == 0  # it was 0 before
    right = left.withColumn("v", F.when(F.col("id") == 4242, 99).otherwise(F.col("v")))
    got = diff_by_digest(left, right, ["id"], width=256, left_digests=stored)
    assert [tuple(r) for r in got.collect()] == [(4242, "changed", "v")]
    leaves = digests.differing_leaves(stored, key_digests(right, ["id"], ["v"], 256))
    assert [r["leaf"] for r in leaves.collect()] == [4242 // 256]


# --- layout and footers --------------------------------------------------------------


def test_items_meet_their_shipments_without_an_exchange(spark):
    t = _t(spark, SF0001)
    with scratch_schema(spark, "qf_test") as s:
        publish(_items(t), "inspection_events", s, bucket_by=(8, ["shipment_id"]))
        publish(_scans(t), "dock_scans", s, bucket_by=(8, ["shipment_id"]))
        got = published.items_of_shipments(spark.table(f"{s}.inspection_events"), spark.table(f"{s}.dock_scans"))
        p = plan(got)
        assert "Exchange" not in p and "SortMergeJoin" in p
        assert tuples(got) == tuples(published.items_of_shipments(_items(t), _scans(t)))


def test_counts_and_extremes_come_from_footers(spark, tmp_path):
    bounds = footer_bounds(spark, f"{SF0001}/orders.parquet", ["o_orderkey"])
    p = plan(bounds)
    assert "PushedAggregation: [COUNT(*), MIN(o_orderkey), MAX(o_orderkey)]" in p
    orders = _t(spark, SF0001).orders
    assert tuple(bounds.first()) == tuple(orders.agg(F.count("*"), F.min("o_orderkey"), F.max("o_orderkey")).first())
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    assert footer_session(spark).sparkContext is spark.sparkContext
    assert plan(QUERIES["q_row_counts"](spark, SF0001)).count("PushedAggregation: [COUNT(*)]") == 14


def test_latest_month_is_a_range_on_the_raw_timestamp(spark):
    for name in ("q_this_period_rate", "q_latest_snapshot_avg"):
        p = plan(QUERIES[name](spark, SF001))
        assert "GreaterThanOrEqual(l_shipdate,ScalarSubquery" in p  # pushed into the scan, below any aggregate


# --- spells ----------------------------------------------------------------------------


SPELLS = [
    ("a", "open", None, None), ("a", "mid", dt.date(2025, 2, 10), dt.date(2025, 4, 1)), ("a", "inner", dt.date(2025, 3, 1), dt.date(2025, 3, 5)),
    ("b", "first", dt.date(2025, 1, 1), dt.date(2025, 1, 10)), ("b", "late", dt.date(2025, 5, 1), None), ("b", "empty", dt.date(2025, 2, 2), dt.date(2025, 2, 2)),
    ("c", "short", dt.date(2025, 1, 1), dt.date(2025, 2, 1)), ("c", "long", dt.date(2025, 1, 1), dt.date(2025, 3, 1)), (None, "nobody", None, None),
]


def plain_spell(key, day):
    low, high = dt.date.min, dt.date.max
    held = [((s or low), (e or high), name) for k, name, s, e in SPELLS if k == key and key is not None and (s or low) <= day < (e or high)]
    return max(held)[2] if held else None


@pytest.mark.parametrize("grain", ["week", "month", "year"])
def test_spell_in_force(spark, grain):
    spells = spark.createDataFrame(SPELLS, "key string, spell string, s date, e date")
    days = [dt.date(2025, 1, 1) + dt.timedelta(days=k) for k in range(0, 200)]
    facts = [(k, d, n) for k in ("a", "b", "c", "d", None) for d in days for n in range(2)] + [("a", None, 0)]
    df = spark.createDataFrame(facts, "key string, day date, n int")
    got = in_force(df, "key", "day", spells, "s", "e", ["spell"], grain=grain, salts=3)
    want = [(k, d, n, plain_spell(k, d)) for k, d, n in facts if d and plain_spell(k, d)]
    assert tuples(got) == sorted(want, key=str)
    assert in_force(df.limit(0), "key", "day", spells, "s", "e", ["spell"]).count() == 0
    p = plan(got)
    assert "NestedLoop" not in p and "Cartesian" not in p
    with pytest.raises(ValueError):
        in_force(df.withColumn("spell", F.lit(1)), "key", "day", spells, "s", "e", ["spell"])


def test_segments_do_not_overlap(spark):
    spells = spark.createDataFrame(SPELLS, "key string, spell string, s date, e date")
    got = tuples(segments(spells, "key", "s", "e", ["spell"]).filter("key = 'a'"))
    assert [r[3] for r in sorted(got, key=lambda r: r[1])] == ["open", "mid", "inner", "mid", "open"]


# --- thresholds, samples, frequent values, rounding -------------------------------------


@pytest.mark.parametrize("n", [1, 8, 9, 100])
def test_interval_of_a_score(spark, n):
    cuts = [k / 10 for k in range(n)]
    scores = [None, -1.0, 0.0, 0.05, 0.1, 0.85, 3.3, 1e9]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = {r[0]: r[1] for r in df.select("s", interval_of(F.col("s"), cuts)).collect()}
    assert got == {s: None if s is None else sum(s > c for c in cuts) for s in scores}


def test_confusion_of_unordered_and_equal_thresholds(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), rng.choice([None, 0.1, 0.2, 0.3, 0.4]), rng.choice([True, False, None])) for _ in range(300)] + [("z", None, None)]
    versions = [("hi", 0.3), ("lo", 0.1), ("same", 0.3), ("none", 9.0)]
    df = spark.createDataFrame(rows, "g string, s double, y boolean")
    got = confusion_by_threshold(df, ["g"], F.col("s"), F.col("y"), versions, {"n": F.count(F.lit(1))})
    want = []
    for g in "xyz":
        for v, t in versions:
            held = [(s > t, y) for k, s, y in rows if k == g and s is not None and y is not None]
            want.append((g, v, *(held.count(c) for c in ((True, True), (True, False), (False, True), (False, False))), sum(k == g for k, _, _ in rows)))
    assert tuples(got) == sorted(want, key=str)


def test_three_versions_equal_the_long_form(spark):
    t = _t(spark, SF0001)
    items = _items(t).join(t.supplier.select(F.col("s_suppkey").alias("dock_id")), "dock_id")
    wide = jobs.model_metrics_monthly(items, _facilities(t))
    preds = _facilities(t)(jobs.predictions(items)).withColumn("evaluation_date", F.trunc(F.to_date("ts"), "month"))
    long = jobs.model_metrics(preds, ["evaluation_date", "model_name", "model_version", "inspection_type", "facility_id"])
    assert tuples(wide) == tuples(long.select(*wide.columns))


def test_exact_sample_of_a_hot_stratum(spark):
    rows = [("hot", k) for k in range(5000)] + [("small", k) for k in range(3)] + [(None, k) for k in range(20)] + [("twice", 1)] * 9
    df = spark.createDataFrame(rows, "g string, k int")
    got = sample_exact(df, 7, ["g"], ["g", "k"], slices=5)
    counts = {r["g"]: r["count"] for r in got.groupBy("g").count().collect()}
    assert counts == {"hot": 7, "small": 3, None: 7, "twice": 7}
    assert tuples(got) == tuples(sample_exact(df.repartition(13), 7, ["g"], ["g", "k"], slices=2))
    p = plan(got)
    assert p.count("WindowGroupLimit") >= 2 and p.find("Partial") > 0
    assert sample_exact(df.limit(0), 7, ["g"], ["g", "k"]).count() == 0


def test_frequent_values_are_exact(spark):
    rng = random.Random(9)
    values = [str(int(rng.paretovariate(0.9))) for _ in range(20000)] + [None] * 500
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    for share in (0.5, 0.02, 0.001):
        want = sorted((v, values.count(v)) for v in set(values) - {None} if values.count(v) >= share * 20000)
        assert sorted((r["value"], r["rows"]) for r in frequent_values(df, "v", share).collect()) == want
    assert frequent_values(df.limit(0), "v", 0.1).count() == 0
    with pytest.raises(ValueError):
        frequent_values(df, "v", 0)


def test_rounding_happens_once(spark):
    values = {0.285: 0.29, 0.284999999999: 0.28, 0.2849999999999999: 0.28, -0.285: -0.29, 1e15 + 0.125: 1e15 + 0.13, 2.5: 2.5}
    df = spark.createDataFrame([(k,) for k in values], "x double")
    assert {r[0]: r[1] for r in df.select("x", round_half_up("x", 2)).collect()} == values
