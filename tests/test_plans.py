"""Plan shapes that matter at scale: pushdown, pruning, broadcast of bounded sides,
pre-aggregation before joins, no single-partition sort of fact rows."""

from conftest import SF001

from qualityframe.plans.catalog import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_preaggregates_before_part_join(spark):
    p = plan(QUERIES["q_defect_rate_by_category"](spark, SF001))
    # lineitem is read with only the two needed columns
    assert "ReadSchema: struct<l_partkey:bigint,l_returnflag:string>" in p or (
        "l_partkey" in p and "l_extendedprice" not in p
    )
    # an aggregate keyed by the part key sits below the join to part
    join_at = p.find("Join")
    agg_by_sku = p.find("HashAggregate(keys=[item_sku")
    assert agg_by_sku > join_at > 0


def test_nation_is_broadcast(spark):
    p = plan(QUERIES["q_mean_duration_by_facility"](spark, SF001))
    assert "BroadcastExchange" in p and "nation.parquet" in p


def test_sampling_is_a_scan_side_filter(spark):
    df = QUERIES["q_sample_constant"](spark, SF001)
    p = plan(df)
    assert "Exchange" not in p  # no shuffle at all
    assert "md5" in p


def test_inbound_filter_is_pushed_with_pruned_columns(spark):
    p = plan(QUERIES["q_inbound_rejected_rate"](spark, SF001))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in p
    assert "PushedFilters: [In(o_orderpriority, [1-URGENT,2-HIGH]), IsNotNull(o_orderkey)]" in p
    # and the predicate is applied below the first exchange (before any shuffle)
    assert p.find("Filter") > p.find("Exchange") > 0


def test_raw_predicate_is_pushed_to_parquet(spark):
    from qualityframe.operators.sampling import hash_sample
    from qualityframe.sources.tables import Tables

    orders = Tables(spark, SF001).orders
    df = hash_sample(orders.filter(orders.o_orderstatus == "P"), 0.5, ["o_orderkey"]).select("o_orderkey")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,P)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in p


def test_item_ids_do_not_sort_in_one_partition(spark):
    p = plan(QUERIES["q_item_outcomes"](spark, SF001))
    assert "row_number" not in p.lower()


def test_panel_is_generated_not_joined(spark):
    p = plan(QUERIES["q_panel_skeleton"](spark, SF001))
    assert "Generate explode" in p
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_sampled_panel_filters_in_the_generating_stage(spark):
    from qualityframe.operators.sampling import hash_sample
    from qualityframe.operators.spine import panel

    keys = spark.range(0, 1000).withColumnRenamed("id", "k")
    df = hash_sample(panel(keys, ("2025-01-01", "2025-12-31")), 0.1, ["k", "d"], method="md5")
    p = plan(df)
    assert "Exchange" not in p and "Join" not in p  # generate + filter, in one stage
    assert abs(df.count() - 36500) < 1500


def test_carrier_join_reuses_rollup_partitioning(spark):
    # the rollup is hash-partitioned by shipment; joining orders on the same key must not
    # shuffle the rollup again (only orders is exchanged for that join)
    df = QUERIES["q_inbound_scan_time"](spark, SF001)
    p = plan(df)
    assert p.count("hashpartitioning(shipment_id") == 1


def test_critical_filter_reaches_parquet(spark):
    p = plan(QUERIES["q_critical_trend"](spark, SF001))
    assert "LessThan(l_quantity,10.0)" in p
