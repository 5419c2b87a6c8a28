"""Registered queries: ``name -> fn(spark, source) -> DataFrame`` over the input tables.

Each query reads whole tables (or data Spark derives from them); none collects rows to
the driver. The matching DuckDB SQL lives in ``plans/oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityframe.functions import measures as M
from qualityframe.functions.hashing import hash_fraction, hash_int
from qualityframe.functions.rules import (
    classify,
    version_key,
)
from qualityframe.functions.text import assemble_timestamp, format_id, slugify
from qualityframe.operators.compare import diff_multiset, diff_results, frequent_values, value_dictionary, value_dictionary_via
from qualityframe.operators.digests import diff_by_digest
from qualityframe.operators.ids import assign_by_index, sequence_id
from qualityframe.operators.intervals import in_force
from qualityframe.operators.ranking import ranked
from qualityframe.operators.sampling import hash_sample, sample_exact
from qualityframe.operators.spine import densify, effective_from, panel, spine_from_bounds, weekdays_only
from qualityframe.operators.thresholds import confusion_by_threshold
from qualityframe.plans import jobs, questions
from qualityframe.plans.registry import REGISTRY, Filter, Via, count_measure, evaluate
from qualityframe.sources.tables import Tables, dimension

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}

SEED = 42

#: The five market segments of the customer table, as the inline dimension of the indexed lookup.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

#: Share of the items from which an item key counts as frequent.
FREQUENT_SHARE = 0.0007

#: Schedule of the effective-dating query: a version starts every other year of the data (months from its first one).
VERSION_START_OFFSETS = (("v1.0", 0), ("v1.1", 24), ("v1.2", 48))


def query(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__] = fn
    return fn


def _t(spark: SparkSession, source: str) -> Tables:
    """Tables for one query: files are listed anew, so appended files are seen."""
    return Tables(spark, source)


# Derived inputs that a query uses more than once are built once, as lazy views.


def _items(t: Tables) -> DataFrame:
    return t.view("items", lambda: jobs.item_facts(t.lineitem))


def _products(t: Tables) -> DataFrame:
    return t.view("products", lambda: jobs.product_dim(t.part))


def _facilities(t: Tables):
    return jobs.facility_attach(t.supplier, t.nation)


def _metrics(t: Tables) -> DataFrame:
    return t.view("metrics", lambda: jobs.model_metrics_monthly(_items(t), _facilities(t)))


def _scans(t: Tables) -> DataFrame:
    """T2 without its ids."""
    return t.view("scans", lambda: jobs.shipment_scans(jobs.shipment_rollup(_items(t)), t.orders, t.customer, _facilities(t)))


def _events_as_items(t: Tables) -> DataFrame:
    """events as inspections: purchase = pass, error = fail, other types neither."""
    result = classify([(F.col("event_type") == "purchase", "pass"), (F.col("event_type") == "error", "fail")], "other")
    return t.events.select(F.col("ts").alias("inspection_timestamp"), result.alias("result"), "event_type", "value")


# ---------------------------------------------------------------------------
# Questions
# ---------------------------------------------------------------------------


@query
def q_defect_rate_by_category(spark: SparkSession, source: str) -> DataFrame:
    t = _t(spark, source)
    return questions.defect_rate_by_category(_items(t), _products(t))


@query
def q_this_period_rate(spark: SparkSession, source: str) -> DataFrame:
    t = _t(spark, source)
    return questions.this_period_rate(_items(t), _products(t))


@query
def q_latest_snapshot_avg(spark: SparkSession, source: str) -> DataFrame:
    t = _t(spark, source)
    return questions.latest_fp_rate_of_items(_items(t), _facilities(t))


@query
def q_carrier_ranking(spark: SparkSession, source: str) -> DataFrame:
    # the carriers are the market segments, a fixed list
    return questions.carrier_ranking(_scans(_t(spark, source)), bounded=True)


@query
def q_flagged_carriers(spark: SparkSession, source: str) -> DataFrame:
    return questions.flagged_carriers(_scans(_t(spark, source)))


@query
def q_daily_trend(spark: SparkSession, source: str) -> DataFrame:
    return questions.daily_trend(_events_as_items(_t(spark, source)))


@query
def q_version_comparison(spark: SparkSession, source: str) -> DataFrame:
    return questions.version_comparison(_metrics(_t(spark, source)))


@query
def q_best_version(spark: SparkSession, source: str) -> DataFrame:
    return questions.best_version(_metrics(_t(spark, source)))


@query
def q_accuracy_by_facility(spark: SparkSession, source: str) -> DataFrame:
    return questions.accuracy_by_facility(_metrics(_t(spark, source)))


@query
def q_mean_duration_by_facility(spark: SparkSession, source: str) -> DataFrame:
    t = _t(spark, source)
    return questions.mean_duration_by_facility(jobs.shipment_rollup(_items(t)), _facilities(t))


@query
def q_mean_duration_by_dock(spark: SparkSession, source: str) -> DataFrame:
    t = _t(spark, source)
    return questions.mean_duration_by_dock(jobs.shipment_rollup(_items(t)), _facilities(t))


@query
def q_top_critical_items(spark: SparkSession, source: str) -> DataFrame:
    t = _t(spark, source)
    return questions.top_critical_items(_items(t), _products(t), critical=_CRITICAL_RAW)


@query
def q_top_k_items(spark: SparkSession, source: str) -> DataFrame:
    """The ten items with the most critical defects (k is the feature)."""
    t = _t(spark, source)
    return questions.top_critical_items(_items(t), _products(t), k=10, critical=_CRITICAL_RAW)


# "critical defects" over lineitem-bound items, in a form whose quantity cut is pushable
_CRITICAL_RAW = Filter("critical defects", lambda: jobs.severity_is("critical"))


# "inbound shipments" as a predicate on the order priority (pushed into the orders scan)
_INBOUND_RAW = Filter("inbound shipments", lambda: jobs.direction_is("inbound"))


@query
def q_inbound_rejected_rate(spark: SparkSession, source: str) -> DataFrame:
    t = _t(spark, source)
    return questions.inbound_rejected_rate(jobs.with_direction(jobs.shipment_rollup(_items(t)), t.orders), inbound=_INBOUND_RAW)


@query
def q_critical_trend(spark: SparkSession, source: str) -> DataFrame:
    return questions.critical_trend(_items(_t(spark, source)), critical=_CRITICAL_RAW)


@query
def q_mismatch_items(spark: SparkSession, source: str) -> DataFrame:
    t = _t(spark, source)
    return questions.mismatch_items(
        _items(t), _products(t), Filter("label mismatches", lambda: jobs.defect_type_is("sku_mismatch"))
    )


@query
def q_mean_score_by_type(spark: SparkSession, source: str) -> DataFrame:
    return questions.mean_score_by_type(_items(_t(spark, source)), "inspection_type", "confidence_score")


@query
def q_metric_by_month(spark: SparkSession, source: str) -> DataFrame:
    return questions.metric_summary(_items(_t(spark, source)), by=[REGISTRY.dimensions["inspection_month"]])


@query
def q_metric_by_category(spark: SparkSession, source: str) -> DataFrame:
    t = _t(spark, source)
    return questions.metric_summary(_items(t), by=["product_category"], via=Via(["item_sku"], _products(t), ["p_partkey"]))


@query
def q_inbound_scan_time(spark: SparkSession, source: str) -> DataFrame:
    """Registry scan measures: mean scan time of inbound shipments per carrier."""
    t = _t(spark, source)
    return evaluate(
        _scans(t),
        [REGISTRY.measures["avg_scan_time"], count_measure("total_scans")],
        by=["carrier_name"],
        where=[_INBOUND_RAW],
    )


@query
def q_defect_category(spark: SparkSession, source: str) -> DataFrame:
    return questions.defect_categories(_items(_t(spark, source)))


# ---------------------------------------------------------------------------
# Rules, bands and scores
# ---------------------------------------------------------------------------


#: Handling classes of an inspected item, first match wins.
URGENT_QUANTITY, RECHECK_DISCOUNT = 40.0, 0.08


def _handling(result, quantity, discount):
    return classify(
        [
            ((result == "fail") & (quantity >= URGENT_QUANTITY), "urgent"),
            ((result == "fail") | ((result == "warning") & (discount >= RECHECK_DISCOUNT)), "recheck"),
            (result == "warning", "watch"),
        ],
        "none",
    )


@query
def q_rule_classify(spark: SparkSession, source: str) -> DataFrame:
    """First-match handling class on (result, quantity, discount); items per class."""
    items = _items(_t(spark, source))
    handling = _handling(F.col("result"), F.col("l_quantity"), F.col("l_discount"))
    return items.groupBy("inspection_type", handling.alias("handling")).agg(F.count(F.lit(1)).alias("items"))


@query
def q_harmonic_mean(spark: SparkSession, source: str) -> DataFrame:
    """F1 per category as the harmonic mean of precision and recall of 'discount > 0.05'."""
    t = _t(spark, source)
    items = _items(t)
    pred, fail = F.col("l_discount") > 0.05, F.col("result") == "fail"
    pre = items.groupBy("item_sku").agg(
        M.count_where(pred & fail).alias("tp"),
        M.count_where(pred & ~fail).alias("fp"),
        M.count_where(~pred & fail).alias("fn"),
    )
    p = _products(t)
    by_cat = pre.join(p, pre["item_sku"] == p["p_partkey"]).groupBy("product_category").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")
    )
    precision = F.lit(100.0) * M.ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = F.lit(100.0) * M.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    hm = M.clamp(M.harmonic_mean(precision, recall), 0.0, 100.0)
    return by_cat.select(
        "product_category",
        M.round_half_up(precision, 1).alias("precision_pct"),
        M.round_half_up(recall, 1).alias("recall_pct"),
        M.round_half_up(hm, 1).alias("f1_score_pct"),
    )


# ---------------------------------------------------------------------------
# Calendars, panels, validity
# ---------------------------------------------------------------------------


def _order_bounds(t: Tables) -> DataFrame:
    return t.orders.agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))


@query
def q_calendar_spine(spark: SparkSession, source: str) -> DataFrame:
    return spine_from_bounds(_order_bounds(_t(spark, source)), "lo", "hi", "day", "d")


@query
def q_month_spine(spark: SparkSession, source: str) -> DataFrame:
    return spine_from_bounds(_order_bounds(_t(spark, source)), "lo", "hi", "month", "month_start")


@query
def q_weekday_filter(spark: SparkSession, source: str) -> DataFrame:
    days = spine_from_bounds(_order_bounds(_t(spark, source)), "lo", "hi", "day", "d")
    return weekdays_only(days, "d")


def _event_panel(t: Tables) -> DataFrame:
    bounds = t.events.select(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    types = t.events.select("event_type").distinct()
    # each (distributed) event type row generates its calendar: no join, no broadcast
    return panel(types, (lo, hi), "day", "d")


@query
def q_panel_skeleton(spark: SparkSession, source: str) -> DataFrame:
    return _event_panel(_t(spark, source))


@query
def q_panel_months(spark: SparkSession, source: str) -> DataFrame:
    """The panel of the model metrics: every facility, model version and month of the orders."""
    t = _t(spark, source)
    bounds = t.orders.select(F.struct(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))).scalar()
    facilities = t.nation.select(F.col("n_name").alias("facility_id"))
    versions = [v for v, _ in jobs.VERSION_THRESHOLDS]
    return panel(facilities, (bounds["lo"], bounds["hi"]), "month", "evaluation_date", values={"model_version": versions})


@query
def q_densify_daily(spark: SparkSession, source: str) -> DataFrame:
    """High-value events (value >= 250) per day and type, zero-filled over the full panel."""
    t = _t(spark, source)
    facts = (
        t.events.filter(F.col("value") >= 250.0)
        .groupBy(F.to_date("ts").alias("d"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.max("value").alias("max_value"))
    )
    return densify(facts, _event_panel(t), ["d", "event_type"], {"events": 0, "max_value": 0.0})


@query
def q_effective_versions(spark: SparkSession, source: str) -> DataFrame:
    """Predictions kept only from their version's start month; rows and months per version."""
    t = _t(spark, source)
    preds = jobs.predictions(_items(t))
    first_month = F.trunc(F.to_date(t.lineitem.select(F.min("l_shipdate")).scalar()), "month")
    offsets = dimension(spark, VERSION_START_OFFSETS, "model_version string, months int")
    schedule = offsets.select("model_version", F.add_months(first_month, F.col("months")).alias("valid_from"))
    # the schedule is the three-row inline list above: a bounded broadcast
    eligible = effective_from(preds, "model_version", "ts", schedule, broadcast_schedule=True)
    return eligible.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("predictions"),
        F.countDistinct(M.bucket("ts", "month")).alias("eligible_months"),
    )


#: Spells of the versions: overlapping, with a gap, open on either side, one that ends before it begins.
VERSION_SPELLS = (
    ("v1.0", "initial", None, "1997-06-01"), ("v1.0", "patched", "1996-03-15", "1998-01-10"), ("v1.0", "recalled", "1999-01-01", "1999-03-01"),
    ("v1.1", "trial", "1996-07-01", "1996-10-01"), ("v1.1", "rollout", "1996-09-01", None), ("v1.1", "backwards", "2000-01-01", "1999-01-01"),
    ("v1.2", "trial", "1998-05-05", "2000-05-05"), ("v1.2", "parallel", "1998-05-05", "1999-02-01"), ("v1.2", "fixes", "1999-02-01", "1999-02-02"),
)


@query
def q_versions_in_force(spark: SparkSession, source: str) -> DataFrame:
    """Predictions by the spell of their version that was in force; rows and first day of each."""
    preds = jobs.predictions(_items(_t(spark, source))).select("model_version", "ts", "predicted")
    spells = dimension(spark, VERSION_SPELLS, "model_version string, spell string, valid_from string, valid_to string")
    got = in_force(preds, "model_version", "ts", spells, "valid_from", "valid_to", ["spell"])
    return got.groupBy("model_version", "spell").agg(
        F.count(F.lit(1)).alias("predictions"), F.sum("predicted").alias("predicted"), F.min(F.to_date("ts")).alias("first_day")
    )


@query
def q_version_rank(spark: SparkSession, source: str) -> DataFrame:
    """Version labels ranked by all their numeric parts: v2.2 before v2.10, v2.1.9 before v2.1.10."""
    li = _t(spark, source).lineitem
    part = lambda c, n: F.pmod(F.col(c), F.lit(n)).cast("string")
    label = F.concat(F.lit("v"), F.col("l_linenumber").cast("string"), F.lit("."), part("l_suppkey", 12), F.lit("."), part("l_partkey", 11))
    versions = li.select(label.alias("model_version")).distinct().withColumn("parts", version_key("model_version"))
    # labels come from (line number 1..7) x (supplier key mod 12) x (part key mod 11): at most 924 rows
    out = ranked(versions, [F.asc("parts")], keys=["parts"], name="version_rank", method="dense", bounded=True)
    return out.select("model_version", F.array_join(F.col("parts").cast("array<string>"), ".").alias("parts"), "version_rank")


# ---------------------------------------------------------------------------
# Lookups, sampling, ids, text
# ---------------------------------------------------------------------------


@query
def q_indexed_lookup(spark: SparkSession, source: str) -> DataFrame:
    """Orders assigned to an inline list of segments by a hash index; shipments per segment."""
    t = _t(spark, source)
    carriers = dimension(spark, [(c,) for c in SEGMENTS], "carrier_name string")
    idx = hash_int(SEED, "carrier", "o_orderkey", modulo=len(SEGMENTS), method="md5")
    assigned = assign_by_index(t.orders.select("o_orderkey", idx.alias("carrier_idx")), "carrier_idx", carriers,
                               ["carrier_name"], index_name="carrier_idx_join")
    return assigned.groupBy("carrier_name", "carrier_idx").agg(F.count(F.lit(1)).alias("shipments"))


@query
def q_sample_constant(spark: SparkSession, source: str) -> DataFrame:
    orders = _t(spark, source).orders
    s = hash_sample(orders, 0.12, ["o_orderkey"], seed=SEED, salt="constant", method="md5")
    return s.select("o_orderkey", "o_custkey", "o_orderstatus")


@query
def q_sample_stratified(spark: SparkSession, source: str) -> DataFrame:
    # the largest rate cuts the items before the join, the stratum's own rate after it
    keys = ["shipment_id", "l_linenumber", "item_sku"]
    t = _t(spark, source)
    likely = hash_sample(_items(t), 0.30, keys, seed=SEED, salt="stratified", method="md5")
    items = jobs.with_product(likely, t.part)
    rate = classify([(F.col("product_category") == "PROMO", 0.30), (F.col("product_category") == "STANDARD", 0.20)], 0.10)
    s = hash_sample(items, rate, keys, seed=SEED, salt="stratified", method="md5")
    return s.groupBy("product_category").agg(
        F.count(F.lit(1)).alias("sampled_items"), F.sum("processing_time_ms").alias("sampled_quantity")
    )


@query
def q_sample_cluster(spark: SparkSession, source: str) -> DataFrame:
    li = _t(spark, source).lineitem
    s = hash_sample(li, 0.65, ["l_suppkey"], seed=SEED, salt="cluster", method="md5")
    return s.groupBy(F.col("l_suppkey").alias("dock_id")).agg(F.count(F.lit(1)).alias("items"))


@query
def q_sample_exact(spark: SparkSession, source: str) -> DataFrame:
    """25 items of every inspection type and result (most items are passes), by the md5 of their keys."""
    items = _items(_t(spark, source)).select("shipment_id", "l_linenumber", "item_sku", "inspection_type", "result")
    return sample_exact(items, 25, ["inspection_type", "result"], ["shipment_id", "l_linenumber", "item_sku"], seed=SEED)


@query
def q_diff_multiset(spark: SparkSession, source: str) -> DataFrame:
    """Rows (order status, priority) of early and late orders whose numbers differ, with both numbers."""
    orders = _t(spark, source).orders
    side = lambda early: orders.filter((F.pmod("o_orderkey", F.lit(2)) == 0) == early).select("o_orderstatus", "o_orderpriority")
    return diff_multiset(side(True), side(False))


@query
def q_sample_murmur3(spark: SparkSession, source: str) -> DataFrame:
    orders = _t(spark, source).orders
    return hash_sample(orders, 0.12, ["o_orderkey"], seed=SEED, salt="constant").select("o_orderkey")


@query
def q_surrogate_ids(spark: SparkSession, source: str) -> DataFrame:
    ev = _t(spark, source).events.select("event_id", "ts")
    numbered = sequence_id(ev, ["ts", "event_id"], start=10001, name="_seq")
    return numbered.select("event_id", format_id("EVT-", "_seq", 7).alias("event_seq_id"))


@query
def q_assemble_timestamp(spark: SparkSession, source: str) -> DataFrame:
    ev = _t(spark, source).events
    rebuilt = assemble_timestamp(F.to_date("ts"), F.hour("ts"), F.minute("ts"), 0)
    return ev.select("event_id", rebuilt.alias("event_minute"))


@query
def q_slugify(spark: SparkSession, source: str) -> DataFrame:
    s = _t(spark, source).supplier
    return s.select("s_suppkey", "s_name", slugify("s_name").alias("slug"))


# ---------------------------------------------------------------------------
# Table jobs
# ---------------------------------------------------------------------------


@query
def q_item_outcomes(spark: SparkSession, source: str) -> DataFrame:
    t = _t(spark, source)
    return jobs.item_outcomes(t.lineitem, t.part, t.supplier, t.nation)


@query
def q_shipment_rollup(spark: SparkSession, source: str) -> DataFrame:
    """T2 with all of its columns."""
    return jobs.scan_ids(_scans(_t(spark, source)))


@query
def q_model_metrics_monthly(spark: SparkSession, source: str) -> DataFrame:
    return _metrics(_t(spark, source))


#: A hundred versions of the defect model, by discount threshold.
MANY_VERSIONS = tuple((f"t{k:03d}", k / 1000) for k in range(1, 101))


@query
def q_metrics_at_thresholds(spark: SparkSession, source: str) -> DataFrame:
    """Metrics of a hundred thresholds by inspection type, from one histogram of the score."""
    counts = confusion_by_threshold(
        _items(_t(spark, source)), ["inspection_type"], F.col("l_discount"), F.col("result") == "fail", MANY_VERSIONS,
        {"_n_total_inferences": F.count(F.lit(1))},
    )
    return counts.select("inspection_type", "model_version", *[m.final(F.col).alias(m.name) for m in jobs.MODEL_MEASURES[:-1]])


# Length thresholds (n_chars) of the three quality-filter versions.
DOC_VERSION_MIN_CHARS = (("v1.0", 1000), ("v1.1", 1500), ("v1.2", 2500))


@query
def q_label_metrics(spark: SparkSession, source: str) -> DataFrame:
    """Confusion metrics of length-threshold quality filters against labelled documents."""
    t = _t(spark, source)
    docs = t.documents.select("doc_id", "n_chars", F.col("lang").alias("facility_id"))
    labelled = docs.join(t.labels.select("doc_id", "quality"), "doc_id", "inner")
    arr = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(n).alias("n")) for v, n in DOC_VERSION_MIN_CHARS])
    preds = labelled.select("facility_id", "n_chars", "quality", F.explode(arr).alias("_ver")).select(
        "facility_id",
        F.col("_ver.v").alias("model_version"),
        (F.col("n_chars") >= F.col("_ver.n")).cast("int").alias("predicted"),
        F.col("quality").cast("int").alias("actual"),
    )
    return jobs.model_metrics(preds, ["model_version", "facility_id"], with_latency=False)


@query
def q_value_dictionary(spark: SparkSession, source: str) -> DataFrame:
    t = _t(spark, source)
    return (
        value_dictionary(t.orders, ["o_orderstatus", "o_orderpriority"], "orders")
        .unionByName(value_dictionary(t.part, ["p_type", "p_brand"], "part"))
        .unionByName(value_dictionary(t.customer, ["c_mktsegment"], "customer"))
    )


@query
def q_item_value_dictionary(spark: SparkSession, source: str) -> DataFrame:
    """Values of the item table's categorical columns (as used for entity matching), with row counts.

    Item keys are too many to list: those that at least FREQUENT_SHARE of the items have.
    """
    t = _t(spark, source)
    items = _items(t)
    products = lambda counted: jobs.with_product(counted, t.part)
    return (
        value_dictionary(items, ["inspection_type", "result", "defect_type", "severity"], "inspection_events")
        .unionByName(value_dictionary_via(items, "dock_id", _facilities(t), ["facility_id"], "inspection_events"))
        .unionByName(value_dictionary_via(items, "item_sku", products, ["product_category"], "inspection_events"))
        .unionByName(frequent_values(items, "item_sku", FREQUENT_SHARE, "inspection_events"))
    )


@query
def q_shipment_value_dictionary(spark: SparkSession, source: str) -> DataFrame:
    return value_dictionary(_scans(_t(spark, source)), ["facility_id", "direction", "carrier_name", "status"], "dock_scans")


@query
def q_metric_value_dictionary(spark: SparkSession, source: str) -> DataFrame:
    return value_dictionary(
        _metrics(_t(spark, source)), ["model_name", "model_version", "inspection_type", "facility_id"], "model_performance"
    )


@query
def q_frequent_skus(spark: SparkSession, source: str) -> DataFrame:
    return frequent_values(_items(_t(spark, source)), "item_sku", FREQUENT_SHARE, "inspection_events")


def perturbed_orders(orders: DataFrame) -> DataFrame:
    """A copy of ``orders`` with about 2% of prices changed, 1% of rows removed and 1%
    duplicated under a new (negated) key, chosen by md5 hash of the key."""
    u = hash_fraction(SEED, "perturb", "o_orderkey", method="md5")
    base = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", u.alias("_u"))
    kept = base.filter(~((F.col("_u") >= 0.02) & (F.col("_u") < 0.03)))
    changed = kept.withColumn(
        "o_totalprice", F.when(F.col("_u") < 0.02, F.col("o_totalprice") + F.lit(1.0)).otherwise(F.col("o_totalprice"))
    )
    added = base.filter((F.col("_u") >= 0.03) & (F.col("_u") < 0.04)).withColumn("o_orderkey", -F.col("o_orderkey"))
    return changed.unionByName(added).drop("_u")


@query
def q_diff_results(spark: SparkSession, source: str) -> DataFrame:
    orders = _t(spark, source).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return diff_results(orders, perturbed_orders(orders), ["o_orderkey"])


@query
def q_diff_by_digest(spark: SparkSession, source: str) -> DataFrame:
    """The difference of ``q_diff_results``, comparing rows only in key ranges whose digests differ."""
    orders = _t(spark, source).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return diff_by_digest(orders, perturbed_orders(orders), ["o_orderkey"], width=8)


from qualityframe.plans import published  # noqa: E402,F401  registers the queries over published tables
