"""The three table jobs: item outcomes (T1), shipment rollup (T2), monthly model metrics (T3).

Input binding (item rows are ``lineitem``):

* result from ``l_returnflag`` (R fail, A warning, N pass);
* inspection type from ``l_linenumber % 3`` (0 item_count, 1 label_scan, 2 damage_check);
* defect type and severity by first-match rules on ``l_tax`` and ``l_quantity``;
* confidence = 1 - l_discount; processing time = l_quantity;
* shipment = order, sku / product / category = part, dock = supplier, facility = nation.

Every classification column depends on the item row alone, so ``item_facts`` is a pure
projection of ``lineitem`` (no join, no shuffle). Dimension attributes are attached only
where a job needs them, and questions that group by a dimension pre-aggregate by its key
first (``registry.Via``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityframe.functions import measures as M
from qualityframe.functions.rules import classify, classify_is
from qualityframe.functions.text import format_id
from qualityframe.operators.ids import sequence_id
from qualityframe.operators.thresholds import confusion_by_threshold
from qualityframe.plans.registry import DEFECT_GROUPS, Measure, Via, count_measure, evaluate

# Inspection types (by l_linenumber % 3), outcomes by return flag,
# model per inspection type, prediction versions and their discount thresholds.
INSPECTION_TYPES = ("item_count", "label_scan", "damage_check")
RESULT_BY_FLAG = {"R": "fail", "A": "warning", "N": "pass"}
MODEL_BY_TYPE = {"item_count": "item_counter", "label_scan": "label_reader", "damage_check": "damage_detector"}
VERSION_THRESHOLDS = (("v1.0", 0.05), ("v1.1", 0.06), ("v1.2", 0.07))
INBOUND_PRIORITIES = ("1-URGENT", "2-HIGH")

ITEM_SOURCE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_discount", "l_tax",
    "l_quantity",
)

LINEITEM_ORDER = (
    "l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)


@dataclass(frozen=True)
class Cuts:
    """Classes along a measure: class k lies between cut k - 1 (included) and cut k (excluded)."""

    classes: tuple[str, ...]
    cuts: tuple[float, ...] = ()

    def of(self, measure: Column) -> Column:
        at = F.lit(0)
        for c in self.cuts:
            at = at + (measure >= c).cast("int")
        return F.get(F.array(*[F.lit(c) for c in self.classes]), at)

    def holds(self, measure: Column, value: str) -> Column:
        """``of(measure) = value`` as a range on the raw measure, which a scan can use."""
        if value not in self.classes:
            return F.lit(False)
        k, out = self.classes.index(value), F.lit(True)
        if k:
            out = out & (measure >= self.cuts[k - 1])
        return out & (measure < self.cuts[k]) if k < len(self.cuts) else out


@dataclass(frozen=True)
class ItemRules:
    """Defects that each inspection type can find along the tax rate, and severities along the quantity."""

    defects: tuple[tuple[str, Cuts], ...] = (
        ("item_count", Cuts(("count_discrepancy",))),
        ("label_scan", Cuts(("missing_label", "torn_label", "sku_mismatch"), (0.02, 0.05))),
        ("damage_check", Cuts(("dented_container", "damaged_box", "crushed_corner", "water_damage"), (0.02, 0.04, 0.06))),
    )
    severities: Cuts = Cuts(("critical", "major", "minor"), (10.0, 30.0))


def inspection_type(linenumber: Column) -> Column:
    slot = F.pmod(linenumber, F.lit(len(INSPECTION_TYPES)))
    return classify([(slot == i, t) for i, t in enumerate(INSPECTION_TYPES)], None)


def outcome(flag: Column) -> Column:
    return classify([(flag == k, v) for k, v in RESULT_BY_FLAG.items()], None)


def _not_passed(result: Column) -> Column:
    return ~result.eqNullSafe(F.lit("pass"))


def defect_type(result: Column, itype: Column, tax: Column, rules: ItemRules = ItemRules()) -> Column:
    found = classify([(itype == name, cuts.of(tax)) for name, cuts in rules.defects], None)
    return F.when(_not_passed(result), found)


def defect_type_is(value: str, rules: ItemRules = ItemRules()) -> Column:
    """``defect_type = value`` over item facts with the tax cut as a pushable conjunct."""
    name, cuts = next((n, c) for n, c in rules.defects if value in c.classes)
    return _not_passed(F.col("result")) & (F.col("inspection_type") == name) & cuts.holds(F.col("l_tax"), value)


def severity(result: Column, qty: Column, rules: ItemRules = ItemRules()) -> Column:
    return F.when(_not_passed(result), rules.severities.of(qty))


def severity_is(value: str, rules: ItemRules = ItemRules()) -> Column:
    """``severity = value`` over item facts, with the quantity cut as a pushable conjunct
    (on a lineitem scan: ``l_quantity < 10`` reaches parquet as a PushedFilter)."""
    return _not_passed(F.col("result")) & rules.severities.holds(F.col("l_quantity"), value)


def item_facts(lineitem: DataFrame, rules: ItemRules = ItemRules(), extra: Sequence[str] = ()) -> DataFrame:
    """Item-level classification, one row per lineitem row, keys kept for later joins."""
    result = outcome(F.col("l_returnflag"))
    itype = inspection_type(F.col("l_linenumber"))
    base = lineitem.select(
        F.col("l_orderkey").alias("shipment_id"),
        F.col("l_partkey").alias("item_sku"),
        F.col("l_suppkey").alias("dock_id"),
        "l_linenumber",
        F.col("l_shipdate").alias("inspection_timestamp"),
        itype.alias("inspection_type"),
        result.alias("result"),
        (F.lit(1.0) - F.col("l_discount")).alias("confidence_score"),
        "l_discount",
        "l_tax",
        "l_quantity",
        *extra,
    )
    return base.select(
        "*",
        defect_type(F.col("result"), F.col("inspection_type"), F.col("l_tax"), rules).alias("defect_type"),
        severity(F.col("result"), F.col("l_quantity"), rules).alias("severity"),
        F.col("l_quantity").cast("int").alias("processing_time_ms"),
    )


def product_dim(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey"), F.col("p_name").alias("product_name"), F.col("p_type").alias("product_category")
    )


def facility_attach(supplier: DataFrame, nation: DataFrame, key: str = "dock_id") -> Callable[[DataFrame], DataFrame]:
    """Attach ``facility_id`` to rows keyed by supplier: join the supplier scan first, then the nations.

    Joining the plain scans lets the planner size them from file statistics (a
    broadcast while small, a shuffle join with AQE skew splitting once it is large); a
    pre-joined supplier-nation frame would always be estimated too big to broadcast,
    forcing a shuffle of the fact side.
    """

    def attach(df: DataFrame) -> DataFrame:
        s = supplier.select("s_suppkey", "s_nationkey")
        nat = nation.select("n_nationkey", F.col("n_name").alias("facility_id"))
        out = df.join(s, df[key] == s["s_suppkey"], "left")
        out = out.join(nat, out["s_nationkey"] == nat["n_nationkey"], "left")
        return out.drop("s_suppkey", "s_nationkey", "n_nationkey")

    return attach


def with_product(items: DataFrame, part: DataFrame) -> DataFrame:
    p = product_dim(part)
    return items.join(p, items["item_sku"] == p["p_partkey"], "left").drop("p_partkey")


def with_facility(items: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return facility_attach(supplier, nation)(items)


ITEM_COLUMNS = (
    "inspection_id", "inspection_timestamp", "facility_id", "dock_id", "shipment_id", "item_sku", "product_name",
    "product_category", "inspection_type", "result", "confidence_score", "defect_type", "severity",
    "processing_time_ms",
)


def item_outcomes(
    lineitem: DataFrame,
    part: DataFrame,
    supplier: DataFrame,
    nation: DataFrame,
    rules: ItemRules = ItemRules(),
    id_prefix: str = "INS-",
    id_base: int = 10000,
    id_width: int = 7,
    extra: Sequence[str] = (),
) -> DataFrame:
    """T1: classified items with dimension attributes and dense ids (and ``extra`` columns of the item facts).

    Ids follow (l_shipdate, then every other lineitem column): a total order on this
    data, so they equal ROW_NUMBER() OVER (ORDER BY ...) + base, computed in parallel.
    """
    # sort by every column, but checkpoint only the columns the item facts use
    numbered = sequence_id(
        lineitem, list(LINEITEM_ORDER), start=id_base + 1, name="_qf_seq", keep=list(ITEM_SOURCE_COLUMNS)
    )
    facts = item_facts(numbered, rules, extra=("_qf_seq",))
    facts = facts.withColumn("inspection_id", format_id(id_prefix, "_qf_seq", id_width))
    return _attach_items(facts, part, supplier, nation, extra)


def _attach_items(facts: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame, extra: Sequence[str]) -> DataFrame:
    joined = with_facility(with_product(facts, part), supplier, nation)
    return joined.select(*ITEM_COLUMNS, *extra)


# ---------------------------------------------------------------------------
# T2: shipment rollup
# ---------------------------------------------------------------------------


#: Shares of failed lines above which a shipment is rejected or flagged.
REJECT_ABOVE, FLAG_ABOVE = 0.6, 0.3


def shipment_rollup(items: DataFrame, reject_above: float = REJECT_ABOVE, flag_above: float = FLAG_ABOVE) -> DataFrame:
    """The counts and rates of T2: one row per shipment from its items (passed + failed + warning = verified).

    A shipment of several suppliers belongs to the dock of its lowest line (the smaller dock on a tie).

    One hash aggregate keyed by shipment; partial aggregation happens map-side, so an
    order with many lines costs one partial row per task before the shuffle.
    """
    physical = list(DEFECT_GROUPS["Physical Damage"])
    place = [c for c in ("dock_id", "facility_id") if c in items.columns]  # a dock has one facility
    g = items.groupBy("shipment_id").agg(
        F.max("l_linenumber").alias("expected_item_count"),
        F.count(F.lit(1)).alias("verified_item_count"),
        M.count_where(F.col("result") == "pass").alias("items_passed"),
        M.count_where(F.col("result") == "fail").alias("items_failed"),
        M.count_where(F.col("result") == "warning").alias("items_warning"),
        M.count_where(F.col("defect_type") == "sku_mismatch").alias("_mismatch"),
        M.count_where(F.col("defect_type").isin(physical)).alias("_damaged"),
        F.min("inspection_timestamp").alias("_first"),
        F.max("inspection_timestamp").alias("_last"),
        F.min(F.struct("l_linenumber", *place)).alias("_lead"),
    )
    fail_share = M.ratio(F.col("items_failed"), F.col("verified_item_count"))
    return g.select(
        "shipment_id",
        *[F.col(f"_lead.{c}").alias(c) for c in place],
        F.to_date("_last").alias("scan_date"),
        "expected_item_count",
        "verified_item_count",
        "items_passed",
        "items_failed",
        "items_warning",
        M.round_half_up(
            F.lit(100.0) * (F.lit(1.0) - M.ratio(F.col("_mismatch"), F.col("verified_item_count"))), 1
        ).alias("sku_match_rate_pct"),
        M.rate_pct(F.col("_damaged"), F.col("verified_item_count"), 1).alias("damage_rate_pct"),
        F.timestamp_diff("SECOND", F.col("_first"), F.col("_last")).alias("total_scan_duration_seconds"),
        classify(
            [(fail_share > F.lit(float(reject_above)), "rejected"), (fail_share > F.lit(float(flag_above)), "flagged")],
            "completed",
        ).alias("status"),
    )


def _direction_rules() -> list:
    return [(F.col("o_orderpriority").isin(list(INBOUND_PRIORITIES)), "inbound")]


def direction() -> Column:
    """inbound for the urgent priorities, else outbound."""
    return classify(_direction_rules(), "outbound")


def direction_is(value: str) -> Column:
    """``direction = value`` as a predicate on ``o_orderpriority`` (an IN list the parquet
    scan of orders accepts as a pushed filter)."""
    return classify_is(_direction_rules(), "outbound", value)


def _carriers(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", F.col("c_mktsegment").alias("carrier_name"))


SCAN_COLUMNS = (
    "scan_id", "shipment_id", "scan_date", "facility_id", "dock_id", "direction", "carrier_name", "expected_item_count",
    "verified_item_count", "items_passed", "items_failed", "items_warning", "sku_match_rate_pct", "damage_rate_pct",
    "total_scan_duration_seconds", "status",
)


def shipment_scans(
    rollup: DataFrame, orders: DataFrame, customer: DataFrame, facilities: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """T2 without its ids: the rollup with facility, direction and carrier; a shipment that is not listed keeps NULLs.

    The orders meet the rollup on its own shuffle key; supplier and customer are left to Spark (a
    broadcast while small). Items that had a facility need no ``facilities``.
    """
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority", direction().alias("direction"))
    out = rollup.join(o, rollup["shipment_id"] == o["o_orderkey"], "left")
    c = _carriers(customer)
    out = out.join(c, out["o_custkey"] == c["c_custkey"], "left")
    out = facilities(out) if facilities is not None else out
    return out.select(*SCAN_COLUMNS[1:], "o_orderpriority")


def with_direction(rollup: DataFrame, orders: DataFrame) -> DataFrame:
    """The rollup with ``direction`` (and the priority it rests on), for questions that need no more of T2."""
    o = orders.select("o_orderkey", "o_orderpriority", direction().alias("direction"))
    return rollup.join(o, rollup["shipment_id"] == o["o_orderkey"], "left").drop("o_orderkey")


SCAN_ORDER = ("scan_date", "facility_id", "dock_id", "shipment_id")


def scan_ids(scans: DataFrame, after: int = 10000, prefix: str = "SCN-", width: int = 7) -> DataFrame:
    """T2: ``scan_id`` counts on from ``after``, by date, facility, dock and shipment (one row per shipment: a total order)."""
    columns = list(SCAN_COLUMNS[1:])
    numbered = sequence_id(scans.select(*columns), list(SCAN_ORDER), start=after + 1, name="_scan")
    return numbered.select(format_id(prefix, "_scan", width).alias("scan_id"), *columns)


# ---------------------------------------------------------------------------
# T3: monthly model metrics from predictions
# ---------------------------------------------------------------------------


def predictions(items: DataFrame, versions: Sequence[tuple[str, float]] = VERSION_THRESHOLDS) -> DataFrame:
    """(ts, model_name, model_version, inspection_type, dock_id, predicted, actual, latency_ms).

    Each item is scored by every version: version k predicts a defect when the discount
    exceeds its threshold; the truth is ``result = 'fail'``. The version fan-out is a
    Generate inside the scan stage, followed directly by the partial aggregate.
    """
    arr = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(float(t)).alias("t")) for v, t in versions])
    model = classify([(F.col("inspection_type") == k, v) for k, v in MODEL_BY_TYPE.items()], None)
    return items.select(
        F.col("inspection_timestamp").alias("ts"),
        model.alias("model_name"),
        F.explode(arr).alias("_ver"),
        "inspection_type",
        "dock_id",
        "l_discount",
        "result",
        "l_quantity",
    ).select(
        "ts",
        "model_name",
        F.col("_ver.v").alias("model_version"),
        "inspection_type",
        "dock_id",
        (F.col("l_discount") > F.col("_ver.t")).cast("int").alias("predicted"),
        (F.col("result") == "fail").cast("int").alias("actual"),
        F.col("l_quantity").cast("double").alias("latency_ms"),
    )


def _confusion_parts() -> dict[str, tuple[Column, str]]:
    p, a = F.col("predicted"), F.col("actual")
    return {
        "_tp": (M.count_where((p == 1) & (a == 1)), "sum"),
        "_fp": (M.count_where((p == 1) & (a == 0)), "sum"),
        "_fn": (M.count_where((p == 0) & (a == 1)), "sum"),
        "_tn": (M.count_where((p == 0) & (a == 0)), "sum"),
    }


def _metric(name: str, num: list[tuple[int, str]], den: list[tuple[int, str]]) -> Measure:
    def lin(get, terms):
        out = None
        for coef, part in terms:
            term = get(part) * F.lit(coef) if coef != 1 else get(part)
            out = term if out is None else out + term
        return out

    return Measure(name, _confusion_parts, lambda get: M.rate_pct(lin(get, num), lin(get, den), 1))


PRECISION = _metric("precision_pct", [(1, "_tp")], [(1, "_tp"), (1, "_fp")])
RECALL = _metric("recall_pct", [(1, "_tp")], [(1, "_tp"), (1, "_fn")])
F1 = _metric("f1_score_pct", [(2, "_tp")], [(2, "_tp"), (1, "_fp"), (1, "_fn")])
FPR = _metric("false_positive_rate_pct", [(1, "_fp")], [(1, "_fp"), (1, "_tn")])
FNR = _metric("false_negative_rate_pct", [(1, "_fn")], [(1, "_fn"), (1, "_tp")])
TOTAL_INFERENCES = count_measure("total_inferences")


def _latency_parts() -> dict[str, tuple[Column, str]]:
    return {"_lat_sum": (F.sum("latency_ms"), "sum"), "_lat_n": (F.count("latency_ms"), "sum")}


AVG_LATENCY = Measure(
    "avg_latency_ms",
    _latency_parts,
    lambda get: M.round_half_up(M.ratio(get("_lat_sum"), get("_lat_n")), 0).cast("long"),
)
MODEL_MEASURES = (PRECISION, RECALL, F1, FPR, FNR, TOTAL_INFERENCES, AVG_LATENCY)


def model_metrics(preds: DataFrame, by: Sequence[str], via: Via | None = None, with_latency: bool = True) -> DataFrame:
    """Confusion-matrix metrics (x100, 1 dp, NULL on a zero denominator) per ``by`` group."""
    ms = MODEL_MEASURES if with_latency else MODEL_MEASURES[:-1]
    return evaluate(preds, ms, by=list(by), via=via)


def model_metrics_monthly(
    items: DataFrame,
    facilities: Callable[[DataFrame], DataFrame] | None = None,
    versions: Sequence[tuple[str, float]] = VERSION_THRESHOLDS,
    facility: str = "dock_id",
) -> DataFrame:
    """T3: one row per (month, model, version, inspection type, facility) from item facts.

    Every version scores every item; one histogram of the score gives the counts of all of them
    (``confusion_by_threshold``), however many. With ``facilities`` (``facility_attach``) the
    counts are first pre-aggregated per dock (supplier), which also collapses a hot supplier
    map-side, then joined to the facility and merged; else the facility is the column ``facility``.
    Same output as ``model_metrics(predictions(items), ...)`` on the long form.
    """
    model = classify([(F.col("inspection_type") == k, v) for k, v in MODEL_BY_TYPE.items()], None)
    p = items.withColumn("evaluation_date", M.bucket("inspection_timestamp", "month")).withColumn("model_name", model)
    keys = ["evaluation_date", "model_name", "inspection_type"]
    if facilities is None:
        p, keys, via = p.withColumn("facility_id", F.col(facility)), [*keys, "facility_id"], None
    else:
        via = (["dock_id"], facilities, ["facility_id"])
    counts = confusion_by_threshold(
        p, keys, F.col("l_discount"), F.col("result") == "fail", versions,
        {
            "_n_total_inferences": F.count(F.lit(1)), "_lat_sum": F.sum(F.col("l_quantity").cast("double")),
            "_lat_n": F.count(F.col("l_quantity")),
        },
        via,
    )
    return counts.select(
        "evaluation_date", "model_name", "model_version", "inspection_type", "facility_id",
        *[m.final(F.col).alias(m.name) for m in MODEL_MEASURES],
    )
