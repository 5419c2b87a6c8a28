"""Metric vocabulary: named filters, dimensions and measures that compile to Columns.

Every measure is declared as *partial* aggregates (counts, sums, maxima) plus a *final*
expression over them. That split lets ``evaluate`` run a question in one
``groupBy().agg()``, or, when grouping by a dimension attribute, pre-aggregate the
facts by the foreign key first, join the (now key-sized) partials to the dimension and
merge them. Pre-aggregation collapses hot keys map-side and keeps the fact table out
of the join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityframe.functions import measures as M
from qualityframe.functions.rules import map_groups
from qualityframe.operators.sizes import broadcast_if_small

_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Filter:
    name: str
    expr: Callable[[], Column]
    description: str = ""


@dataclass(frozen=True)
class Dimension:
    name: str
    expr: Callable[[], Column]


@dataclass(frozen=True)
class Measure:
    """``parts``: alias -> (aggregate Column factory, merge: 'sum' | 'max' | 'min').
    ``final``: builds the answer from a getter of merged partial columns."""

    name: str
    parts: Callable[[], dict[str, tuple[Column, str]]]
    final: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Via:
    """Pre-aggregate facts by ``fact_keys``, then join ``dim`` on ``dim_keys`` (or run
    ``attach`` on the partials, for dimensions reached through several joins)."""

    fact_keys: Sequence[str]
    dim: DataFrame | None = None
    dim_keys: Sequence[str] = ()
    broadcast: bool = False  # asks for a broadcast, which a count of the dimension must allow
    attach: Callable[[DataFrame], DataFrame] | None = None
    # False: join the fact rows to the dimension first and aggregate once (best when the
    # dimension is small enough to broadcast and keys are not skewed)
    preaggregate: bool = True

    def join(self, pre: DataFrame) -> DataFrame:
        if self.attach is not None:
            return self.attach(pre)
        dim = broadcast_if_small(self.dim) if self.broadcast else self.dim
        cond = [pre[fk] == dim[dk] for fk, dk in zip(self.fact_keys, self.dim_keys)]
        return pre.join(dim, cond, "left")


@dataclass
class Registry:
    filters: dict[str, Filter] = field(default_factory=dict)
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)

    def add(self, item: Filter | Dimension | Measure) -> None:
        target = {Filter: self.filters, Dimension: self.dimensions, Measure: self.measures}[type(item)]
        target[item.name] = item


def parts_of(measures: Sequence[Measure]) -> dict[str, tuple[Column, str]]:
    """The parts of several measures; one that they share is listed once."""
    parts: dict[str, tuple[Column, str]] = {}
    for m in measures:
        for alias, spec in m.parts().items():
            parts.setdefault(alias, spec)
    return parts


def merge_parts(df: DataFrame, parts: dict[str, tuple[Column, str]], by: Sequence[str]) -> DataFrame:
    """Parts that were aggregated before, merged ``by`` coarser keys."""
    return df.groupBy(*by).agg(*[_MERGE[merge](F.col(a)).alias(a) for a, (_, merge) in parts.items()])


def evaluate(
    df: DataFrame,
    measures: Sequence[Measure],
    by: Sequence[str | Dimension] = (),
    where: Sequence[Filter] = (),
    via: Via | None = None,
) -> DataFrame:
    """Answer ``measures`` grouped ``by`` (names or Dimensions) over rows passing ``where``.

    With ``via``, ``where`` filters and Dimension expressions apply to the fact rows before
    the pre-aggregation (they must use fact columns); names in ``by`` may come from either
    side: fact columns join the pre-aggregation key, the rest come from the dimension.
    """
    for f in where:
        df = df.filter(f.expr())
    by_names: list[str] = []
    for b in by:
        if isinstance(b, Dimension):
            df = df.withColumn(b.name, b.expr())
            by_names.append(b.name)
        else:
            by_names.append(b)
    parts = parts_of(measures)
    if via is not None and not via.preaggregate:
        df, via = via.join(df), None
    if via is None:
        grouped = df.groupBy(*by_names).agg(*[agg.alias(a) for a, (agg, _) in parts.items()])
    else:
        fact_by = [c for c in by_names if c in df.columns and c not in via.fact_keys]
        pre = df.groupBy(*via.fact_keys, *fact_by).agg(*[agg.alias(a) for a, (agg, _) in parts.items()])
        grouped = merge_parts(via.join(pre), parts, by_names)
    return grouped.select(*by_names, *[m.final(F.col).alias(m.name) for m in measures])


# ---------------------------------------------------------------------------
# Default vocabulary for item-level (inspection) and shipment-level (scan) tables
# ---------------------------------------------------------------------------

# Defect groups of the defect_category dimension.
DEFECT_GROUPS = {
    "Physical Damage": ("damaged_box", "crushed_corner", "water_damage", "dented_container"),
    "Label Issue": ("torn_label", "sku_mismatch", "missing_label"),
    "Count Error": ("count_discrepancy",),
}


def count_measure(name: str, predicate: Callable[[], Column] | None = None) -> Measure:
    part = f"_n_{name}"

    def parts() -> dict[str, tuple[Column, str]]:
        agg = F.count(F.lit(1)) if predicate is None else M.count_where(predicate())
        return {part: (agg, "sum")}

    return Measure(name, parts, lambda get: get(part))


def rate_measure(name: str, predicate: Callable[[], Column], digits: int = 1) -> Measure:
    num, den = f"_num_{name}", "_n_rows"

    def parts() -> dict[str, tuple[Column, str]]:
        return {num: (M.count_where(predicate()), "sum"), den: (F.count(F.lit(1)), "sum")}

    return Measure(name, parts, lambda get: M.rate_pct(get(num), get(den), digits))


def mean_measure(name: str, col: str, digits: int | None) -> Measure:
    s, n = f"_sum_{col}", f"_cnt_{col}"

    def parts() -> dict[str, tuple[Column, str]]:
        return {s: (F.sum(F.col(col).cast("double")), "sum"), n: (F.count(F.col(col)), "sum")}

    def final(get: Callable[[str], Column]) -> Column:
        value = M.ratio(get(s), get(n))
        return value if digits is None else M.round_half_up(value, digits)

    return Measure(name, parts, final)


def default_registry() -> Registry:
    r = Registry()
    r.add(Filter("failed inspections", lambda: F.col("result") == "fail"))
    r.add(Filter("critical defects", lambda: F.col("severity") == "critical"))
    r.add(Filter("inbound shipments", lambda: F.col("direction") == "inbound"))
    r.add(Dimension("inspection_month", lambda: M.bucket("inspection_timestamp", "month")))
    r.add(Dimension("defect_category", lambda: map_groups("defect_type", DEFECT_GROUPS, "None")))
    r.add(count_measure("total_inspections"))
    r.add(count_measure("failures", lambda: F.col("result") == "fail"))
    r.add(mean_measure("avg_confidence", "confidence_score", 3))
    r.add(rate_measure("defect_rate_pct", lambda: F.col("result") == "fail", 1))
    r.add(rate_measure("pass_rate", lambda: F.col("result") == "pass", 1))
    r.add(mean_measure("avg_scan_time", "total_scan_duration_seconds", 0))
    return r


REGISTRY = default_registry()
