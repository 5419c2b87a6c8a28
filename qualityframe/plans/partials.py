"""Stored partial aggregates: measures answered without reading the facts again.

A ``Measure`` is declared as parts that merge (counts, sums, extremes) and a final expression.
The parts by day and key are small; stored as a published table, they answer every coarser
question, and new days are appended as a load with their own parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityframe.functions import measures as M
from qualityframe.plans.registry import Dimension, Filter, Measure, Via, merge_parts, parts_of
from qualityframe.sources.versions import append_load, commit_version

DAY = Dimension("inspection_date", lambda: M.bucket("inspection_timestamp", "day"))
#: Questions by month over stored days.
MONTH = Dimension("inspection_month", lambda: M.bucket(DAY.name, "month"))


def partial_aggregates(facts: DataFrame, measures: Sequence[Measure], keys: Sequence[str | Dimension]) -> DataFrame:
    """The parts of ``measures`` by ``keys``: one row per combination of keys."""
    for k in keys:
        if isinstance(k, Dimension):
            facts = facts.withColumn(k.name, k.expr())
    names = [k.name if isinstance(k, Dimension) else k for k in keys]
    return facts.groupBy(*names).agg(*[agg.alias(a) for a, (agg, _) in parts_of(measures).items()])


def publish_partials(
    facts: DataFrame, measures: Sequence[Measure], keys: Sequence[str | Dimension], name: str, schema: str
) -> int:
    """Store the parts as ``schema.name``, a table that ``append_partials`` extends; returns its rows."""
    return commit_version(partial_aggregates(facts, measures, keys), name, schema, loads=True)


def append_partials(
    new_facts: DataFrame, measures: Sequence[Measure], keys: Sequence[str | Dimension], name: str, schema: str
) -> int:
    """Add the parts of ``new_facts`` only. A day that both loads hold has two rows, which answers merge."""
    return append_load(partial_aggregates(new_facts, measures, keys), name, schema)


def answer_from_partials(
    spark: SparkSession,
    name: str,
    schema: str,
    measures: Sequence[Measure],
    by: Sequence[str | Dimension] = (),
    where: Sequence[Filter] = (),
    via: Via | None = None,
) -> DataFrame:
    """Answer ``measures`` by stored keys, expressions of them or, ``via`` a dimension, its attributes.

    ``where`` may use the stored keys. The facts are not read.
    """
    stored = spark.table(f"{schema}.{name}")
    for f in where:
        stored = stored.filter(f.expr())
    names = []
    for b in by:
        if isinstance(b, Dimension):
            stored = stored.withColumn(b.name, b.expr())
        names.append(b.name if isinstance(b, Dimension) else b)
    parts = parts_of(measures)
    missing = sorted(set(parts) - set(stored.columns))
    if missing:
        raise ValueError(f"{schema}.{name} does not hold the parts {missing}")
    if via is not None:
        own = [c for c in names if c in stored.columns and c not in via.fact_keys]
        stored = via.join(merge_parts(stored, parts, [*via.fact_keys, *own]))
    merged = merge_parts(stored, parts, names)
    return merged.select(*names, *[m.final(F.col).alias(m.name) for m in measures])
