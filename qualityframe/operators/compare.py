"""Result comparison and categorical value dictionaries."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_results(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str] | None = None,
) -> DataFrame:
    """Keyed difference of two results: one row per key that is missing on a side, whose
    compared values differ (NULL-safe), or that is not unique on a side.

    Output: keys, ``diff`` in {'only_left', 'only_right', 'changed', 'duplicate_key'} and
    ``changed_columns`` (comma list, in column order).

    Each side is first collapsed to one row per key by a partial (map-side) aggregate that
    keeps the row count and, for single rows, the values; the two key-unique sides are then
    full-outer joined on the keys, reusing the aggregate's hash partitioning. A key repeated
    on either side is reported instead of being paired row by row, so a hot duplicated key
    never multiplies into all its pairs.
    """
    keys = list(keys)
    cols = list(compare) if compare is not None else [c for c in left.columns if c not in keys]
    missing = [c for c in cols if c not in right.columns]
    if missing:
        raise ValueError(f"columns missing on the right: {missing}")

    def collapse(df: DataFrame, side: str) -> DataFrame:
        # min over a single row is that row's value (NULL included); count tells single from repeated
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"_{side}_n"), *[F.min(c).alias(f"_{side}_{c}") for c in cols]
        )

    # NULL keys are equal: the keys of the sides are compared null-safe (still a hash join) and merged
    lhs, rhs = collapse(left, "l"), collapse(right, "r").withColumnsRenamed({k: f"_r_key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_key_{k}")) for k in keys]
    joined = lhs.join(rhs, same, "full_outer").withColumns(
        {k: F.when(F.col("_l_n").isNull(), F.col(f"_r_key_{k}")).otherwise(F.col(k)) for k in keys}
    )
    ln, rn = F.col("_l_n"), F.col("_r_n")
    differs = {c: ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")) for c in cols}
    any_diff = F.lit(False)
    for c in cols:
        any_diff = any_diff | differs[c]
    diff = (
        F.when(rn.isNull(), F.lit("only_left"))
        .when(ln.isNull(), F.lit("only_right"))
        .when((ln > 1) | (rn > 1), F.lit("duplicate_key"))
        .when(any_diff, F.lit("changed"))
    )
    changed_cols = F.concat_ws(",", *[F.when(differs[c], F.lit(c)) for c in cols]) if cols else F.lit("")
    out = joined.select(*keys, diff.alias("diff"), changed_cols.alias("_changed"))
    return out.filter(F.col("diff").isNotNull()).select(
        *keys, "diff", F.when(F.col("diff") == "changed", F.col("_changed")).otherwise(F.lit("")).alias("changed_columns")
    )


def diff_multiset(left: DataFrame, right: DataFrame) -> DataFrame:
    """Unkeyed difference with multiplicity: every row whose numbers differ, with ``left_n`` and ``right_n``.

    One union and one partial (map-side) aggregate, so a row repeated a billion times is one
    row per task before the shuffle and one row of the result.
    """
    cols = left.columns
    both = left.withColumns({"left_n": F.lit(1), "right_n": F.lit(0)}).unionByName(
        right.select(*cols).withColumns({"left_n": F.lit(0), "right_n": F.lit(1)})
    )
    return both.groupBy(*cols).agg(F.sum("left_n").alias("left_n"), F.sum("right_n").alias("right_n")).filter("left_n <> right_n")


def value_dictionary(df: DataFrame, columns: Sequence[str], table_name: str | None = None) -> DataFrame:
    """(table_name, column_name, value, rows) for each distinct value of each column.

    One pass: the columns are unpivoted into (column_name, value) pairs and counted with a
    partial (map-side) aggregate, so a hot value costs one row per task before the shuffle.
    """
    cols = list(columns)
    if not cols:
        raise ValueError("value_dictionary needs at least one column")
    narrow = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = narrow.unpivot([], cols, "column_name", "value")
    counted = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("rows"))
    if table_name is not None:
        counted = counted.select(F.lit(table_name).alias("table_name"), "*")
    return counted


def frequent_values(df: DataFrame, column: str, share: float, table_name: str | None = None) -> DataFrame:
    """(table_name, column_name, value, rows) of every value that at least ``share`` of the non-null rows hold, exact.

    For columns with too many values to list. First a mergeable sketch of frequent items, of a
    size that follows from ``share`` alone, gives candidates: with M counters its estimates are
    off by 3.5 / M of the rows at most, so no such value is missing among the top
    1 / (share - 3.5 / M). Then the candidates, a bounded list, are broadcast and counted.
    """
    if not 0.00001 <= share <= 1:
        raise ValueError("share must lie in [0.00001, 1]")
    counters = 1 << (math.ceil(16 / share) - 1).bit_length()
    counters = min(counters, 1_000_000)
    top = math.ceil(1 / (share - 3.5 / counters)) + 1
    values = df.select(F.col(column).cast("string").alias("value"))
    told = values.agg(F.count("value").alias("n"), F.expr(f"approx_top_k(value, {top}, {counters})").alias("t"))
    likely = told.select("n", F.explode("t.item").alias("likely"))
    counted = values.join(F.broadcast(likely), F.col("value") == F.col("likely")).groupBy("value", "n").agg(F.count(F.lit(1)).alias("rows"))
    out = counted.filter(F.col("rows") >= F.lit(share) * F.col("n")).select(F.lit(column).alias("column_name"), "value", "rows")
    return out if table_name is None else out.select(F.lit(table_name).alias("table_name"), "*")


def value_dictionary_via(
    df: DataFrame, key: str, attach: Callable[[DataFrame], DataFrame], columns: Sequence[str], table_name: str
) -> DataFrame:
    """``value_dictionary`` of columns that a dimension gives: rows are counted by ``key`` before ``attach`` joins it."""
    counted = attach(df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")))
    long = counted.select("_rows", *columns).unpivot(["_rows"], list(columns), "column_name", "value")
    out = long.groupBy("column_name", "value").agg(F.sum("_rows").alias("rows"))
    return out.select(F.lit(table_name).alias("table_name"), "*")


def check_answer(actual: DataFrame, expected: DataFrame, keys: Sequence[str] | None = None) -> dict:
    """Grade ``actual`` against a gold answer: column names and types, then row differences
    (keyed with ``diff_results``, else as multisets). Only the per-kind counts (a handful of
    rows) reach the driver."""
    a_schema = {f.name: f.dataType.simpleString() for f in actual.schema.fields}
    e_schema = {f.name: f.dataType.simpleString() for f in expected.schema.fields}
    result: dict = {
        "missing_columns": sorted(set(e_schema) - set(a_schema)),
        "extra_columns": sorted(set(a_schema) - set(e_schema)),
        "type_mismatches": sorted(c for c in set(a_schema) & set(e_schema) if a_schema[c] != e_schema[c]),
    }
    result["schema_match"] = not (result["missing_columns"] or result["extra_columns"] or result["type_mismatches"])
    counts = {"only_left": 0, "only_right": 0, "changed": 0, "duplicate_key": 0}
    if result["schema_match"]:
        cols = list(e_schema)
        if keys:
            diffs = diff_results(actual.select(*cols), expected.select(*cols), keys)
            kinds = diffs.groupBy("diff").count()
        else:
            surplus = diff_multiset(actual.select(*cols), expected.select(*cols))
            kinds = surplus.groupBy(F.when(F.col("left_n") > F.col("right_n"), "only_left").otherwise("only_right").alias("diff")).agg(
                F.sum(F.abs(F.col("left_n") - F.col("right_n"))).alias("count")
            )
        counts.update({r["diff"]: r["count"] for r in kinds.collect()})
    result.update(counts)
    result["passed"] = result["schema_match"] and not any(counts.values())
    return result
