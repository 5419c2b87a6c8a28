"""Rule-based classification as Column expressions.

All rules compile to one searched CASE (chained ``F.when``) evaluated inside whole-stage
codegen; first matching rule wins, exactly like SQL CASE. Rule lists are data, so the
same operators serve outcome, defect, severity and score assignment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from qualityframe.functions.columns import ColumnLike, lit_or_col, to_col


def classify(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First-match rule list: ``[(condition, value), ...]`` else ``default``."""
    if not rules:
        return lit_or_col(default)
    expr = None
    for cond, value in rules:
        expr = F.when(cond, lit_or_col(value)) if expr is None else expr.when(cond, lit_or_col(value))
    return expr.otherwise(lit_or_col(default))


def classify_is(rules: Sequence[tuple[Column, object]], default: object, value: object) -> Column:
    """Predicate equal (in a WHERE clause) to ``classify(rules, default) = value``, written
    so that the matching rule's condition is a top-level conjunct.

    Earlier rules must not have fired (``NOT coalesce(cond, false)``, as CASE skips a NULL
    condition) and the matching rule's own condition must hold. Spark can then push plain
    comparisons in that condition (e.g. ``l_quantity < 8``) into the parquet scan, which it
    cannot do for the CASE expression itself. Values must be plain literals.
    """
    options = []
    earlier: list[Column] = []
    for cond, v in rules:
        if v is not None and not isinstance(v, Column) and v == value:
            options.append((earlier[:], cond))
        earlier.append(cond)
    if default is not None and not isinstance(default, Column) and default == value:
        options.append((earlier[:], None))
    if not options:
        return F.lit(False)
    preds = []
    for before, cond in options:
        pred = cond if cond is not None else F.lit(True)
        for b in before:
            pred = pred & ~F.coalesce(b, F.lit(False))
        preds.append(pred)
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return out


def map_groups(col: ColumnLike, groups: Mapping[str, Sequence[object]], default: object = "None") -> Column:
    """Value-set CASE: the first group whose value list contains ``col``; NULL -> default."""
    c = to_col(col)
    return classify([(c.isin(list(values)), name) for name, values in groups.items()], default)


def version_key(version: ColumnLike) -> Column:
    """All numbers of a label like ``v2.1.10`` as an array of longs, which sorts part by part.

    NULL and labels without a number give NULL; ``v2.1`` sorts before ``v2.1.0``.
    """
    parts = F.regexp_extract_all(to_col(version), F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(parts) > 0, parts.cast("array<bigint>"))
