"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A tree of levels (domain, language, source) shares a token budget by weight, from the
root down. Each node's children are filled like vessels: a child that cannot use its share
is filled up and the rest goes to its siblings; as a node is never given more than its
subtree holds, a shortage reaches an ancestor only when all siblings are full. A leaf
whose budget exceeds its tokens is repeated for whole epochs; the last, partial epoch is
the prefix of a seeded order of its documents.

All arithmetic is in whole tokens. The prefix of a leaf is found over 4096 ranges of the
seeded key: range sums (pre-aggregated in every task) locate the range in which the budget
ends, and only the rows of that range are sorted. A leaf with a third of all rows is thus
never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, small_side, table

TOKENS = "decimal(20,0)"
WIDE = "decimal(38,0)"
LEVELS = ("domain", "lang", "source")
#: Target weights of the registered query and the pipeline; members not named weigh 1.
WEIGHTS = {"domain": {"domain0": 5, "domain1": 3, "domain2": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
SEED = 17
MISSING = "unknown"


def _weight(level: str, weights: Mapping[str, Mapping[str, int]], default: int) -> Column:
    known = weights.get(level, {})
    if not known:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(pairs[F.col(level)], F.lit(default))


def _share(nodes: DataFrame, parent: Sequence[str], own: str) -> DataFrame:
    """Give each node's ``budget`` to its children (columns ``cap``, ``w``): adds ``alloc``."""
    key = list(parent) or [F.lit(0)]
    order = Window.partitionBy(*key).orderBy(F.col("cap") / F.col("w"), own)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    zero = F.lit(0).cast(TOKENS)
    d = nodes.withColumns(
        {
            "cap0": F.coalesce(F.sum("cap").over(before).cast(TOKENS), zero),
            "w0": F.coalesce(F.sum("w").over(before), F.lit(0)),
            "w_all": F.sum("w").over(whole),
        }
    )
    fits = F.col("cap") * (F.col("w_all") - F.col("w0")).cast("decimal(12,0)") <= (
        F.col("budget") - F.col("cap0")
    ).cast(TOKENS) * F.col("w").cast("decimal(12,0)")
    d = d.withColumn("full", F.min(fits.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    open_w = F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(whole), F.lit(1))
    spare = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), zero)
    d = d.withColumns({"open_w": open_w.cast("decimal(12,0)"), "spare": spare.cast(TOKENS)})
    base = F.expr(f"CAST(spare * CAST(w AS DECIMAL(12,0)) AS {WIDE}) div open_w")
    d = d.withColumn("base", F.when(F.col("full"), F.col("cap")).otherwise(base).cast(TOKENS))
    rest = F.col("budget") - F.coalesce(F.sum("base").over(whole).cast(TOKENS), zero)
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("full", own))
    d = d.withColumns({"rest": rest.cast(TOKENS), "turn": turn})
    extra = (~F.col("full") & (F.col("turn") <= F.col("rest"))).cast("int")
    return d.withColumn("alloc", (F.col("base") + extra).cast(TOKENS)).drop(
        "cap0", "w0", "w_all", "full", "open_w", "spare", "base", "rest", "turn"
    )


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]],
    budget: Column, max_epochs: int, default_weight: int = 1,
) -> DataFrame:
    """Budget of every leaf; ``leaves`` has the level columns and ``tokens`` (long).

    ``budget`` is an expression over ``tokens`` of the whole tree (a literal, or a share).
    A weight of 0 or less gives its subtree nothing. Budgets of a level sum to the smaller
    of the budget and what the tree holds over ``max_epochs`` epochs.
    """
    d = leaves
    usable = F.lit(True)
    for level in levels:
        d = d.withColumn(f"w_{level}", _weight(level, weights, default_weight).cast("long"))
        usable = usable & (F.col(f"w_{level}") > 0)
    d = d.withColumn("cap", F.when(usable, F.col("tokens").cast(TOKENS) * F.lit(max_epochs)).otherwise(F.lit(0)).cast(TOKENS))
    d = d.withColumns({f"w_{x}": F.greatest(F.col(f"w_{x}"), F.lit(1)) for x in levels})
    every = Window.partitionBy(F.lit(0))
    root = F.least(budget.cast(TOKENS), F.sum("cap").over(every).cast(TOKENS))
    d = d.withColumn("all_tokens", F.sum("tokens").over(every)).withColumn("budget", root)
    d = checkpointed(d)
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = d.groupBy(*path).agg(
            F.sum("cap").cast(TOKENS).alias("cap"), F.first(f"w_{level}").alias("w"), F.first("budget").alias("budget")
        )
        got = _share(nodes, levels[:depth], level).select(*path, F.col("alloc").alias("budget"))
        d = d.drop("budget").join(got, path)
    return checkpointed(d.select(*levels, "tokens", "budget"))


def _key(seed: int, epoch: Column, ident: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(ident).cast("string"), F.lit("null"))))


def mixture(
    slim: DataFrame, levels: Sequence[str] = LEVELS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS,
    budget_share: float = 1.0, max_epochs: int = 3, seed: int = SEED, ident: str = "doc_id", tokens: str = "n_tokens",
    budget_tokens: int | None = None,
) -> DataFrame:
    """The mixture: one row per chosen document and epoch, with ``epoch`` and ``taken`` (its leading tokens).

    ``slim`` holds ``ident``, the level columns and ``tokens`` (checkpoint it: it is read three
    times) and may hold more. Null levels count as the member "unknown", null tokens as 0; rows
    without tokens are never chosen. Rows that share an ``ident`` share one place in the order:
    they are taken together, each cut to what is left there. An empty table gives none. Columns of
    ``slim`` named ``epoch`` or ``taken`` are replaced, helpers' names (``__t``, ``__full``, ``__rem``, ``__key``, ``__range``) are dropped.
    """
    slim = slim.withColumns({x: F.coalesce(F.col(x).cast("string"), F.lit(MISSING)) for x in levels})
    slim = slim.withColumn("__t", F.coalesce(F.col(tokens), F.lit(0)).cast("long")).filter("__t > 0")
    leaves = slim.groupBy(*levels).agg(F.sum("__t").alias("tokens"))
    goal = F.lit(budget_tokens) if budget_tokens is not None else F.floor(
        F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(round(budget_share * 1000)) / F.lit(1000)
    )
    plan = leaf_budgets(leaves, levels, weights, goal, max_epochs)
    plan = plan.select(
        *levels, F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("__full"),
        (F.col("budget") % F.col("tokens")).cast("long").alias("__rem"),
    )
    plan = small_side(checkpointed(plan))
    rows = slim.join(plan, list(levels)).withColumn("__key", _key(seed, F.col("__full"), ident))
    rows = rows.withColumn("__range", F.substring("__key", 1, 3))
    # where each leaf's partial epoch ends: first the range, then the key inside it
    by_range = rows.filter("__rem > 0").groupBy(*levels, "__range").agg(
        F.sum("__t").alias("s"), F.first("__rem").alias("rem")
    )
    before = Window.partitionBy(*levels).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    edge = by_range.withColumn("b", F.coalesce(F.sum("s").over(before), F.lit(0))).filter("b < rem AND b + s >= rem")
    edge = small_side(checkpointed(edge.select(*levels, F.col("__range").alias("__edge"), (F.col("rem") - F.col("b")).alias("__in"))))
    inside = rows.join(edge, list(levels)).filter("__range = __edge").groupBy(*levels, "__key", "__in").agg(F.sum("__t").alias("t"))
    run = Window.partitionBy(*levels).orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    cut = inside.withColumn("b", F.coalesce(F.sum("t").over(run), F.lit(0))).filter("b < __in AND b + t >= __in")
    cut = small_side(checkpointed(cut.select(*levels, F.col("__key").alias("__cut"), (F.col("__in") - F.col("b")).alias("__last"))))
    rows = rows.join(cut, list(levels), "left")
    partial = F.when(F.col("__key") < F.col("__cut"), F.col("__t")).when(
        F.col("__key") == F.col("__cut"), F.least("__t", "__last")
    )
    whole = F.when(F.col("__full") > 0, F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("__full") - 1), lambda e: F.struct(e.alias("epoch"), F.col("__t").alias("taken"))
    )).otherwise(F.array().cast("array<struct<epoch:bigint,taken:bigint>>"))
    last = F.when(partial.isNotNull(), F.array(F.struct(F.col("__full").alias("epoch"), partial.alias("taken")))).otherwise(
        F.array().cast("array<struct<epoch:bigint,taken:bigint>>")
    )
    out = rows.withColumn("__e", F.explode(F.concat(whole, last))).withColumns({"epoch": F.col("__e.epoch"), "taken": F.col("__e.taken")})
    return out.drop("__e", "__t", "__full", "__rem", "__key", "__range", "__cut", "__last")


def domain_of(source: Column) -> Column:
    """The sources' domain: three groups by the last character of the name."""
    return F.coalesce(F.concat(F.lit("domain"), F.ascii(F.right(source, F.lit(1))) % 3), F.lit(MISSING))


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source and the number of words, without the text."""
    return docs.select(
        "doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
    )


def _share_sql(name: str, nodes: str, parent: str, own: str) -> str:
    """CTEs that give the children in ``nodes`` (cap, w, budget) their ``alloc``, as table ``name``."""
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
  {name}1 AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap0,
      coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0, sum(w) OVER ({part}) AS w_all
    FROM {nodes} WINDOW o AS ({part} ORDER BY cap::DOUBLE / w, {own})),
  {name}2 AS (SELECT *, min((cap * (w_all - w0) <= (budget - cap0) * w)::INT) OVER ({part} ORDER BY cap::DOUBLE / w, {own}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS f FROM {name}1),
  {name}3 AS (SELECT *, coalesce(sum(w) FILTER (NOT f) OVER ({part}), 1) AS open_w,
      budget - coalesce(sum(cap) FILTER (f) OVER ({part}), 0) AS spare FROM {name}2),
  {name}4 AS (SELECT *, CASE WHEN f THEN cap ELSE (spare * w) // open_w END AS base FROM {name}3),
  {name} AS (SELECT *, base + (NOT f AND row_number() OVER ({part} ORDER BY f, {own})
      <= budget - sum(base) OVER ({part}))::INT AS alloc FROM {name}4)"""


def oracle_sql(budget_share: float = 1.0, max_epochs: int = 3, seed: int = SEED, source: str = "documents") -> str:
    """DuckDB SQL of the query over ``documents`` (or another relation of its columns)."""
    def case(level: str) -> str:
        return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"

    return f"""
WITH slim AS (SELECT doc_id, coalesce('domain' || (ascii(right(source, 1)) % 3), '{MISSING}') AS domain,
      coalesce(lang, '{MISSING}') AS lang, coalesce(source, '{MISSING}') AS source,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::HUGEINT AS n_tokens FROM {source}),
  leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {max_epochs} AS cap
    FROM slim WHERE n_tokens > 0 GROUP BY ALL),
  a0 AS (SELECT domain, sum(cap) AS cap, {case("domain")} AS w,
      least((SELECT sum(tokens) * {round(budget_share * 1000)} // 1000 FROM leaf), (SELECT sum(cap) FROM leaf)) AS budget FROM leaf GROUP BY domain),
  {_share_sql("a", "a0", "", "domain").strip()},
  b0 AS (SELECT domain, lang, sum(leaf.cap) AS cap, {case("lang")} AS w, any_value(a.alloc) AS budget FROM leaf JOIN a USING (domain) GROUP BY domain, lang),
  {_share_sql("b", "b0", "domain", "lang").strip()},
  c0 AS (SELECT domain, lang, leaf.source, leaf.cap, 1 AS w, b.alloc AS budget FROM leaf JOIN b USING (domain, lang)),
  {_share_sql("c", "c0", "domain, lang", "source").strip()},
  plan AS (SELECT domain, lang, source, alloc // tokens AS whole, alloc % tokens AS rem FROM c JOIN leaf USING (domain, lang, source)),
  keyed AS (SELECT slim.*, whole, rem, md5('{seed}:' || whole || ':' || doc_id) AS k FROM slim JOIN plan USING (domain, lang, source) WHERE n_tokens > 0),
  run AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, whole::BIGINT AS epoch, least(n_tokens, rem - b)::BIGINT AS taken FROM run WHERE b < rem
UNION ALL SELECT doc_id, domain, lang, source, n_tokens::BIGINT, e AS epoch, n_tokens::BIGINT AS taken
  FROM (SELECT *, unnest(range(0, whole::BIGINT)) AS e FROM keyed)"""


def op1_hierarchical_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = checkpointed(document_sizes(table(spark, sf_dir, "documents")))
    return mixture(slim).select("doc_id", *LEVELS, "n_tokens", "epoch", "taken")
