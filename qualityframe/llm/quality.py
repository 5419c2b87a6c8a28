"""Quality rules with host verdicts, in DataFrame functions only.

Base rules judge each document. Their failures are summed by host (one partial
aggregation, so a hot host is pre-summed in every task); an empirical beta prior fitted
over all hosts shrinks each host's failure rate; the verdict is joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, small_side, table, words

WORD_CLASS = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: A host goes when its shrunk failure rate reaches this share.
HOST_REJECT_RATE = 0.5
#: Bounds of the prior's weight in documents.
PRIOR_MIN, PRIOR_MAX = 2.0, 10_000.0

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _repeated_starts(positions: Column) -> Column:
    """Starts of the windows that occur twice or more, from (hash, start) pairs in order."""
    twice = F.filter(
        positions,
        lambda p, i: (F.get(positions, i - 1)["h"] == p["h"]) | (F.get(positions, i + 1)["h"] == p["h"]),
    )
    return F.array_sort(F.transform(twice, lambda p: p["i"]))


def with_base_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of BASE (an existing column of such a name is replaced).

    Null or empty text: no words, all counts 0, ``base_failed`` true (fewer than 20 words).
    Two windows are equal if the 64-bit hashes of their eight word hashes are equal.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(WORD_CLASS))
    out = df.withColumns({"__words": words(F.col(text)), "__lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(raw, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__h": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    ).drop("__words", "__lines")
    n = F.size("__h")
    out = out.withColumn(
        "__win",
        F.when(
            n > WINDOW,
            F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__h", i, WINDOW))),
        ),
    ).drop("__h")
    # only texts with an equal pair of windows are sorted
    out = out.withColumn(
        "__at",
        F.when(
            F.size(F.array_distinct("__win")) < F.size("__win"),
            F.array_sort(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("__win")
    out = out.withColumn("__rep", _repeated_starts(F.col("__at"))).drop("__at")
    gap = F.transform(
        "__rep", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__rep", i + 1) - p, F.lit(WINDOW)))
    )
    out = out.withColumn(
        "n_repeat_words",
        F.coalesce(F.aggregate(gap, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
    ).drop("__rep")
    return out.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PCT) * F.col("n_words")),
    )



def host_verdicts(base: DataFrame, host: str = "source", reject_rate: float = HOST_REJECT_RATE) -> DataFrame:
    """One row per host (null is a host): documents, failures, shrunk rate, verdict.

    The beta prior comes from the method of moments over the hosts' rates: mean m and
    weight w = m (1 - m) / v - 1, held within PRIOR_MIN and PRIOR_MAX (no spread, or one
    host: PRIOR_MAX). Shrunk rate = (failures + w m) / (documents + w).
    """
    hosts = checkpointed(
        base.groupBy(F.col(host).alias("host")).agg(
            F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures")
        )
    )
    rate = F.col("host_failures") / F.col("host_docs")
    got = hosts.agg(
        (F.sum("host_failures") / F.sum("host_docs")).alias("m"), F.var_pop(rate).alias("v")
    ).first()  # two numbers
    m, v = float(got["m"] or 0.0), float(got["v"] or 0.0)
    weight = min(max(m * (1 - m) / v - 1 if v > 1e-9 else PRIOR_MAX, PRIOR_MIN), PRIOR_MAX)
    shrunk = (F.col("host_failures") + F.lit(weight * m)) / (F.col("host_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") >= reject_rate)


def quality_rules(
    df: DataFrame, text: str = "text", host: str = "source", reject_rate: float = HOST_REJECT_RATE
) -> DataFrame:
    """Base columns, ``host_rejected`` and ``kept`` for every row of ``df``, without its text.

    ``kept`` is false for a base failure and for every document of a rejected host. Rows,
    repeated rows and other columns stay; a null host is a host of its own. The base columns
    are checkpointed: texts are read once, and later filters cannot be pushed into the rules.
    An empty table gives an empty one, very long texts are judged whole. Columns of ``df`` with the
    names of results or of helpers (``__words``, ``__lines``, ``__h``, ``__win``, ``__at``, ``__rep``, ``__host``, ``__bad``) are replaced or dropped.
    """
    base = checkpointed(with_base_rules(df, text).drop(text))
    verdict = host_verdicts(base, host, reject_rate)
    bad = small_side(checkpointed(verdict.filter("host_rejected").select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))))
    out = base.drop("host_rejected", "kept").join(bad, F.col(host).eqNullSafe(F.col("__host")), "left")
    out = out.withColumn("host_rejected", F.coalesce("__bad", F.lit(False))).drop("__host", "__bad")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def oracle_sql(reject_rate: float = HOST_REJECT_RATE) -> str:
    """DuckDB SQL of the query over ``documents``."""
    return f"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text,
      regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
    FROM documents),
  win AS (SELECT doc_id, i, list_aggregate(ws[i:i + {WINDOW - 1}], 'string_agg', ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
  rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
  cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS n FROM
      (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
  base AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
  judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM base),
  hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM judged GROUP BY source),
  mom AS (SELECT sum(k) / sum(n) AS m, var_pop(k / n) AS v FROM hosts),
  prior AS (SELECT m, CASE WHEN v > 1e-9 THEN least(greatest(m * (1 - m) / v - 1, {PRIOR_MIN}), {PRIOR_MAX}) ELSE {PRIOR_MAX} END AS w FROM mom),
  verdict AS (SELECT source, (k + w * m) / (n + w) >= {reject_rate} AS bad FROM hosts, prior)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM judged j JOIN verdict v ON j.source IS NOT DISTINCT FROM v.source"""


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules(docs).select("doc_id", *BASE, "kept")
