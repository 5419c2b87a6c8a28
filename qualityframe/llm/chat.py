"""Chat formatting by event sourcing, in DataFrame functions only.

A log of events is partitioned by conversation, sorted by sequence and folded into final
messages; the messages are rendered with turn marks, reversible escaping and a loss mask.

Event kinds, by sequence within a conversation:
  ``message``     sets role and text of a turn anew (earlier events of that turn go),
  ``delta``       appends its text to the turn (streamed output),
  ``edit``        replaces the text of the turn, later turns stay,
  ``regenerate``  empties the turn; what was said before it in later turns goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Control strings of the template (fixed values).
OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Double every backslash, then put one behind the first character of each control string.

    Every backslash of the result starts an escape, so ``unescape`` is exact, and no control
    string is left in the result.
    """
    return F.regexp_replace(
        F.regexp_replace(text, r"\\", r"\\\\"), r"([<\[])(?=/?s>|/?INST\]|</?SYS>>)", r"$1\\"
    )


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(
    events: DataFrame, conv: str = "conv_id", seq: str = "seq", turn: str = "turn",
    kind: str = "kind", role: str = "role", text: str = "text",
) -> DataFrame:
    """Final messages (conv_id, turn, role, text), one row per conversation and surviving turn.

    Null conversations and null turns are groups of their own; null text is empty, null
    kind a delta, null sequence the earliest. The role is that of the latest event of the
    turn that names one (else null). Events of equal sequence come in order of kind, role
    and text; repeated rows are repeated events. A turn whose events are all gone is gone.
    First grouped by conversation and turn, so that one long conversation is spread.
    """
    event = F.struct(
        F.coalesce(F.col(seq), F.lit(-(2**63))).alias("seq"), F.coalesce(F.col(kind), F.lit("delta")).alias("kind"),
        F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    turns = events.groupBy(F.col(conv).alias("conv_id"), F.col(turn).alias("turn")).agg(
        F.sort_array(F.collect_list(event)).alias("ev"),
        F.max(F.when(F.col(kind) == "regenerate", F.col(seq))).alias("again"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("cut", F.max("again").over(before)).withColumn(
        "ev", F.filter("ev", lambda e: F.col("cut").isNull() | (e["seq"] > F.col("cut")))
    )
    resets = F.filter(
        F.transform("ev", lambda e, i: F.when(e["kind"] != "delta", i)), lambda i: i.isNotNull()
    )
    turns = turns.filter(F.size("ev") > 0).withColumn("from", F.coalesce(F.array_max(resets), F.lit(0)))
    kept = F.filter("ev", lambda e, i: (i >= F.col("from")))
    said = F.transform(kept, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"]))
    roles = F.filter(F.transform("ev", lambda e: e["role"]), lambda r: r.isNotNull())
    return turns.select(
        "conv_id", "turn", F.get(roles, F.size(roles) - 1).alias("role"), F.array_join(said, "").alias("text")
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` text, ``loss_spans`` and turns in order.

    ``loss_spans``: (start, length) in bytes of the UTF-8 form of ``formatted``, one per
    assistant turn, over its escaped text only. Running lengths come from a window, so a long
    conversation costs time in proportion to its length. A null role renders as an empty one.
    """
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(ROLE_END))
    parts = messages.withColumns({"head": head, "body": escape("text")})
    piece = F.concat("head", "body", F.lit(CLOSE + "\n"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum(F.octet_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("piece", piece).withColumn("end", end)
    start = F.col("end") - F.octet_length("piece") + F.octet_length("head")
    span = F.when(
        F.col("role") == LOSS_ROLE, F.struct(start.alias("start"), F.octet_length("body").cast("long").alias("length"))
    )
    rows = F.sort_array(F.collect_list(F.struct(F.col("end"), F.col("piece"), span.alias("span"))))
    out = parts.groupBy("conv_id").agg(rows.alias("rows"))
    spans = F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull())
    return out.select(
        "conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"), spans.alias("loss_spans")
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Read ``formatted`` back: ``turns`` (array of role, text) and ``loss_text``, unescaped."""
    pieces = F.filter(F.split("formatted", CLOSE + "\n"), lambda p: p != "")
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 2**31 - 1), ROLE_END, 1)).alias("role"),
        unescape(F.substring_index(p, ROLE_END, -1)).alias("text"),
    )
    out = formatted.withColumn("__bytes", F.col("formatted").cast("binary"))
    under = F.transform(
        "loss_spans",
        lambda s: F.substring(F.col("__bytes"), (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"),
    )
    return out.withColumns(
        {"turns": F.transform(pieces, turn), "loss_text": unescape(F.array_join(under, ""))}
    ).drop("__bytes")


def format_chats(events: DataFrame, **columns: str) -> DataFrame:
    """Fold an event log and render it: conv_id, formatted, loss_spans."""
    return render(fold_events(events, **columns))


def conversation_events(rows: DataFrame) -> DataFrame:
    """An event log for finished conversations, with all kinds of events; its fold gives each row's text back.

    Every row is a turn of its own, numbered within its conversation by turn (nulls last), role
    and text, so that null and repeated turns lose nothing. A turn is opened and drafted, and
    the draft answered in the next turn; a regeneration takes both back, a second draft is
    edited to the first half of the text, and the other half is streamed.
    """
    text, role = F.coalesce("text", F.lit("")), F.col("role")
    half = F.floor(F.length(text) / 2).cast("int")
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    nothing, draft = F.lit(None).cast("string"), F.lit("draft")
    steps = [
        (0, "message", role, F.lit("")), (0, "delta", nothing, draft), (1, "message", role, draft), (0, "regenerate", nothing, nothing),
        (0, "delta", nothing, draft), (0, "edit", nothing, first), (0, "delta", nothing, second),
    ]
    log = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(later).alias("later"), F.lit(kind).alias("kind"), r.alias("r"), t.alias("t"))
        for k, (later, kind, r, t) in enumerate(steps)
    ])
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), text)
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("n"))
    return numbered.select("conv_id", "n", F.explode(log).alias("e")).select(
        "conv_id", (F.col("n") + F.col("e.later")).alias("turn"), F.col("e.r").alias("role"),
        (F.col("n") * len(steps) + F.col("e.k")).alias("seq"), "e.kind", F.col("e.t").alias("text"),
    )


def op8_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    read = parse(format_chats(conversation_events(rows.unionByName(probe))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _esc(expr: str) -> str:
    bs = "chr(92)"
    out = f"replace({expr}, {bs}, {bs} || {bs})"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || {bs} || '{c[1:]}')"
    return out


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``conversations``."""
    body, marks = _esc("text"), len(OPEN) + len(ROLE_END) + len(CLOSE) + 1
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  sum({marks} + length({_esc("role")}) + length({body}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
