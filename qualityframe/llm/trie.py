"""Prefix trie of conversations: shared beginnings as nodes, subtree totals by depth-band rollup.

A turn's place in its conversation comes from a parallel sort, a prefix is known by the xor of
128-bit hashes of its turns and their places, summed up band by band, and a node is a distinct
prefix. For subtree totals nodes are exploded only to their ancestors within a band of fixed
height. The totals of band roots are a smaller trie of the same kind, rolled up first in the
same way; the completed totals then flow across the band edges into the bands above. Rounds
grow with the logarithm of the depth, the explosion is bounded by the height.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qualityframe.operators.ids import sequence_id

from .common import WORD, checkpointed, small_side, table
from .resampling import crc_sql

#: Levels of a band.
HEIGHT = 8
#: Rows up to which nodes with very many children may be broadcast; other nodes have few.
BUSY_NODES = 50_000
#: Ids of a chunk of the lists that are hashed.
CHUNK_IDS = 4096
#: The registered query: conversations of a block of 20 share its first one's opening turns.
BLOCK, OPENINGS = 20, 4


def numbered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, digest, words): the turns of each conversation numbered 1, 2, ... by ``turn`` (nulls first).

    Turns of equal number follow the md5 of role, a zero character and text; null roles and
    texts are empty; rows without a conversation are passed over. ``words`` counts the words of
    the text. The sort deals a long conversation over many tasks; texts are not moved.
    """
    told = F.concat(F.coalesce(F.col(role), F.lit("")), F.lit("\x00"), F.coalesce(F.col(text), F.lit("")))
    slim = rows.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.md5(told).alias("digest"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("words"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ids = sequence_id(slim, order, name="seq", keep=["conv_id", "digest", "words"])
    first = ids.groupBy("conv_id").agg(F.min("seq").alias("first"))
    return ids.join(first, "conv_id").select("conv_id", (F.col("seq") - F.col("first") + 1).alias("place"), "digest", "words")


def with_shared_openings(turns: DataFrame, block: int = BLOCK, openings: int = OPENINGS) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which conversations begin alike: c takes the first h turns of c - c % block for its own.

    h is the crc32 of c's decimal digits modulo ``openings``. A shorter (or absent) first
    conversation gives fewer turns; later turns move up. ``turns`` are numbered ones.
    """
    convs = checkpointed(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(openings)).cast("long")
    model = (F.col("conv_id") - F.col("conv_id") % block).alias("model")
    asks = convs.select("conv_id", model, h.alias("h"))
    heads = turns.filter((F.col("place") < openings) & (F.col("conv_id") % block == 0)).select(F.col("conv_id").alias("model"), "place", "digest", "words")
    given = asks.join(heads, "model").filter("place <= h").select("conv_id", "place", "digest", "words")
    sizes = convs.select(F.col("conv_id").alias("model"), F.col("n").alias("held"))
    missing = asks.join(sizes, "model", "left").select("conv_id", "h", (F.col("h") - F.least("h", F.coalesce("held", F.lit(0)))).alias("up"))
    own = turns.join(missing, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("up")).alias("place"), "digest", "words")
    return given.unionByName(own), convs.select("conv_id")


def _key(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _xors(rows: DataFrame, keys: Sequence[str], place: str, height: int) -> DataFrame:
    """``rows`` with ``a`` and ``b`` replaced by their running xor along ``place`` (0, 1, ...) within ``keys``.

    Windows hold ``height`` rows at most: bands are summed up, their sums run over in the same
    way, and each band starts from what came before it.
    """
    deepest, band = rows.agg(F.max(place)).first()[0], f"{place}_band"
    within = Window.partitionBy(*keys, band).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(band, F.expr(f"{place} div {height}"))
    running = out.withColumns({c: F.expr(f"bit_xor({c})").over(within) for c in ("a", "b")})
    if deepest is None or deepest < height:
        return running.drop(band)
    sums = checkpointed(out.groupBy(*keys, band).agg(F.expr("bit_xor(a)").alias("a"), F.expr("bit_xor(b)").alias("b")))
    before = _xors(sums, keys, band, height).select(*keys, (F.col(band) + 1).alias(band), F.col("a").alias("a0"), F.col("b").alias("b0"))
    joined = running.join(before, [*keys, band], "left")
    return joined.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"{c}0", F.lit(0).cast("long"))) for c in ("a", "b")}).drop(band, "a0", "b0")


def _prefixes(turns: DataFrame, convs: DataFrame, height: int) -> DataFrame:
    """(conv_id, depth, key, parent, words): every prefix of every conversation, the empty one included, stored.

    A key is the xor of the hashes of the prefix's turns; the parent's lacks the last of them.
    """
    hashes = {c: F.xxhash64(F.lit(k), "depth", "digest") for k, c in enumerate("ab")}
    zero = F.lit(0).cast("long")
    rows = turns.withColumnRenamed("place", "depth").withColumns(hashes).drop("digest").unionByName(
        convs.select("conv_id", *(zero.alias(c) for c in ("depth", "words", "a", "b")))
    )
    rows = checkpointed(rows.withColumns({"own_a": F.col("a"), "own_b": F.col("b")}))
    runs = _xors(rows, ["conv_id"], "depth", height)
    parent = F.when(F.col("depth") > 0, _key(F.expr("a ^ own_a"), F.expr("b ^ own_b")))
    return checkpointed(runs.select("conv_id", "depth", _key(F.col("a"), F.col("b")).alias("key"), parent.alias("parent"), "words"))


def _level(prefixes: DataFrame, step: int, height: int, *more: Column) -> DataFrame:
    """Nodes at depths that ``step`` divides: key, depth, conv_id and ``above``, the keys from the top of its band down to its own."""
    rows = prefixes.filter(F.col("depth") % step == 0)
    band = F.expr(f"depth div {step * height}")
    rows = rows.withColumn("above", F.collect_list("key").over(Window.partitionBy("conv_id", band).orderBy("depth")))
    # members agree in everything but their ids
    return checkpointed(rows.groupBy("key").agg(F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("above").alias("above"), *more))


def _rolled(nodes: DataFrame, values: Sequence[str], prefixes: DataFrame, deepest: int, step: int, height: int) -> DataFrame:
    """(key, values): sums of ``values`` over the subtrees of ``nodes``, a ``_level`` of ``step``."""
    sums = [F.sum(v).alias(v) for v in values]
    if deepest >= step * height:
        # each band's sum belongs to its root; the roots are a level of their own
        bands = nodes.groupBy(F.get("above", F.lit(0)).alias("key")).agg(*sums)
        roots = checkpointed(_level(prefixes, step * height, height).join(bands, "key"))
        done = _rolled(roots, values, prefixes, deepest, step * height, height)
        # the completed totals flow across the edge into the last node of the band above
        edge = roots.filter("depth > 0").select("key", "conv_id", (F.col("depth") - step).alias("depth"))
        into = edge.join(prefixes.select("conv_id", "depth", F.col("key").alias("to")), ["conv_id", "depth"]).select("key", "to")
        flow = done.join(into, "key").groupBy(F.col("to").alias("key")).agg(*(F.sum(v).alias(f"{v}_in") for v in values))
        nodes = nodes.join(flow, "key", "left").withColumns({v: F.col(v) + F.coalesce(f"{v}_in", F.lit(0)) for v in values})
    spread = nodes.select(F.explode("above").alias("key"), *values)
    return checkpointed(spread.groupBy("key").agg(*sums))


def _parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their parents' conv_id. A parent with more than a BUSY_NODES-th of all nodes as children is broadcast."""
    limit = nodes.count() // BUSY_NODES
    known = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    busy = known.filter(F.col("n_children") > limit).drop("n_children").withColumnRenamed("parent_conv_id", "busy_conv_id")
    rest = known.filter(F.col("n_children") <= limit).drop("n_children")
    out = nodes.join(small_side(checkpointed(busy), BUSY_NODES + 1), "parent", "left")
    shuffled = out.filter("busy_conv_id IS NULL").join(rest, "parent", "left")
    return shuffled.drop("busy_conv_id").unionByName(out.filter("busy_conv_id IS NOT NULL").withColumnRenamed("busy_conv_id", "parent_conv_id"))


def _list_hashes(members: DataFrame) -> DataFrame:
    """(key, ends_sha256): hash of the comma-joined ids of each key, in order; ``members`` has key and conv_id.

    Sorted ranges are joined to chunks of ids; a key's chunks, in order, are hashed in a stream, so that
    a list of any length takes the memory of one chunk.
    """
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last = [], None
            for a, b, conv in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (a, b) != last or len(out[-1][3]) >= CHUNK_IDS:
                    out.append((a, b, conv, []))
                    last = (a, b)
                out[-1][3].append(str(conv))
            a, b, first, ids = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.int64()), pa.array(map(",".join, ids), pa.string())], ["a", "b", "first", "ids"],
            )

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None

        def told(done: list[tuple]) -> pa.RecordBatch:
            a, b, digest = zip(*done) if done else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest, pa.string())], ["a", "b", "ends_sha256"])

        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if (a, b) == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    done.append((*last, state.hexdigest()))
                last, state = (a, b), hashlib.sha256(ids.encode())
            yield told(done)
        if last is not None:
            yield told([(*last, state.hexdigest())])

    flat = members.select("key.a", "key.b", "conv_id")
    flat = flat.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    parts = flat.mapInArrow(chunks, "a long, b long, first long, ids string")
    parts = parts.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return parts.mapInArrow(hashes, "a long, b long, ends_sha256 string").select(_key(F.col("a"), F.col("b")).alias("key"), "ends_sha256")


def prefix_trie(turns: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, distinct) over ``turns`` (conv_id, place, digest, words).

    Columns: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs
    (members), n_children, n_leaves and saved_tokens (sums over the subtree of childless nodes and of
    (n_convs - 1) times the words of a node's last turn), ends_sha256 (sha256 of the
    comma-joined ids that end here). Conversations without turns end at the root; an
    empty table has no nodes. Two prefixes are one node if the xors of their turns' 128-bit hashes are.
    """
    prefixes = _prefixes(turns, convs, height)
    deepest = prefixes.agg(F.max("depth")).first()[0]
    members = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("end")).select(F.col("end.key").alias("key"), "conv_id")
    nodes = _level(prefixes, 1, height, F.first("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = checkpointed(nodes.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
    }))
    sums = _rolled(nodes, ("n_leaves", "saved_tokens"), prefixes, deepest or 0, 1, height)
    out = _parents(nodes.drop("n_leaves", "saved_tokens", "above")).join(sums, "key").join(_list_hashes(members), "key", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_banded_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns, convs = with_shared_openings(numbered_turns(rows))
    return prefix_trie(turns, convs)


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``conversations``."""
    return f"""
WITH RECURSIVE own AS (SELECT conv_id, md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS digest,
      len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
  ids AS (SELECT conv_id, conv_id::VARCHAR AS told, count(*) AS n FROM own GROUP BY conv_id),
  {crc_sql("ids", "told")},
  convs AS (SELECT i.conv_id, i.conv_id - i.conv_id % {BLOCK} AS model, crc % {OPENINGS} AS h FROM ids i JOIN crcs ON crcs.s = told),
  turns AS (SELECT c.conv_id, o.place, o.digest, o.words FROM convs c JOIN own o ON o.conv_id = c.model AND o.place <= c.h
    UNION ALL SELECT c.conv_id, o.place - c.h + least(c.h, coalesce(m.n, 0)), o.digest, o.words
      FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.h LEFT JOIN ids m ON m.conv_id = c.model),
  runs AS (SELECT conv_id, place AS depth, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY place) AS key FROM turns
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
  nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM runs GROUP BY key, depth),
  kids AS (SELECT left(key, 32 * (depth - 1)::INT) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
  valued AS (SELECT n.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * words AS saved FROM nodes n LEFT JOIN kids k USING (key)),
  spread AS (SELECT left(key, 32 * unnest(range(0, depth + 1))::INT) AS key, (n_children = 0)::INT AS leaf, saved FROM valued),
  sums AS (SELECT key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM spread GROUP BY key),
  ended AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM
      (SELECT conv_id, key FROM runs QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY key)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM valued v JOIN sums USING (key) LEFT JOIN ended USING (key) LEFT JOIN nodes p ON v.depth > 0 AND p.key = left(v.key, 32 * (v.depth - 1)::INT)"""
