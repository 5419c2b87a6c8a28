"""Line dedup: lines that many documents share go, found by probing a sharded minimal perfect hash.

Distinct line hashes of every document are counted by Spark. The lines of enough documents are
dealt to shards of bounded size; each shard's task builds a minimal perfect hash over its
line hashes (bit levels: a key sits at the first level where it has a bit of its own, its
slot is the number of bits before) with an array of fingerprints and one of counts.
Documents probe these arrays, batch by batch; the lines themselves are never joined.

While all arrays together stay within a bound of bytes, every task gets them by broadcast.
Beyond it, the documents' line hashes travel to the shards instead, and the numbers of the
lines to drop travel back; the rows are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import fresh, table, written

BLANKS = b" \t\n\x0b\x0c\r"
MIN_DOCS = 10
MIN_CHARS = 1
#: Line hashes of a shard, on average; bytes of all arrays up to which they are broadcast.
SHARD_KEYS = 1 << 17
INDEX_BYTES = 64_000_000
#: Bits of a level for each key that is still without a place.
SPREAD = 2
#: Line hashes that one copy of a shard answers, about, when hashes travel.
PROBES = 1 << 22
ADDED = ("n_lines", "n_dropped", "kept")


def line_hashes(lines: list[bytes], min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the lines' keys, as rows of two numbers, and which lines have a key of ``min_chars`` code points."""
    keys = [x.strip(BLANKS).lower() for x in lines]
    if min_chars <= 1:
        long_enough = np.fromiter(map(bool, keys), bool, len(keys)) | (min_chars < 1)
    else:
        long_enough = np.fromiter((len(k.decode("utf-8", "replace")) >= min_chars for k in keys), bool, len(keys))
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">i8").reshape(-1, 2).astype(np.int64), long_enough


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    x = h[:, 0].astype(np.uint64) + h[:, 1].astype(np.uint64) * np.uint64(2 * level + 1)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class LineIndex:
    """Minimal perfect hash of one shard: ``levels`` (bits of each), ``words`` (the bits), fingerprints and counts by slot."""

    def __init__(self, levels: np.ndarray, words: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.levels, self.words, self.prints, self.counts = levels, words, prints, counts
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.uint32)

    @classmethod
    def build(cls, h: np.ndarray, counts: np.ndarray) -> LineIndex:
        """From distinct hashes ``h`` and their counts; distinct keys part at some level, as each level mixes both numbers anew."""
        levels, bits, slot_of, base, left = [], [], np.zeros(len(h), np.int64), 0, np.arange(len(h))
        while len(left):
            size = -(-SPREAD * len(left) // 64) * 64
            at = (_mixed(h[left], len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            slot_of[left] = base + at
            bits.append(alone)
            levels.append(size)
            base, left = base + size, left[~alone[at]]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        slot = (np.cumsum(flat) - 1)[slot_of] if len(h) else slot_of
        prints, held = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        prints[slot], held[slot] = h[:, 1], counts
        narrow = np.min_scalar_type(int(held.max())) if len(held) else np.uint8
        return cls(np.array(levels, np.int64), np.packbits(flat, bitorder="little").view("<u8"), prints, held.astype(narrow))

    def count(self, h: np.ndarray) -> np.ndarray:
        """Counts of the hashes, 0 for those that are not in the shard (a fingerprint of 64 bits tells)."""
        out, base, left = np.zeros(len(h), np.int64), 0, np.arange(len(h))
        for level, size in enumerate(self.levels.tolist()):
            if not len(left):
                break
            at = base + (_mixed(h[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            under = word & ((np.uint64(1) << bit) - np.uint64(1))
            slot = (self.before[at >> 6] + np.bitwise_count(under))[found].astype(np.int64)
            hit = left[found]
            same = self.prints[slot] == h[hit, 1]
            out[hit[same]] = self.counts[slot[same]]
            base, left = base + size, left[~found]
        return out

    def pack(self) -> dict[str, bytes | int]:
        arrays = {c: getattr(self, c).tobytes() for c in ("levels", "words", "prints", "counts")}
        return {**arrays, "width": self.counts.itemsize}

    @classmethod
    def unpack(cls, levels: bytes, words: bytes, prints: bytes, counts: bytes, width: int) -> LineIndex:
        return cls(np.frombuffer(levels, "<i8"), np.frombuffer(words, "<u8"), np.frombuffer(prints, "<i8"), np.frombuffer(counts, f"<u{width}"))


PACKED = "shard long, load long, levels binary, words binary, prints binary, counts binary, width int"
ARRAYS = ("levels", "words", "prints", "counts", "width")


def frequent_lines(
    df: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, told: Observation | None = None
) -> DataFrame:
    """(a, b, n): 128-bit hash of every line key that ``min_docs`` rows of ``df`` or more hold, and how many do.

    ``told`` learns ``lines``, the number of distinct keys summed over the rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.zeros((0, 2), np.int64)]
            for value in batch.column(0).cast(pa.large_binary()):
                h, fit = line_hashes((value.as_py() or b"").split(b"\n"), min_chars)
                got.append(np.unique(h[fit], axis=0) if fit.sum() > 1 else h[fit])
            h = np.concatenate(got)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1])], ["a", "b"])

    keys = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "a long, b long")
    if told is not None:
        keys = keys.observe(told, F.count(F.lit(1)).alias("lines"))
    return keys.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)


def line_index(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """A row of arrays and the load (sum of counts) for every shard of stored ``frequent_lines``, stored, and the number of shards."""
    shards = max(1, -(-lines.count() // shard_keys))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        h, n = np.stack([rows.column("a").to_numpy(), rows.column("b").to_numpy()], axis=1), rows.column("n").to_numpy()
        row = {"shard": key[0].as_py(), "load": int(n.sum()), **LineIndex.build(h, n).pack()}
        return pa.Table.from_pylist([row], pa.schema([
            ("shard", pa.int64()), ("load", pa.int64()), *((c, pa.binary()) for c in ARRAYS[:-1]), ("width", pa.int32()),
        ]))

    dealt = lines.withColumn("shard", F.pmod("a", F.lit(shards)).cast("long"))
    return written(dealt.groupBy("shard").applyInArrow(build, PACKED), "line-index"), shards


def _kept(schema: StructType, text: str) -> list[StructField]:
    return [f for f in schema.fields if f.name.lower() not in ADDED and f.name != text]


def _result(kept: list[StructField]) -> StructType:
    return StructType([*kept, StructField("n_lines", LongType(), False), StructField("n_dropped", LongType(), False), StructField("kept", StringType(), False)])


def _cut(part: pa.RecordBatch, names: list[str], schema: StructType, rows: list[tuple[list[bytes], np.ndarray]]) -> pa.RecordBatch:
    """The columns ``names`` of a batch and, from its texts' lines and the lines to drop, what is left."""
    left = [b"\n".join(x for x, gone in zip(lines, drop.tolist()) if not gone).decode() for lines, drop in rows]
    made = [pa.array([len(x) for x, _ in rows], pa.int64()), pa.array([int(d.sum()) for _, d in rows], pa.int64()), pa.array(left, pa.string())]
    return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], schema.names)


def _probe_here(df: DataFrame, text: str, index: DataFrame, shards: int, min_docs: int, min_chars: int) -> DataFrame:
    """Documents probe broadcast arrays, whose size the caller has checked."""
    packed = {r["shard"]: {c: r[c] if c == "width" else bytes(r[c]) for c in ARRAYS} for r in index.select("shard", *ARRAYS).collect()}
    shared = df.sparkSession.sparkContext.broadcast(packed)
    kept = _kept(df.schema, text)
    names, schema = [f.name for f in kept], _result(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = {k: LineIndex.unpack(**v) for k, v in shared.value.items()}
        for batch in batches:
            rows = []
            for value in batch.column(text).cast(pa.large_binary()):
                lines = (value.as_py() or b"").split(b"\n")
                h, fit = line_hashes(lines, min_chars)
                shard, n = h[:, 0] % shards, np.zeros(len(h), np.int64)
                for k in np.unique(shard).tolist():
                    if k in arrays:
                        at = np.flatnonzero(shard == k)
                        n[at] = arrays[k].count(h[at])
                rows.append((lines, fit & (n >= min_docs)))
            yield _cut(batch, names, schema, rows)

    return df.mapInArrow(run, schema)


def _probe_there(df: DataFrame, text: str, index: DataFrame, shards: int, total: int, min_docs: int, min_chars: int) -> DataFrame:
    """Line hashes travel to the shards' arrays; numbers of lines to drop travel back to their texts, known by a digest.

    A shard has as many copies as its load needs (``PROBES`` hashes each, about), and hashes are
    dealt over them in turn, so that a line of a third of all documents does not meet in
    one task. Any copy gives the same answer. A task reads a copy's arrays, then its hashes, in a stream.
    """
    copies = np.ones(shards, np.int64)
    for r in index.select("shard", "load").collect():  # two numbers for every shard
        copies[r["shard"]] = max(1, -(-(r["load"] + total // shards) // PROBES))
    mark, of, gone = fresh(df, "mark"), fresh(df, "mark_of"), fresh(df, "gone")
    text_column = F.col(text).cast("string")
    marked = df.withColumn(mark, F.md5(F.coalesce(text_column, F.lit(""))))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                h, fit = line_hashes((value.as_py() or b"").split(b"\n"), min_chars)
                at = np.flatnonzero(fit)
                shard = h[at, 0] % shards
                copy = (np.arange(len(at)) + turn) % copies[shard]
                turn += len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (shard, copy, np.full(len(at), name.as_py()), at, h[at, 0], h[at, 1])], ["shard", "copy", "mark", "line", "a", "b"],
                )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, here = None, None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            is_index = batch.column("levels").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.unique([0, len(shard), *(np.flatnonzero(np.diff(shard)) + 1), *np.flatnonzero(is_index), *(np.flatnonzero(is_index) + 1)])
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(start, end - start)
                if is_index[start]:
                    arrays, here = LineIndex.unpack(**{c: part.column(c)[0].as_py() for c in ARRAYS}), shard[start]
                elif here == shard[start]:
                    h = np.stack([part.column("a").to_numpy(), part.column("b").to_numpy()], axis=1)
                    hit = pa.array(arrays.count(h) >= min_docs)
                    yield pa.RecordBatch.from_arrays([part.column(c).filter(hit) for c in ("mark", "line")], ["mark", "line"])

    asked = marked.select(F.col(mark).alias("mark"), text_column.alias("text"))
    asked = asked.mapInArrow(hashes, "shard long, copy long, mark string, line long, a long, b long")
    arrays = index.withColumn("copies", F.greatest(F.lit(1), F.ceil((F.col("load") + F.lit(total // shards)) / F.lit(PROBES))).cast("long"))
    arrays = arrays.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies", "load")
    both = asked.unionByName(arrays, allowMissingColumns=True)
    both = both.repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("levels").isNull())
    drops = both.mapInArrow(probe, "mark string, line long").distinct()
    drops = drops.groupBy(F.col("mark").alias(of)).agg(F.collect_list("line").alias(gone))
    out = marked.join(drops, F.col(mark) == F.col(of), "left").drop(mark, of)
    kept = _kept(df.schema, text)
    names, schema = [f.name for f in kept], _result(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, at in zip(batch.column(text).cast(pa.large_binary()), batch.column(gone)):
                lines = (value.as_py() or b"").split(b"\n")
                drop = np.zeros(len(lines), bool)
                drop[at.as_py() or []] = True
                rows.append((lines, drop))
            yield _cut(batch, names, schema, rows)

    return out.mapInArrow(cut, schema)


def drop_common_lines(
    df: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
    index_bytes: int = INDEX_BYTES, shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """The rows of ``df`` with ``n_lines``, ``n_dropped`` and ``kept`` (the text without its common lines) in place of ``text``.

    Lines are the parts of a text between line feeds; a line's key is the line without ASCII
    white space at its ends, A-Z in lower case. Keys of at least ``min_chars`` code points that
    at least ``min_docs`` rows hold lose all their lines. Every row counts as a document, also
    rows that repeat or share an id. Null and empty texts are one empty line, which stays. An
    empty table gives an empty one. Very long texts are handled whole, row by row; columns of
    ``df`` with the names of added ones are replaced, other columns stay.
    ``index_bytes`` bounds what is broadcast; it changes the plan, not the rows.
    """
    told = Observation()
    lines = written(frequent_lines(df, text, min_docs, min_chars, told), "frequent-lines")
    index, shards = line_index(lines, shard_keys)
    size = index.agg(F.sum(sum((F.octet_length(c) for c in ARRAYS[:-1]), F.lit(0).cast("long")))).first()[0]
    if size is None or size <= index_bytes:  # none: no line is common
        return _probe_here(df, text, index, shards, min_docs, min_chars)
    return _probe_there(df, text, index, shards, told.get["lines"], min_docs, min_chars)


def op13_perfect_hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``documents``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  lines AS (SELECT k, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM docs),
  keyed AS (SELECT k, line, i, translate(trim(line, {blanks}), '{upper}', '{lower}') AS key FROM lines),
  common AS (SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT k) >= {MIN_DOCS}),
  marked AS (SELECT k, line, i, key IN (SELECT key FROM common) AS gone FROM keyed),
  kept AS (SELECT k, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY k)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept JOIN docs USING (k)"""
