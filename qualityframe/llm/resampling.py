"""Resampling of a corpus towards a target by hashed n-gram importance weights.

A batch's texts are joined with a separator byte between them; one regex pass over the joined
bytes finds all words; the words' positions are searched in the documents' offsets, which
masks the n-grams that would cross from one document into the next; what is left is counted
per bucket by ``bincount``. Two such passes read the corpus: one counts buckets, one sums the
buckets' gains by document. Words are taken in blocks, the last words of a block again in the
next one, so memory does not grow with the length of a text.

N-gram hashes are put together from their words' checksums: a crc is linear, so the checksum
of "a b" is that of "a", moved on by the length of " b", xor that of " b".
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from qualityframe.operators.ids import sequence_id

from .common import checkpointed, table

#: Words in lower-cased UTF-8 bytes: digits, a to z and everything that is not ASCII.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Stands between the texts of a batch; no word holds it.
SENTINEL = b"\x00"
BUCKETS = 10_000
MAX_N = 3
MIN_WORDS = 20
DRAW_PERCENT = 5
SEED = 42
#: Bytes of text that are joined (a longer text is joined with none), and words that are hashed at once.
GROUP_BYTES = 4_000_000
BLOCK_WORDS = 1 << 17

ONES = np.uint32(0xFFFFFFFF)
#: Lengths below it have a table of their own, further bytes are moved over by powers of two.
DIRECT = 64


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step table of the crc; tables that move a state over 0 .. DIRECT - 1 bytes, and over DIRECT, 2 DIRECT, ... bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1).astype(np.uint32)
    direct = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    while len(direct) <= DIRECT:
        direct.append(step[direct[-1] & 255] ^ (direct[-1] >> np.uint32(8)))
    powers = [direct.pop()]
    while len(powers) < 32:
        powers.append(_move(powers[-1], powers[-1]))
    return step, np.stack(direct), np.stack(powers)


def _move(by: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state after the zero bytes that the table ``by`` stands for."""
    return by[0][state & 255] ^ by[1][(state >> 8) & 255] ^ by[2][(state >> 16) & 255] ^ by[3][state >> 24]


def _move_each(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each state after as many zero bytes as ``n`` says."""
    _, direct, powers = _tables()
    row = n % DIRECT
    out = direct[row, 0, state & 255] ^ direct[row, 1, (state >> 8) & 255]
    out ^= direct[row, 2, (state >> 16) & 255] ^ direct[row, 3, state >> 24]
    left, k = n // DIRECT, 0
    while left.any():
        at = np.flatnonzero(left & 1)
        out[at] = _move(powers[k], out[at])
        left, k = left >> 1, k + 1
    return out


def _word_states(joined: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Crc states of the words, from state 0."""
    step = _tables()[0]
    codes = np.frombuffer(joined, np.uint8)
    state = np.zeros(len(start), np.uint32)
    for k in np.flatnonzero(size >= DIRECT).tolist():
        state[k] = np.uint32(zlib.crc32(joined[start[k]: start[k] + size[k]], 0xFFFFFFFF)) ^ ONES
    at, k = np.flatnonzero(size < DIRECT), 0
    while len(at):
        s = state[at]
        state[at] = step[(s ^ codes[start[at] + k]) & 255] ^ (s >> np.uint32(8))
        k += 1
        at = at[size[at] > k]
    return state


def ngram_buckets(texts: Sequence[bytes], max_n: int = MAX_N, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Block by block over the joined texts: documents of its words, documents of its n-grams, buckets of its n-grams.

    Documents are positions in ``texts``; an n-gram belongs to the block of its last word.
    """
    joined = SENTINEL.join(texts).lower()
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    found = WORD_BYTES.finditer(joined)
    spans, carried = np.zeros((0, 2), np.int64), 0
    while True:
        new = np.fromiter(chain.from_iterable(m.span() for m in islice(found, BLOCK_WORDS)), np.int64).reshape(-1, 2)
        if not len(new):
            return
        spans = np.concatenate([spans, new])
        start, size = spans[:, 0], spans[:, 1] - spans[:, 0]
        doc = np.searchsorted(first, start, side="right") - 1
        own = _word_states(joined, start, size)
        state = own ^ _move_each(np.full(len(own), ONES), size)
        spaced = own ^ _move_each(np.full(len(own), _tables()[0][32]), size)
        docs, grams = [doc[carried:]], [state[carried:]]
        for n in range(2, max_n + 1):
            state = _move_each(state[:-1], size[n - 1:] + 1) ^ spaced[n - 1:]
            inside = doc[n - 1:] == doc[: len(doc) - n + 1]
            inside[: max(carried - n + 1, 0)] = False
            docs.append(doc[n - 1:][inside])
            grams.append(state[inside])
        yield doc[carried:], np.concatenate(docs), (np.concatenate(grams) ^ ONES) % np.uint32(buckets)
        carried = min(max_n - 1, len(spans))
        spans = spans[len(spans) - carried:]


def _groups(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of an Arrow column (null: empty) in groups of bounded size."""
    group, size = [], 0
    for text in column.cast(pa.large_binary()):
        value = text.as_py() or b""
        if group and size + len(value) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(value)
        size += len(value) + 1
    if group:
        yield group


def bucket_counts(df: DataFrame, text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): n-grams of all texts by bucket. A task adds up its own rows first: ``buckets`` rows a task at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in _groups(batch.column(0)):
                for _, _, grams in ngram_buckets(texts, max_n, buckets):
                    held += np.bincount(grams, minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["bucket", "n"])

    counts = df.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of every bucket, both smoothed by one, from two ``bucket_counts``.

    What reaches the driver are ``buckets`` rows, however large the corpora are.
    """
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(
        target.select("bucket", F.lit(0).cast("long"), F.col("n"))
    )
    got = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow()
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    at = got.column("bucket").to_numpy()
    s[at], t[at] = got.column("s").to_numpy(), got.column("t").to_numpy()
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    gains = [math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist())]
    return np.array(gains, np.int64)


def with_weights(
    df: DataFrame, gains: np.ndarray, text: str = "text", max_n: int = MAX_N, keep_text: bool = True
) -> DataFrame:
    """``df`` with ``n_words``, ``n_features`` and ``weight`` (sum of the gains of a text's n-grams); such columns are replaced.

    ``keep_text=False`` drops the text, so that only narrow rows come back from the workers.
    """
    buckets, added = len(gains), ("n_words", "n_features", "weight")
    kept = [f for f in df.schema.fields if f.name.lower() not in added and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    schema = StructType([*kept, *(StructField(n, LongType(), False) for n in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(text)):
                out = np.zeros((3, len(texts)), np.int64)
                for words, docs, grams in ngram_buckets(texts, max_n, buckets):
                    out[0] += np.bincount(words, minlength=len(texts))
                    out[1] += np.bincount(docs, minlength=len(texts))
                    # sums of whole numbers far below 2 ** 53 are exact in doubles
                    out[2] += np.bincount(docs, gains[grams], len(texts)).astype(np.int64)
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(x) for x in out)], schema.names)

    return df.mapInArrow(run, schema)


def gumbel(ident: Column, seed: int = SEED) -> Column:
    """floor(1000 g), g a standard Gumbel number drawn from sha256 of "seed:ident" (null ident: "seed:null")."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance_resample(
    df: DataFrame, target: DataFrame, text: str = "text", ident: str = "doc_id", percent: int = DRAW_PERCENT,
    min_words: int = MIN_WORDS, seed: int = SEED, max_n: int = MAX_N, buckets: int = BUCKETS,
    target_text: str = "text", keep_text: bool = True,
) -> DataFrame:
    """Every row of ``df`` with n_words, n_features, weight, score and rank (1, 2, ... of the drawn rows, else null).

    Of the N rows with ``min_words`` words or more, floor(percent N / 100) are drawn without
    replacement, in proportion to exp(weight / 1000): the highest weight plus Gumbel noise.
    Ties go to the smaller ``ident`` (nulls first), then to fewer n-grams; equal rows are
    alike. Null and empty texts have no words and weight 0 and are never drawn. An empty
    ``df`` gives an empty result, an empty target equal shares. Columns of ``df`` with the
    names of added ones are replaced. Texts are read in whole blocks of words, so very long ones
    take no more memory. Ranks come from a parallel sort of narrow rows (no single task).
    """
    gains = bucket_gains(bucket_counts(df, text, max_n, buckets), bucket_counts(target, target_text, max_n, buckets), buckets)
    weighed = with_weights(df, gains, text, max_n, keep_text)
    weighed = weighed.withColumn("score", F.col("weight") + gumbel(F.col(ident), seed))
    weighed = checkpointed(weighed.drop("rank"))
    drawn = weighed.filter(F.col("n_words") >= min_words).count() * percent // 100
    fit = F.col("n_words") >= min_words
    order = [(~fit).cast("int"), F.col("score").desc(), F.col(ident).asc(), F.col("n_features")]
    return sequence_id(weighed, order, name="rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


def op11_concatenated_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = importance_resample(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return sample.select("doc_id", "n_features", "weight", "score", "rank")


def crc_sql(strings: str, column: str) -> str:
    """CTEs (after WITH RECURSIVE) that end in crcs (s, crc): unsigned crc32 of the strings in ``column`` of table ``strings``.

    A crc is linear: it is the xor of what each byte adds at its distance from the end.
    """
    table_step = "crc_step[(s & 255) + 1]"
    return f"""crc_bits AS (SELECT b, b::BIGINT AS c, 0 AS k FROM range(256) t(b)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
  crc_table AS (SELECT list(c ORDER BY b) AS crc_step FROM crc_bits WHERE k = 8),
  crc_texts AS (SELECT DISTINCT {column} AS s FROM {strings}),
  crc_hex AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM crc_texts),
  crc_most AS (SELECT coalesce(max(n), 0) AS m FROM crc_hex),
  crc_far AS (SELECT 0 AS d, b, c AS s FROM crc_bits WHERE k = 8
    UNION ALL SELECT d + 1, b, xor({table_step}, s >> 8) FROM crc_far, crc_table, crc_most WHERE d < m),
  crc_start AS (SELECT 0 AS n, 4294967295::BIGINT AS s
    UNION ALL SELECT n + 1, xor({table_step}, s >> 8) FROM crc_start, crc_table, crc_most WHERE n < m),
  crc_bytes AS (SELECT s, n, unnest(range(n)) AS i, x FROM crc_hex WHERE n > 0),
  crc_sums AS (SELECT y.s, bit_xor(f.s) AS c FROM crc_bytes y
    JOIN crc_far f ON f.d = y.n - 1 - y.i AND f.b = ('0x' || substr(y.x, 2 * y.i::INT + 1, 2))::INT GROUP BY y.s),
  crcs AS (SELECT h.s, xor(xor(z.s, coalesce(u.c, 0)), 4294967295::BIGINT) AS crc
    FROM crc_hex h JOIN crc_start z USING (n) LEFT JOIN crc_sums u ON u.s = h.s)"""


def oracle_sql() -> str:
    """DuckDB SQL of the query over ``documents`` and ``benchmark``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    def grams(side: str) -> str:
        return " UNION ALL ".join(
            f"SELECT k, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM {side} WHERE len(ws) >= {n})"
            for n in range(1, MAX_N + 1)
        )
    return f"""
WITH RECURSIVE src AS (SELECT row_number() OVER () AS k, doc_id, {words} AS ws FROM documents),
  tgt AS (SELECT 0 AS k, {words} AS ws FROM benchmark),
  src_grams AS ({grams("src")}), tgt_grams AS ({grams("tgt")}),
  every AS (SELECT g FROM src_grams UNION ALL SELECT g FROM tgt_grams),
  {crc_sql("every", "g")},
  src_buckets AS (SELECT k, crc % {BUCKETS} AS bucket, count(*) AS n FROM src_grams JOIN crcs ON crcs.s = g GROUP BY ALL),
  tgt_buckets AS (SELECT crc % {BUCKETS} AS bucket, count(*) AS n FROM tgt_grams JOIN crcs ON crcs.s = g GROUP BY ALL),
  sums AS (SELECT bucket, sum(n) AS s FROM src_buckets GROUP BY bucket),
  totals AS (SELECT coalesce((SELECT sum(n) FROM src_buckets), 0)::DOUBLE + {BUCKETS} AS ss, coalesce((SELECT sum(n) FROM tgt_buckets), 0)::DOUBLE + {BUCKETS} AS tt),
  gains AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ss / ((s.s + 1)::DOUBLE * tt)))::BIGINT AS gain
    FROM sums s LEFT JOIN tgt_buckets t USING (bucket), totals),
  sized AS (SELECT k, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM src_buckets JOIN gains USING (bucket) GROUP BY k),
  scored AS (SELECT doc_id, len(ws) >= {MIN_WORDS} AS fit, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
    FROM src LEFT JOIN sized USING (k)),
  placed AS (SELECT *, row_number() OVER (ORDER BY (NOT fit)::INT, score DESC, doc_id NULLS FIRST, n_features) AS place, (count(*) FILTER (fit) OVER ()) * {DRAW_PERCENT} // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM placed"""
