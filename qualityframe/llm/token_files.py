"""Token-ID output compressed by Re-Pair grammars, with random access by document.

A table of shards in order of document id. A shard is a run of whole documents whose ids
were shortened by replacing frequent pairs by nonterminals until none is left; it stores
the rules, the expansion length of every rule, the shortened sequence and the place where
each document begins in it. The end id is never part of a pair, so each document begins at
a symbol of its own and can be expanded alone.

Columns of a shard (binary columns hold little-endian integers): ``part``, ``shard`` (order
of the shards: by part, then shard), ``n_docs``, ``n_tokens``, ``doc_ids`` (int64),
``symbol_starts`` (uint32, one more than documents), ``rules`` (uint32 pairs; the rule k
defines symbol ``vocabulary + k``), ``expansions`` (uint32), ``sequence`` (uint16 if all
symbols fit, else uint32), ``vocabulary``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, scratch_path, small_side, table
from .pieces import binary_column, worker_encoder

END = 2
SHARD_TOKENS = 1_000_000
RULES_PER_ROUND = 2048
#: A rule takes 12 bytes and saves a symbol of 2 bytes at each use.
MIN_USES = 12
HASH_BITS = 20

SHARD_SCHEMA = (
    "part int, shard int, n_docs long, n_tokens long, vocabulary int, doc_ids binary, symbol_starts binary, "
    "rules binary, expansions binary, sequence binary"
)


def _cells(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def compress(ids: np.ndarray, vocabulary: int, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortened sequence, rules (k x 2), and a mask that says which ids of the input still begin a symbol.

    A round counts all pairs, takes the most frequent ones as new nonterminals and replaces
    them from left to right; pairs with the end id are never taken. Rounds go on until no pair that
    may be taken is used ``MIN_USES`` times.
    """
    seq = ids.astype(np.int32)
    alive = np.ones(len(seq), bool)
    rules: list[np.ndarray] = []
    made = 0
    while len(seq) > 1:
        keys = seq[:-1].astype(np.int64) << 32 | seq[1:]
        cells = _cells(keys)
        barred = (seq[:-1] == end) | (seq[1:] == end)
        counts = np.bincount(cells[~barred], minlength=1 << HASH_BITS)
        # cells below the threshold hold no frequent pair; the rest are counted exactly
        likely = np.partition(counts, -RULES_PER_ROUND)[-RULES_PER_ROUND]
        for least in sorted({max(MIN_USES, likely), MIN_USES}, reverse=True):  # full cells may hold rare pairs only
            often = (counts >= least)[cells] & ~barred
            pairs, uses = np.unique(keys[often], return_counts=True)
            best = np.argsort(-uses, kind="stable")[:RULES_PER_ROUND]
            best = best[uses[best] >= MIN_USES]
            if len(best):
                break
        chosen = pairs[best]
        _, one = np.unique(_cells(chosen), return_index=True)
        chosen = chosen[np.sort(one)]  # one pair for each cell, so that a table finds it
        if not len(chosen):
            break
        rule_of = np.full(1 << HASH_BITS, -1, np.int32)
        rule_of[_cells(chosen)] = np.arange(len(chosen))
        rule = rule_of[cells]
        at = np.flatnonzero(rule >= 0)
        at = at[chosen[rule[at]] == keys[at]]
        linked = np.concatenate([[False], at[1:] == at[:-1] + 1])
        starts = np.flatnonzero(~linked)
        steps = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        at = at[steps % 2 == 0]
        seq[at] = vocabulary + made + rule[at]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        alive[np.flatnonzero(alive)[at + 1]] = False
        seq = seq[stay]
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1))
        made += len(chosen)
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.int64), alive


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids that each rule stands for; a rule uses earlier ones only, so it is settled after its depth in passes."""
    lengths = np.ones(len(rules) + 1, np.int64)  # the last one stands for any plain id
    parts = np.where(rules >= vocabulary, rules - vocabulary, len(rules))
    while not np.array_equal(got := lengths[parts].sum(1), lengths[:-1]):
        lengths[:-1] = got
    return lengths[:-1]


def expand(seq: np.ndarray, rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids of a sequence of symbols (a whole shard or one document of it)."""
    seq = seq.astype(np.int64)
    while len(at := np.flatnonzero(seq >= vocabulary)):
        sizes = np.ones(len(seq), np.int64)
        sizes[at] = 2
        begin = np.cumsum(sizes) - sizes
        out = np.repeat(seq, sizes)
        pair = rules[seq[at] - vocabulary]
        out[begin[at]], out[begin[at] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def _shard(doc_ids: list[int], parts: list[np.ndarray], lengths: list[np.ndarray], part: int, shard: int, vocabulary: int) -> dict:
    ids = np.concatenate(parts)
    counts = np.concatenate(lengths)
    seq, rules, alive = compress(ids, vocabulary)
    symbol = np.concatenate([[0], np.cumsum(alive)])
    starts = symbol[np.concatenate([[0], np.cumsum(counts)])]
    wide = "<u2" if vocabulary + len(rules) <= 1 << 16 else "<u4"
    return {
        "part": part, "shard": shard, "n_docs": len(doc_ids), "n_tokens": len(ids), "vocabulary": vocabulary,
        "doc_ids": np.array(doc_ids, "<i8").tobytes(), "symbol_starts": starts.astype("<u4").tobytes(),
        "rules": rules.astype("<u4").tobytes(), "expansions": expansion_lengths(rules, vocabulary).astype("<u4").tobytes(),
        "sequence": seq.astype(wide).tobytes(),
    }


def _make_library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode_many(texts: Sequence[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), 50_000):
            got = tokenizer.encode_batch_fast(list(texts[k: k + 50_000]), add_special_tokens=False)
            out += [np.array(e.ids, "<u4").tobytes() for e in got]
        return out

    return encode_many


def added_tokens(path: str) -> re.Pattern[str] | None:
    """What the library takes for a token of its own wherever it stands: a text that holds it is encoded uncut."""
    from tokenizers import Tokenizer

    added = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, added))) if added else None


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write_tokens(docs: DataFrame, path: str, target: str, ident: str = "doc_id", text: str = "text", end: int = END,
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text with the tokenizers library, append ``end``, write shards to ``target``.

    The library's own tokens (such as ``<|endoftext|>``) become their ids where a text holds their strings.

    Shards hold documents in ascending order of ``ident`` (null first; repeated ids by text).
    Null and empty texts have the end id alone. Other columns are not written. Each task of
    the range partitioning writes its own shards through Spark's committed output, so a task
    that is run again writes no shard twice. An empty table gives an empty folder.
    """
    vocabulary = vocabulary_size(path)
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(("library", path), lambda: _make_library(path), lambda: added_tokens(path))
        part, shard, held = TaskContext.get().partitionId(), 0, 0
        names: list[int] = []
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        schema = pa.schema([
            ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("vocabulary", pa.int32()),
            *((c, pa.binary()) for c in ("doc_ids", "symbol_starts", "rules", "expansions", "sequence")),
        ])
        emit = lambda: pa.RecordBatch.from_pylist([_shard(names, parts, lengths, part, shard, vocabulary)], schema)
        for batch in batches:
            doc_ids = [NULL_ID if d is None else d for d in batch.column("doc_id").to_pylist()]
            at = 0
            for ids, bounds in encoder.encode([t or "" for t in batch.column("text").to_pylist()]):
                n = len(bounds) - 1
                counts = np.diff(bounds) + 1
                ended = np.insert(ids, bounds[1:], end)
                stops = np.concatenate([[0], np.cumsum(counts)])
                lo = 0
                while lo < n:  # whole documents until the shard is full
                    hi = max(lo + 1, int(np.searchsorted(stops, stops[lo] + shard_tokens - held, "right")) - 1)
                    names += doc_ids[at + lo: at + hi]
                    parts.append(ended[stops[lo]: stops[hi]])
                    lengths.append(counts[lo:hi])
                    held += int(stops[hi] - stops[lo])
                    lo = hi
                    if held >= shard_tokens or lo < n:
                        yield emit()
                        shard, held = shard + 1, 0
                        names, parts, lengths = [], [], []
                at += n
        if names:
            yield emit()

    rows.mapInArrow(run, SHARD_SCHEMA).write.parquet(target)


#: Stands for a null document id inside a shard.
NULL_ID = -(2**63)


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens (with the end id) and ``ids`` (binary, uint32).

    ``start`` counts the ids of all documents before it: shard totals are summed within
    their part and parts within the file list, in two windows.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(target)
    totals = shards.select("part", "shard", "n_tokens")
    of_part = totals.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = of_part.select(
        "part", F.coalesce(F.sum("n").over(before(Window.partitionBy(F.lit(0)).orderBy("part"))), F.lit(0)).alias("part_start")
    )
    inner = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    starts = totals.join(parts, "part").select("part", "shard", (F.col("part_start") + inner).alias("shard_start"))
    rows = shards.join(small_side(checkpointed(starts)), ["part", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, rules = row["vocabulary"], np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
                wide = "<u2" if vocabulary + len(rules) <= 1 << 16 else "<u4"
                seq = np.frombuffer(row["sequence"], wide)
                lengths = np.concatenate([np.ones(vocabulary, np.int64), np.frombuffer(row["expansions"], "<u4")])
                at = np.frombuffer(row["symbol_starts"], "<u4")
                bounds = np.concatenate([[0], np.cumsum(lengths[seq])])[at]
                ids = expand(seq, rules, vocabulary)
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(bounds[:-1] + row["shard_start"]),
                     pa.array(np.diff(bounds)), binary_column(ids, bounds)],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    columns = ["vocabulary", "doc_ids", "symbol_starts", "rules", "expansions", "sequence", "shard_start"]
    return rows.select(columns).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_document(shard: dict, k: int) -> np.ndarray:
    """Random access: the ids of the k-th document of a shard row, no other document is expanded."""
    vocabulary, rules = shard["vocabulary"], np.frombuffer(shard["rules"], "<u4").reshape(-1, 2).astype(np.int64)
    seq = np.frombuffer(shard["sequence"], "<u2" if vocabulary + len(rules) <= 1 << 16 else "<u4")
    lo, hi = np.frombuffer(shard["symbol_starts"], "<u4")[k: k + 2]
    return expand(seq[lo:hi], rules, vocabulary)


def op9_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    target = scratch_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), target)
    return read_tokens(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
