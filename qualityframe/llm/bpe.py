"""Byte-level BPE encoding and decoding by a rank queue.

All pre-tokens of a batch lie in one linked list of byte positions. Buckets, one per merge
rank, hold the left positions of pairs; a three-level bitmap with 64 children per node says
which buckets are filled, and find-first-set on its words gives the next rank. The bucket is
taken out whole, entries whose pair has meanwhile changed are skipped as stale, the rest
are merged, and the pairs on both sides are put in the buckets of their ranks. Each merge
costs a constant number of steps, however long a pre-token is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table
from .pieces import ROWS, map_column, with_column

NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by rank, and the hierarchical bitmap of the filled ones."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels = [[0] * (ranks // 64 + 1)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * ((len(self.levels[-1]) - 1) // 64 + 1))

    def put(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.buckets[rank] = [positions]
        at = rank
        for level in self.levels:
            word, bit = at >> 6, 1 << (at & 63)
            filled = level[word]
            level[word] = filled | bit
            if filled:
                return
            at = word

    def take_first(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank with entries, and its positions; the bucket is emptied."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        rank = at
        for level in self.levels:
            word = at >> 6
            level[word] &= ~(1 << (at & 63))
            if level[word]:
                break
            at = word
        held = self.buckets.pop(rank)
        return rank, held[0] if len(held) == 1 else np.concatenate(held)


class RankMerger:
    """Merges of byte strings by a rank table; the id of a token is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.base = self.size + 1  # the id ``size`` stands for "no token"
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.ranks = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], NONE)
        two = np.add.outer(self.byte_ids.astype(np.int64) * self.base, self.byte_ids.astype(np.int64))
        self.byte_pairs = self._lookup(two.ravel())

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def _pair(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        return self._lookup(np.asarray(left, np.int64) * self.base + right)

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the bounds of each word's ids (one more than words)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n:
            return np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)
        tok = np.append(self.byte_ids[data], np.int32(self.size))  # position n: beyond every word
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        after = np.arange(1, n + 2, dtype=np.int32)
        prior = np.arange(-1, n, dtype=np.int32)
        full = lengths > 0
        after[ends[full] - 1] = n
        prior[ends[full] - lengths[full]] = n
        rank = np.full(n + 1, NONE, np.int32)
        rank[: n - 1] = self.byte_pairs[data[:-1].astype(np.int32) * 256 + data[1:]]
        rank[ends[full] - 1] = NONE
        queue = RankQueue(self.size)
        self._put(queue, rank, np.flatnonzero(rank != NONE).astype(np.int32))
        while (first := queue.take_first()) is not None:
            r, at = first
            at = at[rank[at] == r]  # stale entries go
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                at, later = self._together(r, at, tok, word, after, prior)
                if len(later):
                    queue.put(r, later)
            right = after[at]
            beyond = after[right]
            tok[at] = r
            tok[right] = -1
            rank[right] = NONE
            after[at] = beyond
            prior[beyond] = at
            before = prior[at]
            rank[at] = self._pair(tok[at], tok[beyond])
            has = before != n
            before, owner = before[has], at[has]
            rank[before] = self._pair(tok[before], tok[owner])
            self._put(queue, rank, np.concatenate([at, before]))
        alive = tok[:n] >= 0
        ids = tok[:n][alive]
        bounds = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])]
        return ids, bounds

    def _together(self, r, at, tok, word, after, prior):
        """Positions that may be merged at once, as if word by word from the left; and the rest.

        Of pairs that overlap (runs of one token) every other one counts. Should a merge in a
        word give a pair of lower rank than ``r``, that pair must come before the word's other
        positions; then only the first of each word is merged now.
        """
        none = at[:0]
        chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
        if chained.any():
            starts = np.flatnonzero(~chained)
            steps = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
            at = at[steps % 2 == 0]
        same = word[at[1:]] == word[at[:-1]]
        if not same.any():
            return at, none
        beyond = after[after[at]]
        joins = np.append(beyond[:-1] == at[1:], False)
        left = np.where(np.concatenate([[False], joins[:-1]]), r, tok[prior[at]])
        lowest = min(
            self._pair(r, tok[beyond]).min(), self._pair(r, np.where(joins, r, tok[beyond])).min(), self._pair(left, r).min()
        )
        if lowest > r:
            return at, none
        first = np.concatenate([[True], ~same])
        return at[first], at[~first]

    @staticmethod
    def _put(queue: RankQueue, rank: np.ndarray, at: np.ndarray) -> None:
        ranks = rank[at]
        held = ranks != NONE
        at, ranks = at[held], ranks[held]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        for r, lo, hi in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(at)]):
            queue.put(r, at[lo:hi])


def _make_encoder(path: str, pattern: str):
    import regex

    ranks = load_ranks(path)
    merger, split = RankMerger(ranks), regex.compile(pattern)

    def encode_many(texts: Sequence[str]) -> list[bytes]:
        pieces = [[m.encode("utf-8", "surrogatepass") for m in split.findall(t)] for t in texts]
        number: dict[bytes, int] = {}
        for ms in pieces:
            for m in ms:
                number.setdefault(m, len(number))
        ids, bounds = merger.encode(list(number))
        raw, at = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
        return [b"".join(raw[at[k]: at[k + 1]] for k in map(number.__getitem__, ms)) for ms in pieces]

    return encode_many


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", keep: bool = True) -> DataFrame:
    """``df`` with binary ``out``: the text's ids as little-endian unsigned 32-bit integers.

    ``path``: a rank file that every executor can read (a tokenizer installed with the job);
    ``pattern``: its pre-tokeniser. Null and empty texts have no ids. Rows and other columns
    stay as they are; a column named ``out`` is replaced. Special strings are ordinary text.
    """
    return map_column(df, text, out, ("bpe", path, pattern), lambda: _make_encoder(path, pattern), keep)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with binary ``out``: the bytes of the ids in column ``ids`` (null: empty)."""
    schema = with_column(df.schema, out)
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            token[r] = t
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                told = (
                    b"".join(map(token.__getitem__, np.frombuffer(raw.as_buffer() or b"", "<u4").tolist())) if raw.is_valid else b""
                    for raw in part.column(ids)
                )
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(told, pa.binary())], [*names, out])
            batch = part = told = None
            give_back()

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, of documents encoded and decoded."""
    coded = decode(encode(docs.select("doc_id", "text"), path, pattern, keep=False), path)
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
