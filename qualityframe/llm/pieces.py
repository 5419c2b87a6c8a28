"""Byte-level BPE of whole texts through a bounded cache of space-delimited pieces.

A space followed by a non-space always begins a match of the pre-tokeniser's pattern, so a
text may be cut there and its pieces encoded apart; the ids are those of the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import give_back

#: Pieces kept per Python worker (about 200 bytes each); the cache starts anew beyond it.
CACHE_PIECES = 250_000
#: Longer pieces are encoded, but not kept.
CACHE_LENGTH = 48
#: Characters of text that are encoded together.
GROUP_CHARS = 2_500_000

#: Rows of a batch that become Python strings together.
ROWS = 1000

_ODD = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")


class PieceEncoder:
    """Encodes texts to ids by ``encode_many`` (little-endian unsigned 32-bit) over unseen pieces.

    Texts in which ``whole`` is found are not cut.
    """

    def __init__(self, encode_many: Callable[[Sequence[str]], list[bytes]], whole: re.Pattern[str] | None = None):
        self.encode_many, self.whole = encode_many, whole
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Group by group: the ids of its texts in a row, and the bounds of each text's ids."""
        group, chars = [], 0
        for text in texts:
            group.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield self._group(group)
                group, chars = [], 0
        if group:
            yield self._group(group)

    def _group(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        uncut = [bool(self.whole and self.whole.search(t)) for t in texts]
        if any(uncut) or any(map(_ODD.search, texts)):
            parts = [[t] if u else _CUT.split(t) for t, u in zip(texts, uncut)]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            pieces = pa.array([p for ps in parts for p in ps], pa.string())
        else:
            lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
            offsets, pieces = lists.offsets.to_numpy().astype(np.int64), lists.values
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        slots = coded.indices.to_numpy().astype(np.int64)
        # the first piece of a text has no space before it
        heads = offsets[:-1]
        firsts = [distinct[k] for k in slots[heads].tolist()]
        slots[heads] = len(distinct) + np.arange(len(texts))
        if len(self.known) > CACHE_PIECES:
            self.known = {}
        got = list(map(self.known.get, distinct))
        new = [k for k, ids in enumerate(got) if ids is None]
        made = self.encode_many([*(" " + distinct[k] for k in new), *firsts])
        for k, ids in zip(new, made):
            got[k] = ids
            if len(distinct[k]) <= CACHE_LENGTH:
                self.known[distinct[k]] = ids
        got += made[len(new):]
        flat = np.frombuffer(b"".join(got), "<u4")
        counts = np.fromiter(map(len, got), np.int64, len(got)) // 4
        starts = np.cumsum(counts) - counts
        each = counts[slots]
        ends = np.cumsum(each)
        total = int(ends[-1])
        ids = flat[np.repeat(starts[slots] - ends + each, each) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[offsets]


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts of a column (null: empty), a few rows at a time as Python strings."""
    for at in range(0, len(column), ROWS):
        yield from (t or "" for t in column.slice(at, ROWS).to_pylist())


def binary_column(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of ids as an Arrow binary column, without a copy for each row."""
    offsets = pa.py_buffer((bounds * 4).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(ids.astype("<u4"))])


_ENCODERS: dict[tuple, PieceEncoder] = {}


def worker_encoder(
    key: tuple, make: Callable[[], Callable[[Sequence[str]], list[bytes]]], whole: Callable[[], re.Pattern[str] | None] = lambda: None,
) -> PieceEncoder:
    """The encoder of this Python worker: built once, its cache serves all tasks of the worker."""
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[key] = PieceEncoder(make(), whole())
    return _ENCODERS[key]


def with_column(schema: StructType, name: str, drop: Sequence[str] = ()) -> StructType:
    kept = [f for f in schema.fields if f.name != name and f.name not in drop]
    return StructType([*kept, StructField(name, BinaryType(), False)])


def map_column(df: DataFrame, source: str, out: str, key: tuple, make: Callable[[], Callable], keep: bool = True) -> DataFrame:
    """``df`` with binary column ``out`` = ids of the text column ``source`` (null: empty text).

    A column that already is named ``out`` is replaced. ``keep=False`` drops ``source``.
    """
    schema = with_column(df.schema, out, () if keep else (source,))
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(key, make)
        for batch in batches:
            at = 0
            for ids, bounds in encoder.encode(texts_of(batch.column(source))):
                part = batch.slice(at, len(bounds) - 1)
                at += len(bounds) - 1
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), binary_column(ids, bounds)], [*names, out])
            batch = part = ids = bounds = None
            give_back()

    return df.mapInArrow(run, schema)
