"""Deterministic pseudo-random numbers from row keys.

Two methods:

* ``murmur3`` (default): Spark's built-in ``hash`` (Murmur3, seed 42), pmod onto a grid.
  Fast and fully JVM-side, but no other engine computes the same value.
* ``md5``: first 8 hex digits of ``md5(concat_ws('|', seed, salt, keys...))`` as an
  unsigned integer, mod the grid. Slower, but reproducible outside Spark (DuckDB:
  ``('0x' || substr(md5(...), 1, 8))::BIGINT % grid``), which is what the checks use.

Keys should be strings, integers or dates: their text form is the same everywhere.
The value depends only on the key values, so results do not change with partitioning,
row order, retries or cluster size.

Caveats: NULL key values are skipped by both methods (Spark's ``hash`` ignores NULL
arguments; ``concat_ws`` drops them), so ``(a, NULL)`` hashes like ``(a)``. Under
murmur3 the date, string and timestamp forms of the same day give different values, so
keep key types stable between runs that must agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qualityframe.functions.columns import ColumnLike, to_col

#: Steps of a fraction when the caller names none: all values that the method can give.
FULL_GRID = {"murmur3": 1 << 31, "md5": 1 << 32}
METHODS = ("murmur3", "md5")


def key_columns(seed: int | str, salt: str, cols: tuple[ColumnLike, ...]) -> list[Column]:
    return [F.lit(str(seed)), F.lit(str(salt)), *[to_col(c) for c in cols]]


def hash_int(seed: int | str, salt: str, *cols: ColumnLike, modulo: int, method: str = "murmur3") -> Column:
    """Integer in [0, modulo) derived from (seed, salt, cols)."""
    if modulo <= 0:
        raise ValueError("modulo must be positive")
    keys = key_columns(seed, salt, cols)
    if method == "murmur3":
        return F.pmod(F.hash(*keys).cast("long"), F.lit(modulo).cast("long"))
    if method == "md5":
        text = F.concat_ws("|", *[k.cast("string") for k in keys])
        head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
        return F.pmod(head, F.lit(modulo).cast("long"))
    raise ValueError(f"method must be one of {METHODS}")


def hash_bucket(
    seed: int | str, salt: str, *cols: ColumnLike, modulo: int, offset: int = 0, method: str = "murmur3"
) -> Column:
    """``hash_int`` shifted by ``offset`` (e.g. hours 6..15 = modulo 10, offset 6)."""
    base = hash_int(seed, salt, *cols, modulo=modulo, method=method)
    return base + F.lit(offset) if offset else base


def hash_fraction(
    seed: int | str, salt: str, *cols: ColumnLike, grid: int | None = None, method: str = "murmur3"
) -> Column:
    """DOUBLE on the grid 0, 1/grid, ..., (grid-1)/grid derived from the keys."""
    grid = grid or FULL_GRID.get(method, 1)
    return hash_int(seed, salt, *cols, modulo=grid, method=method).cast("double") / F.lit(float(grid))
