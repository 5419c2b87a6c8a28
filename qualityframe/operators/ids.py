"""Dense, gap-free sequence ids without a single-partition sort, and index lookups.

``ROW_NUMBER() OVER (ORDER BY ...)`` with no PARTITION BY moves every row into one task
(``Exchange SinglePartition``). ``sequence_id`` gives the same numbers in parallel:

1. range-partition on the full sort key and sort inside each partition (Spark samples
   the key to pick balanced bounds, so a hot leading value, e.g. one date holding a
   third of the rows, is split across partitions by the remaining sort columns), and
   tag every row with (partition, position);
2. checkpoint the tagged rows into the shared ``spark.checkpoint.dir``;
3. count rows per partition: one row per partition, a bounded table;
4. exclusive running total of those counts = each partition's offset (broadcast);
5. id = start + offset + position inside the partition.

Why the checkpoint: steps 3 and 5 must see the very same partitioning. Spark's range
partitioner seeds its sample with an internal RDD id, so two separately planned range
exchanges (e.g. when the counting branch prunes columns and the exchange is not reused)
can cut the data at different bounds. Reading both passes from one stored copy makes
the ids exact whatever the optimizer does, and cuts the lineage so a lost executor
does not force the sort to be redone.
With a total order (unique sort key) the ids equal the global ROW_NUMBER exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualityframe.functions.columns import ColumnLike, to_col
from qualityframe.operators.sizes import BROADCAST_ROWS
from qualityframe.session import ensure_checkpoint_dir

_PID = "_qf_pid"
_MID = "_qf_mid"
_OFF = "_qf_off"
_TIE = "_qf_tie"


def _sort_orders(order_by: Sequence[ColumnLike]) -> list[Column]:
    return [to_col(c) for c in order_by]


def sequence_id(
    df: DataFrame,
    order_by: Sequence[ColumnLike],
    start: int = 1,
    name: str = "seq_id",
    num_partitions: int | None = None,
    spread_ties: bool = True,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``name`` = start, start+1, ... following ``order_by`` (ascending, nulls first
    unless the Columns say otherwise). Rows that tie on ``order_by`` get consecutive ids in
    an arbitrary order (input order for a file scan); with a total order the ids equal
    ``ROW_NUMBER() OVER (ORDER BY ...)``. Ids are always dense and unique: positions are
    read back from the one checkpointed copy. ``keep`` limits the output (and the
    checkpointed copy) to the columns needed downstream; sort-only columns can be left out."""
    if not order_by:
        raise ValueError("sequence_id needs an ordering")
    orders = _sort_orders(order_by)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if spread_ties:
        # last sort key = input position: rows with equal sort keys (e.g. one key holding a
        # third of the rows) can then be cut across range partitions instead of landing in one
        df = df.withColumn(_TIE, F.monotonically_increasing_id())
        orders = [*orders, F.col(_TIE)]
    ordered = df.repartitionByRange(n, *orders).sortWithinPartitions(*orders)
    out_cols = list(keep) if keep is not None else [c for c in df.columns if c != _TIE]
    tagged = ordered.select(*out_cols, F.spark_partition_id().alias(_PID), F.monotonically_increasing_id().alias(_MID))
    ensure_checkpoint_dir(df.sparkSession)
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy(_PID).agg(F.count(F.lit(1)).alias("_qf_n"))
    # At most one row per partition: a bounded table, safe to window and broadcast.
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_PID, F.coalesce(F.sum("_qf_n").over(w), F.lit(0)).alias(_OFF))
    # position inside the partition = mid - (pid << 33) (layout of monotonically_increasing_id)
    pos = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (
        tagged.join(F.broadcast(offsets), _PID, "inner")
        .withColumn(name, F.lit(start).cast("long") + F.col(_OFF) + pos)
        .drop(_PID, _MID, _OFF)
    )


def assign_by_index(
    df: DataFrame,
    idx_col: ColumnLike,
    dim: DataFrame,
    order_by: Sequence[str],
    index_name: str = "_qf_idx",
) -> DataFrame:
    """Attach the dimension row whose 0-based position (in ``order_by`` order) equals ``idx_col``.

    A ``dim`` that a count proves small is numbered by one window and broadcast; a larger one is
    numbered in parallel (``sequence_id``) and joined as Spark sees fit."""
    asked = df.withColumn(index_name, to_col(idx_col).cast("long"))
    if dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        position = (F.row_number().over(Window.orderBy(*order_by)) - 1).cast("long")
        return asked.join(F.broadcast(dim.withColumn(index_name, position)), index_name, "inner").drop(index_name)
    return asked.join(sequence_id(dim, order_by, start=0, name=index_name), index_name, "inner").drop(index_name)
