"""Input tables and inline dimensions.

``Tables`` reads each parquet table lazily, once per session object. Every read is a
plain ``spark.read.parquet`` so Catalyst prunes columns and pushes filters into the
scan; nothing here caches or collects.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_NAMES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def read_table(spark: SparkSession, source: str, name: str) -> DataFrame:
    """Read table ``name`` from a folder of ``<name>.parquet`` files or from the catalog."""
    if name not in TABLE_NAMES:
        raise ValueError(f"unknown table {name!r}")
    if source.startswith("catalog:"):
        schema = source.split(":", 1)[1]
        return spark.table(f"{schema}.{name}")
    return spark.read.parquet(os.path.join(source, f"{name}.parquet"))


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem`` -> DataFrame.

    Each table is read once per accessor (file listing and footer schema) and the same
    lazy DataFrame is reused by every query built from it; ``refresh()`` after the files of
    a source change.
    """

    def __init__(self, spark: SparkSession, source: str):
        self.spark = spark
        self.source = source
        self._cache: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def refresh(self) -> None:
        """Forget the read DataFrames and derived views (re-list files on next access)."""
        self._cache.clear()
        self._views.clear()

    def view(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived lazy DataFrame built once per accessor (like a session temp view):
        questions sharing an input reuse one plan instead of rebuilding its expressions."""
        if name not in self._views:
            self._views[name] = build()
        return self._views[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.source, name)
        return self._cache[name]


def dimension(spark: SparkSession, rows: Sequence[Sequence[object]], schema: T.StructType | str) -> DataFrame:
    """Inline literal relation (a VALUES list) marked for broadcast.

    Its size is fixed by the caller's literal rows, which is the bound that makes the
    broadcast safe whatever the size of the fact table it meets.
    """
    return F.broadcast(spark.createDataFrame([tuple(r) for r in rows], schema))
