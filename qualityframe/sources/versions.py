"""Versioned tables behind a view: staged writes, one swap, appends as loads.

A published name is a view. Every full write lands in a table of its own
(``<name>__v<time>_<id>``), which nobody reads until the write has ended; then the view is
replaced, one catalog operation. Readers see the old rows or the new ones, never a part, and a
write that fails leaves the view as it was. What the view points to is kept in its properties.

Appends go to a new ``load`` partition of the current version. The view reads loads up to the
committed one, so a half-written load is invisible, and a repeated attempt replaces it.
The properties also hold the high-water mark of ids, which is swapped together with the rows.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
LOAD = "load"
_CURRENT, _PREVIOUS, _LOAD, _MARK = "version.current", "version.previous", "version.load", "version.high_water"


def validate_identifier(value: str, field_name: str = "identifier") -> str:
    if not value or not _IDENT.fullmatch(value):
        raise ValueError(f"{field_name}={value!r} is not a simple identifier")
    return value


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Pointer:
    """What a published view reads: its version, the one before, the last load (None: not loaded in parts), the highest id."""

    current: str
    previous: str | None = None
    load: int | None = None
    high_water: int | None = None


def pointer(spark: SparkSession, name: str, schema: str) -> Pointer | None:
    """The pointer of a published name; None if there is none, or a plain table of that name."""
    if not spark.catalog.tableExists(f"{schema}.{name}"):
        return None
    props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {schema}.{name}").collect()}
    if _CURRENT not in props:
        return None
    number = lambda key: int(props[key]) if key in props else None
    return Pointer(props[_CURRENT], props.get(_PREVIOUS), number(_LOAD), number(_MARK))


def _swap(
    spark: SparkSession, name: str, schema: str, to: Pointer, columns: Sequence[str],
    comments: Mapping[str, str], table_comment: str | None,
) -> None:
    """Point the view at ``to``: one statement, the commit."""
    props = {_CURRENT: to.current, _PREVIOUS: to.previous, _LOAD: to.load, _MARK: to.high_water}
    told = ", ".join(f"'{k}' = {sql_text(str(v))}" for k, v in props.items() if v is not None)
    cols = ", ".join(f"`{c}`" + (f" COMMENT {sql_text(comments[c])}" if c in comments else "") for c in columns)
    spark.sql(
        f"CREATE OR REPLACE VIEW {schema}.{name} ({cols})"
        + (f" COMMENT {sql_text(table_comment)}" if table_comment else "")
        + f" TBLPROPERTIES ({told}) AS SELECT {', '.join(f'`{c}`' for c in columns)} FROM {schema}.{to.current}"
        + (f" WHERE {LOAD} <= {to.load}" if to.load is not None else "")
    )


def _shown(spark: SparkSession, name: str, schema: str) -> tuple[list[str], dict[str, str], str | None]:
    """Columns, column comments and comment of a published view."""
    fields = spark.table(f"{schema}.{name}").schema.fields
    comments = {f.name: f.metadata["comment"] for f in fields if "comment" in f.metadata}
    return [f.name for f in fields], comments, spark.catalog.getTable(f"{schema}.{name}").description


def commit_version(
    df: DataFrame,
    name: str,
    schema: str,
    comments: Mapping[str, str] | None = None,
    table_comment: str | None = None,
    partition_by: Sequence[str] = (),
    bucket_by: tuple[int, Sequence[str]] | None = None,
    columns: Sequence[str] | None = None,
    loads: bool = False,
    ids_after: int | None = None,
) -> int:
    """Write ``df`` as a new version of ``schema.name``, then point the name at it; returns the rows written.

    ``partition_by`` rebalances rows by those columns first, so that a partition gets few
    files and a hot one several tasks. ``bucket_by`` (number, columns) writes one sorted file
    a bucket. ``columns`` are those that the name shows (default: all); others are there for later
    builds through ``version_table``. ``loads=True`` starts a table that ``append_load``
    extends; ``ids_after`` says that its rows are numbered from there on. The version before stays for running readers; the one before that is dropped.
    """
    spark = df.sparkSession
    validate_identifier(name, "table"), validate_identifier(schema, "schema")
    shown = [c for c in (columns or df.columns) if c != LOAD]
    if loads:
        df, partition_by = df.withColumn(LOAD, F.lit(1)), [*partition_by, LOAD]
    before = pointer(spark, name, schema)
    staged = f"{name}__v{int(time.time() * 1000):013d}_{uuid.uuid4().hex[:8]}"
    told = Observation(f"rows_{staged}")
    out = df.observe(told, F.count(F.lit(1)).alias("rows"))
    if bucket_by:
        out = out.repartition(bucket_by[0], *bucket_by[1])
    elif partition_by:
        out = out.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = out.write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(bucket_by[0], *bucket_by[1]).sortBy(*bucket_by[1])
    try:
        writer.saveAsTable(f"{schema}.{staged}")
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {schema}.{staged}")
        raise
    if before is None and spark.catalog.tableExists(f"{schema}.{name}"):
        # a plain table had the name: it makes room once, and is the version before
        plain = f"{name}__v{0:013d}_{uuid.uuid4().hex[:8]}"
        spark.sql(f"ALTER TABLE {schema}.{name} RENAME TO {schema}.{plain}")
        before = Pointer(plain)
    rows = int(told.get["rows"])
    mark = None if ids_after is None else ids_after + rows
    to = Pointer(staged, before.current if before else None, 1 if loads else None, mark)
    _swap(spark, name, schema, to, shown, comments or {}, table_comment)
    if before and before.previous:
        spark.sql(f"DROP TABLE IF EXISTS {schema}.{before.previous}")
    return rows


def append_load(df: DataFrame, name: str, schema: str) -> int:
    """Add the rows of ``df`` (the version's columns) as the next load of ``schema.name``; returns the rows written.

    Nothing is copied. The rows show, and the high-water mark of a numbered table moves on by
    their number, once the whole load is written.
    """
    spark = df.sparkSession
    at = pointer(spark, name, schema)
    if at is None or at.load is None:
        raise ValueError(f"{schema}.{name} is not published in loads")
    stored = [c for c in spark.table(f"{schema}.{at.current}").columns if c != LOAD]
    told = Observation(f"rows_{at.current}_{at.load + 1}_{uuid.uuid4().hex[:8]}")
    out = df.select(*stored).observe(told, F.count(F.lit(1)).alias("rows"))
    stored_as = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {schema}.{at.current}").collect()}
    if "Num Buckets" in stored_as:  # one file a bucket
        cols = re.findall(r"[\w]+", stored_as["Bucket Columns"])
        out = out.repartition(int(stored_as["Num Buckets"]), *cols)
    # what an attempt that failed has left in this partition is replaced
    view = f"load_{uuid.uuid4().hex}"
    out.createOrReplaceTempView(view)
    try:
        spark.sql(
            f"INSERT OVERWRITE {schema}.{at.current} PARTITION ({LOAD} = {at.load + 1}) "
            f"SELECT {', '.join(f'`{c}`' for c in stored)} FROM {view}"
        )
    finally:
        spark.catalog.dropTempView(view)
    rows = int(told.get["rows"])
    mark = None if at.high_water is None else at.high_water + rows
    columns, comments, comment = _shown(spark, name, schema)
    _swap(spark, name, schema, Pointer(at.current, at.previous, at.load + 1, mark), columns, comments, comment)
    return rows


def version_table(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """All stored columns of what ``schema.name`` points to, also those that it does not show."""
    at = pointer(spark, name, schema)
    if at is None:
        return spark.table(f"{schema}.{name}")
    stored = spark.table(f"{schema}.{at.current}")
    return stored if at.load is None else stored.filter(F.col(LOAD) <= at.load).drop(LOAD)


def sweep(spark: SparkSession, schema: str, older_than_hours: float = 24.0) -> list[str]:
    """Drop versions that no name points to and that started longer ago (left by jobs that were killed); returns them."""
    validate_identifier(schema, "schema")
    names = [t.name for t in spark.catalog.listTables(schema)]
    held: set[str] = set()
    for name in names:
        at = None if "__v" in name else pointer(spark, name, schema)
        held |= {at.current, at.previous or at.current} if at else set()
    limit = int((time.time() - older_than_hours * 3600) * 1000)
    old = [n for n in names if (m := re.search(r"__v(\d{13})_[0-9a-f]{8}$", n)) and int(m[1]) < limit and n not in held]
    for n in old:
        spark.sql(f"DROP TABLE IF EXISTS {schema}.{n}")
    return old


@contextmanager
def scratch_schema(spark: SparkSession, stem: str = "qualityframe_run") -> Iterator[str]:
    """A schema of its own for one run, dropped with its tables in the end."""
    schema = f"{validate_identifier(stem)}_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE SCHEMA {schema}")
    try:
        yield schema
    finally:
        spark.sql(f"DROP SCHEMA IF EXISTS {schema} CASCADE")
