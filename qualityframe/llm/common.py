"""Helpers that the training-data operators share: table access, checkpoints, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

import pyarrow as pa
import qualityframe
from py4j.protocol import Py4JError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualityframe.session import ensure_checkpoint_dir

#: Words of the contracts: maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a counted side may be broadcast; its rows here are a few scalars wide.
BROADCAST_ROWS = 200_000

#: Rows of an Arrow batch of whole texts, where the session has no number of its own (Spark's default is 10,000).
BATCH_ROWS = 1_000

#: Rows of a part of a gathered frame; its rows here are a few scalars wide.
ROWS_A_PART = 50_000


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application (``addPyFile``).

    A job submitted with the package in ``--py-files`` has it already; a second copy does no harm.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(qualityframe.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="code-")) / "qualityframe-code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Files of the frames stored since each open ``temporaries``.
_TEMPORARY: list[list[str]] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _TEMPORARY:
        file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            _TEMPORARY[-1].append(file.get())
    return out


def gathered(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, and read in no more parts than its rows fill (``ROWS_A_PART`` each).

    The tasks of a part write shuffle files of their own, so a small frame in hundreds of parts leaves
    more files than rows behind in every shuffle. Rows are counted in a task a core, as the driver keeps a record of
    every task. Sizes are estimated anew from here on.
    """
    out = _without_estimates(checkpointed(df))
    rows = out.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()
    return out.coalesce(rows // ROWS_A_PART + 1)


def _without_estimates(df: DataFrame) -> DataFrame:
    """``df`` (checkpointed) without Spark's estimates of the plan behind it.

    A checkpoint keeps them, and a join is taken to be as large as the product of its sides. Where every round joins
    what the last one stored, the digits of the size double with it, until the number itself fills the driver's heap.
    """
    spark, rows = df.sparkSession, df._jdf.queryExecution().logical().rdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)


def in_one_part(df: DataFrame) -> bool:
    """Whether Spark plans ``df`` as one part, so that it is grouped without a shuffle."""
    try:
        return df._jdf.queryExecution().sparkPlan().outputPartitioning().numPartitions() == 1
    except IllegalArgumentException:  # a join that is yet to deal its sides into equal numbers of parts
        return False


def within(df: DataFrame, *made_of: DataFrame) -> DataFrame:
    """``df`` in one part if all that it is made of is, which Spark's plans lose sight of behind a join or a union."""
    return df.coalesce(1) if all(map(in_one_part, made_of)) else df


def together(*frames: DataFrame) -> DataFrame:
    """The union of the frames, in one part if each of them is (``ROWS_A_PART`` rows of each then)."""
    return within(reduce(DataFrame.union, frames), *frames)


def brought_to(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` (gathered) to join with ``rows``: with a broadcast hint if it is in one part and they are not."""
    return F.broadcast(df) if in_one_part(df) and not in_one_part(rows) else df


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is checkpointed or written inside is deleted at the end, whole tables of a stage that has its result.

    Gives a function that stores a frame to stay: pass what is needed afterwards through it.
    """
    own: list[str] = []
    _TEMPORARY.append(own)

    def stay(df: DataFrame) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return df.checkpoint(eager=True)

    try:
        yield stay
    finally:
        _TEMPORARY.remove(own)
        context = spark.sparkContext
        for name in own:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are gone, which it does when the driver collects garbage.

    An iterative operator leaves many small shuffles behind long before the driver's memory fills up. What the
    driver's JVM has freed outside its heap goes back to the system, too.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    _trim_driver(spark)


def _trim_driver(spark: SparkSession) -> None:
    """Return what C's allocator keeps of the memory that the driver's compilers, threads and codecs have freed."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    kinds, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    try:
        for k, name in enumerate(names):
            kinds[k] = jvm.java.lang.Class.forName(name)
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given[1] = "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # JDKs before 17.0.9, and others than Linux's, do not have it
        pass


def narrow_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python a thousand rows at a time; a number that the session sets itself wins.

    A batch is held by the JVM, by the worker, and again as Python's strings, and a stage may have two workers a task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Return what a Python worker has freed to the system, which C's allocator and Arrow's otherwise keep.

    Workers outlive their tasks: what they keep adds to the executor's memory in all later stages.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # glibc has it, other C libraries give memory back by themselves
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, beside the session's checkpoints (shared storage)."""
    return f"{str(ensure_checkpoint_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (columnar, compressed)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if _TEMPORARY:
        _TEMPORARY[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small, else as it is (shuffled join, AQE skew handling).

    Pass a checkpointed or written frame, so that the count does not compute it twice.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, so that extra columns of callers never clash."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """All words of a text as an array; null text gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
