"""Session construction and the shared checkpoint folder.

On a cluster the session is handed to us already configured; these helpers only
fill in settings that are missing, so a cluster's own values always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings applied only when the session does not already define them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # remove sequence-id checkpoints once their DataFrames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # the Python call-site capture for error messages costs several JVM round trips per
    # Column function call while plans are built; batch jobs do not need it
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(
    master: str | None = None,
    app_name: str = "qualityframe",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    submitted = SparkConf()  # what spark-submit and spark-defaults.conf have set
    for key, value in DEFAULT_CONF.items():
        if not submitted.contains(key):
            builder = builder.config(key, value)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None for a Spark Connect session."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions have no local SparkContext
        return None


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` (or None)."""
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    return spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Use the cluster's checkpoint folder; create a scratch one only when unset (tests).

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as is; a
    machine-local scratch folder is created only for a local session with nothing set.
    """
    sc = _context(spark)
    current = checkpoint_dir(spark)
    if sc is None:
        return current  # Connect: the server side owns the checkpoint location
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    scratch = tempfile.mkdtemp(prefix="qualityframe-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(scratch)
    return scratch


def default_parallelism(spark: SparkSession, fallback: int = 8) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.sql.shuffle.partitions", str(fallback)))
