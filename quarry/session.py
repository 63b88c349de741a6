"""Session construction and the shared work folder."""

from __future__ import annotations


import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # remove checkpoint files once their DataFrames are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect.

    On a cluster ``master`` stays ``None`` so the launcher decides; tests pass
    ``local[*]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only when unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we read it
    from the session.  Only a bare local session (tests) gets a fresh
    folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # only a bare local session (tests) gets here; a cluster names its
        # shared folder.  spark.checkpoint.dir itself cannot be set at run
        # time, so the folder is handed to the SparkContext directly.
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def _hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder.

    Written tables (snapshots, clustered layouts, sorted rows) go here so
    every executor of a cluster sees them.  The application's folder goes
    when the application ends.
    """
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-work/{spark.sparkContext.applicationId}"
    fs, p = _hadoop_path(spark, base)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def folder_bytes(spark: SparkSession, path: str) -> int:
    """What the files of a folder take."""
    fs, p = _hadoop_path(spark, path)
    return fs.getContentSummary(p).getLength()


@contextmanager
def shuffle_files_dropped(spark: SparkSession):
    """Inside, a finished query's shuffle files go at once; what it wrote stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession, most_bytes: int = 8 << 20):
    """Inside, Spark hands Python its rows in batches bounded by bytes, too."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for plain-Python access in tests."""
    return path[len("file:"):] if path.startswith("file:") else path


__all__ = ["get_session", "ensure_checkpoint_dir", "work_path", "local_path", "scale_conf", "DEFAULT_CONF"]


def scale_conf(input_bytes: int, total_cores: int, executor_memory_bytes: int | None = None,
               target_partition_bytes: int = 256 << 20) -> dict:
    """Settings that keep every task's data within executor memory at a
    given input size (pass to ``get_session(extra=...)`` or spark-submit).

    * file splits of ``target_partition_bytes`` (``maxPartitionBytes``);
    * the initial shuffle partition count so one partition holds about
      ``target_partition_bytes`` of the largest shuffle (taken as the input
      size), at least 3 waves of ``total_cores``; AQE then coalesces small
      ones toward the same advisory size and splits skewed joins;
    * with ``executor_memory_bytes``, the target is capped so a task's
      share of execution memory (about 60% / cores per executor, taken as
      4) holds its partition without spilling.
    """
    target = target_partition_bytes
    if executor_memory_bytes:
        target = min(target, int(executor_memory_bytes * 0.6 / 4))
    parts = max(3 * total_cores, -(-input_bytes // target))
    return {
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target),
    }
