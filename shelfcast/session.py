"""Session construction and lineage management.

Scale notes
-----------
* AQE is on: shuffle partitions are coalesced from measured map output
  and skewed partitions of a sort-merge join are split (``skewJoin``) so a
  hot key does not land in a single task.
* No broadcast is chosen from plan estimates.  Jobs broadcast a lookup
  side after measuring its bytes (``measured``) against
  ``broadcast_limit``; any other join may still become a broadcast at run
  time, but only when AQE has measured its materialised size.
* Lineage is cut by writing parquet (``materialize``) into the folder
  named by ``spark.checkpoint.dir`` (a shared, fault-tolerant location on a
  cluster).  A local folder is made only for a local master with none
  configured, i.e. in tests and local benches; any other master without a
  folder is an error, since executors would each write to their own disk.
* A job whose result is committed inside it wraps its work in
  ``scratch_folder``: what it materializes goes to a folder of its own that
  is deleted at the end.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  Values for local runs; on a cluster the
# deployment overrides partition counts and memory.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # No broadcast from plan *estimates*: a join side is broadcast only when
    # AQE has measured its materialised size (or a hint marks a side whose
    # size is bounded by construction).
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Largest lookup side (bytes in memory) that jobs broadcast after measuring
# it.  Override with the session conf ``shelfcast.broadcast.maxBytes``.
BROADCAST_MAX_BYTES = 128 * 1024 * 1024
# Rows in memory take up to so many times their bytes in compressed parquet.
MEMORY_PER_FILE_BYTE = 4

_scratch: ContextVar[str | None] = ContextVar("shelfcast_scratch", default=None)


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("shelfcast.broadcast.maxBytes", str(BROADCAST_MAX_BYTES)))


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shelfcast", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    A master is set only when the caller names one (or ``BENCH_CPUS`` asks
    for local threads); otherwise the one of the submission holds.  Memory
    is the caller's or the submission's choice, too.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is None and os.environ.get("BENCH_CPUS"):
        master = f"local[{os.environ['BENCH_CPUS']}]"
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (builder.config("spark.driver.host", "127.0.0.1")
                       .config("spark.driver.bindAddress", "127.0.0.1"))
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def work_folder(master: str, configured: str | None) -> str:
    """The folder for intermediate data; a fresh local one only for a local master with none configured."""
    if configured:
        return configured
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir is not set: with master {master!r} intermediate tables need a "
                           "folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="shelfcast-ckpt-", dir="/tmp")


def shared_dir(spark: SparkSession) -> str:
    """Return the shared folder used for checkpoints and written tables.

    Reads the session's checkpoint directory (``spark.checkpoint.dir`` or
    one set earlier); see ``work_folder`` for a session without one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = work_folder(sc.master, sc.getConf().get("spark.checkpoint.dir"))
    sc.setCheckpointDir(folder)
    # setCheckpointDir appends a per-application subfolder.
    return sc.getCheckpointDir() or folder


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path)


def has_folders(spark: SparkSession, path: str, prefix: str) -> bool:
    """Is ``path`` a folder with folders whose names start with ``prefix``?"""
    fs, hadoop_path = _file_system(spark, path)
    return fs.exists(hadoop_path) and any(s.isDirectory() and s.getPath().getName().startswith(prefix)
                                          for s in fs.listStatus(hadoop_path))


def delete_path(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _file_system(spark, path)
    fs.delete(hadoop_path, True)


def written_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below ``path``."""
    fs, hadoop_path = _file_system(spark, path)
    return int(fs.getContentSummary(hadoop_path).getLength())


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """Tables materialized inside go to one folder, deleted at the end.

    Only for work whose result is committed elsewhere (or collected) inside:
    a lazy frame that leaves the block would lose its files.
    """
    outer = _scratch.get()
    if outer is not None:                      # part of a larger job
        yield outer
        return
    path = f"{shared_dir(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        delete_path(spark, path)


# Tasks per core of a scan whose rows are costly, so that cores do not wait for a last few tasks.
READS_PER_CORE = 4


@contextmanager
def finer_reads(spark: SparkSession) -> Iterator[None]:
    """Scans that run inside are cut into more tasks: for jobs that compute much per row they read."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    wanted = READS_PER_CORE * spark.sparkContext.defaultParallelism
    spark.conf.set(key, str(max(wanted, int(before or 0))))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _write(df: DataFrame, name: str) -> str:
    folder = _scratch.get() or shared_dir(df.sparkSession).rstrip("/")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Compute ``df`` once and cut its lineage: a parquet table in the shared folder.

    Used before iterative work (cross-validation, repeated fits) and
    before a frame is consumed by several independent branches, so a
    lost executor re-reads files instead of re-running joins.  Parquet
    (rather than a row checkpoint) lets each consumer read only the
    columns it needs, with its filters pushed into the scan.  ML column
    metadata (nominal attributes, vector sizes) is kept in the parquet
    schema.
    """
    return df.sparkSession.read.parquet(_write(df, name))


def measured(df: DataFrame, name: str = "lookup") -> tuple[DataFrame, int]:
    """Materialize a (grouped, small-ish) frame and return it with the bytes it takes in memory.

    The size comes from the written files, times ``MEMORY_PER_FILE_BYTE``,
    so the check behind a broadcast decision costs no extra pass.
    """
    spark = df.sparkSession
    path = _write(df, name)
    return spark.read.parquet(path), written_bytes(spark, path) * MEMORY_PER_FILE_BYTE
