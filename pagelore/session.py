"""Where intermediate tables go."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh one in local mode only.

    A machine-local folder would be lost with its machine, so on a cluster the
    setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="pagelore-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def create_exclusively(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already. Of several callers one gets True.

    As sure as the file system's own exclusive creation. Hadoop's local one looks first and
    creates then, so a local file is created by the operating system.
    """
    file, system = _hadoop(spark, path)
    if not system.exists(file.getParent()):
        system.mkdirs(file.getParent())
    if system.getUri().getScheme() == "file":
        try:
            os.close(os.open(file.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    try:
        return system.createNewFile(file)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def names_below(spark: SparkSession, path: str, pattern: str = "*") -> list[tuple[str, int]]:
    """Name and bytes of the files and folders below a folder that fit ``pattern``, in order of name."""
    folder, system = _hadoop(spark, path)
    found = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, pattern))
    return sorted((f.getPath().getName(), f.getLen()) for f in found or [])


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system. PySpark has no public way to list or create files where executors see them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


# Bytes of rows that a Python worker is given at once.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches for Python in bytes: by number alone, long texts make huge ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(rows: DataFrame) -> DataFrame:
    """Deal the rows of a few files out over all cores, before costly row-wise work.

    For inputs whose files do not split (one row group, a multi-line CSV): such a file
    is one task, however many rows it holds. What is read by at least as many tasks as
    there are cores, by many files or by few that split, is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
