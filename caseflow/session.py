"""Session defaults and the shared folder for checkpoints and written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own_folder: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``.  Only where that is unset (tests, a laptop) is a temporary one used.
    What is in the folder is intermediate: it is removed when the Python process ends.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that every executor can reach")
        if context.applicationId not in _own_folder:
            _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="caseflow-")
        base = _own_folder[context.applicationId]
    folder = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_made)
    _made.append((spark, folder))
    return folder


def _remove_made() -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        for spark, name in _made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(name)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back, for what is needed more than once."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core for per-row text work on an input that has fewer files than there are cores.

    A large table has more and is left alone: no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df
