"""The folder that all executors share, and cuts of lineage in it."""

from __future__ import annotations

import ctypes
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Most rows and bytes of an Arrow batch: what a task holds of the payloads at once, in the JVM and in Python, follows from them.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let the session, from now on, send at most BATCH_ROWS rows and about BATCH_BYTES bytes to Python at once; smaller bounds stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(name)) or 0) <= most:
            spark.conf.set(name, most)


def trim() -> None:
    """In a worker, at the start of a task: give back to the system what earlier tasks have freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def stretches(sizes, most: int = BATCH_BYTES):
    """(first, last + 1) of rows of these sizes, in order: at most about `most` bytes in each, or one row that is larger."""
    first = held = at = 0
    for at, n in enumerate(sizes):
        if at > first and held + n > most:
            yield first, at
            first, held = at, 0
        held += n
    if len(sizes):
        yield first, at + 1


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only where that is unset and the master is local."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strata-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there: what is random in it is settled, and executors may be lost."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
