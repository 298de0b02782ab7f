"""The shared folder: where lineage is cut and intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.shared import bound_batches

#: Largest number of bytes that is broadcast; beyond it the callers join by shuffle.
BROADCAST_BYTES = 192 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    bound_batches(spark)
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    known = sc.getCheckpointDir()
    if known is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strata-"))
        known = sc.getCheckpointDir()
    return known


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of df: its rows are written to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: 64-bit words of the bit field of sieve(): 8 MiB at most.
FIELD = 1 << 20


def sieve(df: DataFrame, column: str, keys: DataFrame, key: str, most: int = FIELD) -> DataFrame:
    """Rows of df whose column is among the keys, and a few others: what a join with the keys needs not shuffle is left out.

    The keys are marked in a field of bits, one row that is broadcast, of 16 bits a key but never more than `most` words: with more keys
    it lets more through, in the end everything.
    """
    words = max(1, min(most, keys.count() // 4 + 1))
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(64 * words))
    marked = keys.select(place(key).alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("b"))
    every = df.sparkSession.range(words).join(marked, F.col("id") == F.col("w"), "left").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("x"))
    field = table(every.select(F.transform("x", lambda y: y["b"]).alias("_field")), "field")
    bit = F.expr(f"shiftright(get(_field, CAST(pmod(xxhash64(`{column}`), {64 * words}L) div 64 AS INT)), CAST(pmod(xxhash64(`{column}`), {64 * words}L) % 64 AS INT)) & 1 = 1")
    return df.crossJoin(F.broadcast(field)).where(F.col(column).isNotNull() & bit).drop("_field")


_HELD: dict[str, object] = {}


def read_arrays(folder: str):
    """In a worker: the table of a folder that Spark wrote, kept for the next tasks."""
    from pyarrow import dataset, fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return dataset.dataset(path, filesystem=system, format="parquet").to_table()


def held(folder: str, build):
    """In a worker: build(table of the folder), once for each worker."""
    if folder not in _HELD:
        import pyarrow as pa

        _HELD.clear()
        _HELD[folder] = build(read_arrays(folder))
        pa.default_memory_pool().release_unused()
    return _HELD[folder]


def table(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder as Parquet, and read from there."""
    folder = new_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
