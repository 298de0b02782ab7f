"""Deduplication: first occurrences of equal chunks, references to them, and runs of references made one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_CHUNK, LEAST_REFERENCE = 512, 32


def first_occurrence(chunks: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """chunks with `original`, the least position of an equal one. The minimum is aggregated before it is joined, so that a hot key is one row."""
    first = chunks.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.min(pos).alias("original"))
    return chunks.join(first, [F.col(k) == F.col(f"_{k}") for k in key]).drop(*(f"_{k}" for k in key))


def first_by_window(chunks: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """first_occurrence() in one shuffle instead of two: for many narrow chunks, most of which occur once. Keys must not be null."""
    return chunks.withColumn("original", F.min(pos).over(Window.partitionBy(*key)))


def coalesce_references(refs: DataFrame, group: list[str], copy: str = "copy_pos", original: str = "original_pos", length: str = "length") -> DataFrame:
    """References that follow each other on both sides within a group, as one: (group, copy, original, length, parts)."""
    w = Window.partitionBy(*group).orderBy(copy)
    begins = (F.lag(F.col(copy) + F.col(length)).over(w) != F.col(copy)) | (F.lag(F.col(original) + F.col(length)).over(w) != F.col(original))
    marked = refs.withColumn("_new", F.coalesce(begins, F.lit(True)).cast("int"))
    islands = marked.withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(*group, "_island").agg(F.min(copy).alias(copy), F.min(original).alias(original), F.sum(length).cast("long").alias(length), F.count("*").alias("parts")).drop("_island")


def delta_positions(refs: DataFrame, group: list[str], copy: str = "copy_pos", length: str = "length") -> DataFrame:
    """With copy_delta: the distance from the end of the reference before it in its group."""
    w = Window.partitionBy(*group).orderBy(copy)
    return refs.withColumn("copy_delta", (F.col(copy) - F.coalesce(F.lag(F.col(copy) + F.col(length)).over(w), F.lit(0))).cast("long"))


def undelta_positions(refs: DataFrame, group: list[str], order: str, length: str = "length") -> DataFrame:
    """Inverse of delta_positions(): copy_pos from copy_delta, by a running sum."""
    w = Window.partitionBy(*group).orderBy(order)
    return refs.withColumn("copy_pos", (F.sum(F.col("copy_delta") + F.col(length)).over(w) - F.col(length)).cast("long"))


def differences(df: DataFrame, group: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """With `delta`, the k-th difference of a column along a group's order; what lies before the start counts as 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    lag = lambda i: F.coalesce(F.lag(value, i).over(w), F.lit(0))
    terms = {1: F.col(value) - lag(1), 2: F.col(value) - 2 * lag(1) + lag(2), 3: F.col(value) - 3 * lag(1) + 3 * lag(2) - lag(3)}
    return df.withColumn("delta", terms[k])


def undifferences(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """With `restored`, the column whose k-th difference is `delta`: k running sums."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("restored", F.col("delta"))
    for _ in range(k):
        out = out.withColumn("restored", F.sum("restored").over(w))
    return out


def mark_references(chunks: DataFrame, window: int | None = None) -> DataFrame:
    """Chunks (length, hash, global_pos) as literals or references: with original_pos, null for literals.

    Chunks under LEAST_CHUNK bytes stay literal. The least position wins, so a referenced range is always literal itself.
    With a window, the equal chunks are taken in stretches of so many bytes from the first of them on, and refer to the first of their
    stretch: so each reference reaches less than the window back, and what it refers to is literal.
    """
    big = first_occurrence(chunks.where(F.col("length") >= LEAST_CHUNK), ["hash", "length"], "global_pos")
    if window is not None:
        big = big.withColumn("_stretch", F.floor((F.col("global_pos") - F.col("original")) / window)).drop("original")
        big = first_occurrence(big, ["hash", "length", "_stretch"], "global_pos").drop("_stretch")
    big = big.withColumn("original_pos", F.when(F.col("original") < F.col("global_pos"), F.col("original"))).drop("original")
    return big.unionByName(chunks.where(F.col("length") < LEAST_CHUNK).withColumn("original_pos", F.lit(None).cast("long")))
