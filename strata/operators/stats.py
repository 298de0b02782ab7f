"""Statistics of bytes as aggregations: histogram, entropy, entropy by position, stride."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import filters

STRIDES = (1, 2, 4, 8, 16)
#: What a finer alignment must save, in bits a byte, to be chosen.
PENALTIES = (0.0, 0.05, 0.10, 0.30, 0.60)


def histogram(df: DataFrame, group: str, payload: str) -> DataFrame:
    """(group, byte, n) over all bytes of each group; tasks count in numpy before anything is shuffled."""

    def work(batches):
        held: dict = {}
        for batch in batches:
            for g, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if x.is_valid:
                    held[g] = held.get(g, 0) + np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256)
        for g, h in held.items():
            some = np.flatnonzero(h)
            yield pa.record_batch([pa.array([g] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(h[some])], names=[group, "byte", "n"])

    d = df.select(F.col(group).cast("string").alias(group), F.col(payload).cast("binary").alias("b"))
    return d.mapInArrow(work, f"{group} string, byte int, n long").groupBy(group, "byte").agg(F.sum("n").alias("n"))


def entropy(counts: DataFrame, group: list[str], n: str = "n") -> DataFrame:
    """(group, n_bytes, entropy): bits a byte of counts (group, byte, n)."""
    total = counts.groupBy(*group).agg(F.sum(n).alias("_t"))
    p = F.col(n) / F.col("_t")
    return counts.join(total, group).groupBy(*group).agg(F.sum(n).alias("n_bytes"), (-F.sum(p * F.log2(p)) + F.lit(0.0)).alias("entropy"))


def _by_row(df: DataFrame, key: str, payload: str, of, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """key and the columns (name, Arrow type, Spark type) that of(bytes as numpy) gives, any number of rows for each row with a payload; no byte leaves its task."""

    def work(batches):
        for batch in batches:
            rows, keys = [], []
            for i, x in enumerate(batch.column(1)):
                if x.is_valid:
                    new = of(np.frombuffer(x.as_buffer(), np.uint8))
                    rows += new
                    keys += [i] * len(new)
            yield pa.record_batch([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array([r[k] for r in rows], t) for k, (_, t, _) in enumerate(columns))], names=[key, *(c for c, _, _ in columns)])

    d = df.select(key, F.col(payload).cast("binary").alias("b"))
    return d.mapInArrow(work, f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, _, t in columns))


def entropy_by_position(df: DataFrame, key: str, payload: str, strides=STRIDES) -> DataFrame:
    """(key, k, entropy): mean over the residues of pos mod k, of those there are, of the entropy of their bytes. Rows without bytes have none."""
    of = lambda x: [(k, filters.entropy_by_position(x, k)) for k in strides] if len(x) else []
    return _by_row(df, key, payload, of, [("k", pa.int32(), "int"), ("entropy", pa.float64(), "double")])


def alignment_choice(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, k, score): the alignment of least entropy by position with its penalty, rounded to 6 digits; ties go to the coarsest."""

    def of(x):
        scores = [round(round(filters.entropy_by_position(x, k), 6) + p, 6) for k, p in zip(STRIDES, PENALTIES)] if len(x) else []
        return [(STRIDES[scores.index(min(scores))], min(scores))] if scores else []

    return _by_row(df, key, payload, of, [("k", pa.int32(), "int"), ("score", pa.float64(), "double")])


def stride_mode(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, stride, n) of filters.stride() and how often it occurs; 1 and 0 where no distance is counted."""

    def of(x):
        counts = filters.distances(x)
        return [(int(counts.argmax()) if counts.any() else 1, int(counts.max()))]

    return _by_row(df, key, payload, of, [("stride", pa.int32(), "int"), ("n", pa.int64(), "long")])


def literal_modes(df: DataFrame, key: str, payload: str, distance: int = 1) -> DataFrame:
    """(key, mode): how each row's bytes are best coded as literals."""
    return _by_row(df, key, payload, lambda x: [(filters.literal_mode(x, distance),)], [("mode", pa.string(), "string")])
