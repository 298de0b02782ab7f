"""Packing: training windows of the documents in order, cut by dynamic programming.

The documents, in order of doc_id, are one sequence of words (runs of characters other than ASCII white space). It may be cut at the end
of a document for nothing, at the end of a sentence (a word that ends in . ! or ?, or a line end after a word) for SENTENCE, and, only
in sentences of more than WINDOW words, after every WINDOW words for HARD. Of all ways to cut it into windows of at most WINDOW words,
the one of least total cost is taken, the cost of a window being the words of padding it needs and that of the cut at its end. With P
the words before each cut and f(j) the least cost up to cut j,

    f(j) = cut(j) + WINDOW - P(j) + min of f(i) + P(i) over i < j with P(j) - P(i) <= WINDOW

so that the minimum is that of a sliding window, kept in a monotone queue: the work is linear in the number of cuts. Of equal ones, the
earliest i is taken, which makes the longest window.

The sequence is divided into shards: a document belongs to the shard that its first word's place in the whole sequence, divided by SHARD,
gives. Each is one task's work and optimal for itself; it ends with a cut that costs nothing, so that what sharding can cost is less than
one window in SHARD / WINDOW. Places are a prefix sum in two passes: the measured documents are range-partitioned in order, and the sums of
the partitions, a number for each, are added to those within. So the windows follow from the documents and their order alone, not from the
values of doc_id or the partitions.

Defined results: a document without words, or with a null text, is in no window; documents with a null doc_id come before the others;
doc_id may be of any type that can be ordered; several rows with one doc_id follow each other in the order of their texts' hashes; a
document of more than SHARD words isn't divided between shards; an empty table gives no window; other columns are ignored.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import storage, text

WINDOW = 2048
SENTENCE = 64
HARD = 512
SHARD = 1 << 22
_BLOCK = 4 << 20
_NOT_SPACE = ~text._IS_SPACE


def sentences(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths in words of the sentences of all rows, the n + 1 offsets of the rows into them, and the rows' words."""
    flat, off = text.raw_bytes(text.strings(column))
    starts, ends, at = text.runs(flat, off, _NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64), np.diff(at)
    stop = np.isin(flat[ends - 1], np.frombuffer(b".!?", np.uint8))
    lines = np.concatenate([[0], np.cumsum(np.isin(flat, np.frombuffer(b"\n\r", np.uint8)))])
    nxt = np.append(starts[1:], len(flat))
    stop |= lines[nxt] > lines[ends]
    last = at[1:][np.diff(at) > 0] - 1
    stop[last] = True
    cuts = np.flatnonzero(stop)
    lengths = np.diff(np.concatenate([[-1], cuts]))
    return lengths, np.searchsorted(cuts, at), np.diff(at)


def cut_points(lengths: list[int], window: int) -> tuple[list[int], list[bool]]:
    """Sentences cut into pieces of at most `window` words, and which of the pieces' ends are hard cuts."""
    pieces, hard = [], []
    for n in lengths:
        while n > window:
            pieces.append(window)
            hard.append(True)
            n -= window
        pieces.append(n)
        hard.append(False)
    return pieces, hard


def best_cuts(pieces: list[int], costs: list[float], window: int) -> tuple[list[int], float]:
    """Places 1..n at which to cut, and the least total cost; pieces have at most `window` words, costs are those of cuts after them."""
    queue = deque([(0, 0, 0.0)])  # (place, words before it, f + words), the last rising
    before = [0] * (len(pieces) + 1)
    words, f = 0, 0.0
    for j, n in enumerate(pieces, 1):
        words += n
        least = words - window
        while queue[0][1] < least:
            queue.popleft()
        i, _, g = queue[0]
        before[j] = i
        f = costs[j - 1] - least + g
        g = f + words
        while queue and queue[-1][2] > g:
            queue.pop()
        queue.append((j, words, g))
    cuts, j = [], len(pieces)
    while j:
        cuts.append(j)
        j = before[j]
    return cuts[::-1], f


def pack_shard(docs: list[tuple[int | None, list[int]]], window: int = WINDOW, sentence: float = SENTENCE, hard: float = HARD) -> list[tuple[int, list, list, list]]:
    """(words, doc_ids, starts, ends) of each window of a sequence of documents, given as lengths of sentences."""
    pieces, costs, of, begins = [], [], [], []
    for k, (_, lengths) in enumerate(docs):
        p, h = cut_points(lengths, window)
        pieces += p
        costs += [hard if x else sentence for x in h]
        costs[-1] = 0.0
        of += [k] * len(p)
        at = 0
        for n in p:
            begins.append(at)
            at += n
    if not pieces:
        return []
    out, i = [], 0
    for j in best_cuts(pieces, costs, window)[0]:
        ids, starts, ends = [], [], []
        while i < j:
            k, begin = of[i], begins[i]
            while i < j and of[i] == k:
                end = begins[i] + pieces[i]
                i += 1
            ids.append(docs[k][0])
            starts.append(begin)
            ends.append(end)
        out.append((sum(ends) - sum(starts), ids, starts, ends))
    return out


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, words, lengths) of each document that has words; lengths are those of its sentences."""

    def work(batches):
        text.trim()
        for batch in batches:
            texts, ids, key = (batch.column(i) for i in range(3))
            for first, block in text.slices(text.strings(texts), _BLOCK):
                lengths, at, words = sentences(block)
                rows = np.flatnonzero(words)
                sizes = np.concatenate([[0], np.cumsum(np.diff(at)[rows])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(lengths.astype(np.int32)))
                take = pa.array(first + rows)
                yield pa.record_batch([ids.take(take), key.take(take), pa.array(words[rows].astype(np.int64)), lists], names=["doc_id", "tie", "words", "lengths"])

    d = docs.select("text", "doc_id", F.xxhash64("text").alias("tie")).where("text is not null")
    return d.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie long, words long, lengths array<int>")


def placed(measured: DataFrame) -> DataFrame:
    """(at, doc_id, lengths): at is the number of words in all documents before, in order of doc_id and tie."""
    spark = measured.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = measured.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("part", F.spark_partition_id())
    ranged, before, upto = storage.cut(ranged), {}, 0
    for r in ranged.groupBy("part").agg(F.sum("words").alias("words")).orderBy("part").collect():  # a row a partition
        before[r["part"]], upto = upto, upto + r["words"]

    def work(batches):
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                at = before[batch.column("part")[0].as_py()]
            words = batch.column("words").to_numpy()
            ends = at + np.cumsum(words)
            at = int(ends[-1])
            yield pa.record_batch([pa.array(ends - words), batch.column("doc_id"), batch.column("lengths")], names=["at", "doc_id", "lengths"])

    return ranged.mapInArrow(work, f"at long, doc_id {measured.schema['doc_id'].dataType.simpleString()}, lengths array<int>")


def pack(docs: DataFrame, window: int = WINDOW, sentence: float = SENTENCE, hard: float = HARD, shard: int = SHARD) -> DataFrame:
    """(shard, window, n_words, padding, doc_ids, starts, ends) of each window; starts and ends are places of words in the documents."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        rows = pack_shard(list(zip(t["doc_id"].to_pylist(), t["lengths"].to_pylist())), window, sentence, hard)
        n = len(rows)
        used = [r[0] for r in rows]
        lists = [pa.array([r[k] for r in rows], pa.list_(kind)) for k, kind in ((1, t.schema.field("doc_id").type), (2, pa.int64()), (3, pa.int64()))]
        of = pa.array([t["shard"][0].as_py()] * n, pa.int64())
        return pa.table([of, pa.array(range(n), pa.int32()), pa.array(used, pa.int32()), pa.array([window - x for x in used], pa.int32()), *lists], names=["shard", "window", "n_words", "padding", "doc_ids", "starts", "ends"])

    schema = f"shard long, window int, n_words int, padding int, doc_ids array<{docs.schema['doc_id'].dataType.simpleString()}>, starts array<long>, ends array<long>"
    rows = placed(storage.table(measure(docs), "measured"))
    return rows.withColumn("shard", F.floor(F.col("at") / F.lit(shard)).cast("long")).groupBy("shard").applyInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
