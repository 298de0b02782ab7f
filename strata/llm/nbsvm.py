"""Quality classifier: a support vector machine over n-gram indicators scaled by class log-count ratios.

The features of a document are the distinct words and pairs of words in it, by their 64-bit hashes. The machine is fitted to a bounded
sample of labelled documents, in each class those SAMPLE of least md5 of their doc_id, and its vocabulary is every feature that at least
HELD documents of the sample hold: a feature that none of them holds has no weight whatever its ratio. Over all labelled documents Spark
counts, for each class, the documents that hold a feature of the vocabulary; its log-count ratio is

    r = log((ALPHA + n_good) / |ALPHA + n_good|_1) - log((ALPHA + n_bad) / |ALPHA + n_bad|_1)

A document is the vector of the r of its features, scaled to length 1, and a constant; a linear machine with hinge loss is fitted to
these by dual coordinate descent, the cost of a class being inverse to its share. A document is kept when its margin isn't negative: when
the machine puts it on the good side. Vocabulary, ratios and weights lie in the shared folder as sorted hash arrays, from which each worker
reads them; the driver holds none of them.

Defined results: a null or empty text has no features, and its margin is that of the constant; a label that is null or belongs to no
document with a text is ignored, one of several counts by its largest; of several texts of a labelled doc_id the one of least md5 is in
the sample, and each counts for the ratios; with documents of one class only, or none, all margins are 0 and all documents are kept;
repeated rows are judged each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import storage, text

ALPHA = 1.0
SAMPLE = 4000
HELD = 2
COST = 1.0
EPOCHS = 20
#: Bytes that a broadcast label takes in Spark's hash table, measured.
LABEL_BYTES = 64
_BLOCK = 1 << 20


def hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each feature and its row; a feature comes as often as it occurs."""
    w, at = text.words(column)
    pairs, at2 = text.ngrams(w, at, 2)
    n = np.arange(len(at) - 1)
    return np.concatenate([w, text.mix(pairs + text.U64(1))]), np.concatenate([np.repeat(n, np.diff(at)), np.repeat(n, np.diff(at2))])


def features(column, held: text.HashArrays) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places, in the vocabulary's arrays, of each row's features in rising order, and the n + 1 offsets of the rows."""
    h, rows = hashes(column)
    place = held.find(h)
    known = place >= 0
    key = np.sort(rows[known] * max(1, len(held.keys)) + place[known])
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key % max(1, len(held.keys)), np.searchsorted(key, np.arange(len(column) + 1) * max(1, len(held.keys)))


def ratios(good: np.ndarray, bad: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Log-count ratio of each feature."""
    p, q = alpha + good, alpha + bad
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = EPOCHS, tolerance: float = 1e-3) -> np.ndarray:
    """Weights (the last is the constant's) that minimise |w|^2 / 2 + sum of cost * max(0, 1 - y w.x), by coordinate descent on the dual.

    rows[i] are the places of document i's features, values[i] their values; the coordinates come in a new order each epoch.
    """
    w, a = np.zeros(size + 1), np.zeros(len(y))
    norm = np.array([float(v @ v) + 1 for v in values])
    order, rng = np.arange(len(y)), np.random.default_rng(0)
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            r, v = rows[i], values[i]
            g = y[i] * (v @ w[r] + w[-1]) - 1
            pg = min(g, 0) if a[i] == 0 else max(g, 0) if a[i] == cost[i] else g
            most = max(most, abs(pg))
            if pg:
                new = min(max(a[i] - g / norm[i], 0.0), cost[i])
                step = (new - a[i]) * y[i]
                a[i] = new
                w[r] += step * v
                w[-1] += step
        if most < tolerance:
            break
    return w


def _unit(r: np.ndarray) -> np.ndarray:
    n = np.sqrt(r @ r)
    return r / n if n else r


def _vocabulary(t: pa.Table) -> text.HashArrays:
    return text.HashArrays(t["key"].to_numpy().view(text.U64))


def _ratio_arrays(t: pa.Table) -> text.HashArrays:
    """Vocabulary with the ratio r beside it."""
    a = text.HashArrays(t["key"].to_numpy().view(text.U64), good=t["good"].to_numpy().astype(float), bad=t["bad"].to_numpy().astype(float))
    a.values = {"r": ratios(a.values["good"], a.values["bad"])}
    return a


class Machine:
    """Vocabulary with ratios r and weights w, and the constant's weight."""

    def __init__(self, t: pa.Table):
        one = t["constant"].to_numpy(zero_copy_only=False)
        self.constant = float(t["w"].to_numpy()[one][0])
        self.held = text.HashArrays(t["key"].to_numpy()[~one].view(text.U64), r=t["r"].to_numpy()[~one], w=t["w"].to_numpy()[~one])

    def margins(self, column) -> np.ndarray:
        place, at = features(column, self.held)
        r = self.held.values["r"][place]
        norm = np.sqrt(text.row_sums(r * r, at))
        return text.row_sums(r * self.held.values["w"][place], at) / np.where(norm > 0, norm, 1) + self.constant


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").cast("int").alias("good"))


def _sample(docs: DataFrame, labelled: DataFrame, sample: int) -> DataFrame:
    """(md5, text, good) of the bounded sample."""
    there = labelled.join(docs.where("text is not null").select("doc_id"), F.col("labelled") == F.col("doc_id"), "left_semi")
    there = storage.cut(there.withColumn("md5", F.md5(F.col("labelled").cast("string"))))
    picks = there.where("good = 1").orderBy("md5").limit(sample).unionAll(there.where("good = 0").orderBy("md5").limit(sample))
    d = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picks), F.col("doc_id") == F.col("labelled"))
    return storage.cut(d.groupBy("md5", "good").agg(F.min(F.struct(F.md5("text"), "text")).alias("d")).select("md5", "d.text", "good"))


def _distinct(batches):
    """In a worker: the distinct features of each text."""
    text.trim()
    for batch in batches:
        for _, block in text.slices(text.strings(batch.column(0)), _BLOCK):
            h, rows = hashes(block)
            order = np.lexsort((h, rows))
            h, rows = h[order], rows[order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])]) if len(h) else np.zeros(0, bool)
            yield pa.record_batch([pa.array(h[first].view(np.int64))], names=["key"])


def _counts(docs: DataFrame, labelled: DataFrame, vocabulary: str, limit: int | None) -> DataFrame:
    """(key, good, bad): documents of each class that hold each feature of the vocabulary, over all labelled documents."""

    def work(batches):
        text.trim()
        a = storage.held(vocabulary, _vocabulary)
        counts = np.zeros((2, len(a.keys)), np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy()
            for first, block in text.slices(text.strings(batch.column(0)), _BLOCK):
                place, at = features(block, a)
                which = np.repeat(good[first : first + len(block)], np.diff(at))
                for c in (0, 1):
                    counts[c] += np.bincount(place[which == c], minlength=len(a.keys))
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.record_batch([pa.array(a.keys[some].view(np.int64)), pa.array(counts[1][some]), pa.array(counts[0][some])], names=["key", "good", "bad"])

    if labelled.count() * LABEL_BYTES <= (storage.BROADCAST_BYTES if limit is None else limit):
        labelled = F.broadcast(labelled)
    d = docs.select("doc_id", "text").where("text is not null").join(labelled, F.col("doc_id") == F.col("labelled")).select("text", "good")
    return d.mapInArrow(work, "key long, good long, bad long").groupBy("key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def _folder(df: DataFrame, what: str) -> str:
    folder = storage.new_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return folder


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = HELD, limit: int | None = None) -> str | None:
    """The folder of the machine's arrays, or None with documents of one class only; fitted in one task, to the bounded sample."""
    labelled = storage.cut(_labelled(labels))
    rows = _sample(docs, labelled, sample)
    if rows.select("good").distinct().count() < 2:
        return None
    seen = rows.select("text").mapInArrow(_distinct, "key long").groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") >= held).select("key")
    vocabulary = _folder(seen, "vocabulary")
    counted = _folder(_counts(docs, labelled, vocabulary, limit), "ratios")

    def places(batches):
        text.trim()
        a = storage.held(counted, _ratio_arrays)
        for batch in batches:
            place, at = features(text.strings(batch.column(1)), a)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(place.astype(np.int32))), batch.column(2)], names=["md5", "place", "good"])

    def solve(t: pa.Table) -> pa.Table:
        a = storage.held(counted, _ratio_arrays)
        t = t.sort_by([("md5", "ascending")])
        y = np.where(t["good"].to_numpy() == 1, 1, -1)
        at = [np.asarray(x.values, np.int64) for x in t["place"]]
        vectors = [_unit(a.values["r"][p]) for p in at]
        cost = np.array([COST * len(y) / (2 * int((y == c).sum())) for c in y])
        w = dual_descent(at, vectors, y, cost, len(a.keys))
        keys = np.append(a.keys.view(np.int64), 0)
        return pa.table({"key": keys, "r": np.append(a.values["r"], 0.0), "w": w, "constant": np.arange(len(w)) == len(w) - 1})

    solved = rows.mapInArrow(places, "md5 string, place array<int>, good int").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(solve, "key long, r double, w double, constant boolean")
    return _folder(solved, "machine")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held: int = HELD, limit: int | None = None) -> DataFrame:
    """(doc_id, margin, keep) of every row; margin is rounded to 6 digits."""
    machine = fit(docs, labels, sample, held, limit)

    def work(batches):
        text.trim()
        for batch in batches:
            ids, texts = batch.column(0), text.strings(batch.column(1))
            for first, block in text.slices(texts, _BLOCK):
                m = np.zeros(len(block)) if machine is None else np.round(storage.held(machine, Machine).margins(block), 6)
                yield pa.record_batch([ids.slice(first, len(block)), pa.array(m), pa.array(m >= 0)], names=["doc_id", "margin", "keep"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, margin double, keep boolean")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
