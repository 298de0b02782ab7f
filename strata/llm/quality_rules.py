"""Quality rule: character n-gram perplexity under a modified Kneser-Ney model of each language.

The n-grams of every document are counted per language (a task adds up its own before anything is shuffled), Spark joins and
aggregates turn the counts into probabilities, and the finished model is held in sorted hash arrays. A document is rejected when its
mean negative log-probability x lies outside its language's band

    median - low * (s + e)  <=  x  <=  median + high * (s + e),    s = max(1.4826 * MAD, 0.001),  e = sigma / sqrt(n)

where median and MAD are those of x over all documents of the language (x rounded to 4 digits, so that they can be had from a
histogram), sigma is the standard deviation of a single n-gram's log-probability and n the number of n-grams of the document: short
documents get the wider band that their sampling error calls for.

Defined results: a null language is a language of its own; a null or empty text, or one shorter than n characters, has no n-gram, a
null perplexity and is kept; a language with one document has that document as its median and keeps it; repeated rows are scored each
for itself; an empty table gives an empty result; other columns are carried through by filter_documents and ignored by quality_rules.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import storage, text

ORDER = 5
LOW = 4.0
HIGH = 5.0
_BLOCK = 1 << 19
#: Bytes of texts that ask for their n-grams together where the arrays are in parts.
BLOCK_BYTES = 8 << 20
_COUNTS = "lang string, gram string, c long"


def _encode(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    n, m = points.shape
    sizes = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(axis=1)
    data = np.ascontiguousarray(points, "<u4").tobytes().decode("utf-32-le").encode("utf-8")
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(off), pa.py_buffer(data)) if n else pa.array([], pa.string())


def _valid(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the windows of n code points lie in one row."""
    keep = np.ones(size, bool)
    for k in range(1, n):
        x = at[1:] - k
        keep[x[(x >= 0) & (x < size)]] = False
    return keep


def _by_lang(batch: pa.RecordBatch):
    """(language, rows, their texts), the texts in blocks."""
    langs = batch.column("lang").cast(pa.string())
    texts = text.strings(batch.column("text"))
    for lang in pc.unique(langs).to_pylist():
        rows = pc.indices_nonzero(pc.is_null(langs) if lang is None else pc.fill_null(pc.equal(langs, lang), False)).to_numpy()
        part = texts.take(pa.array(rows))
        for first, block in text.slices(part, _BLOCK):
            yield lang, rows[first : first + len(block)], block


class _Counter:
    """n-grams of one task by language, packed into integers as long as the alphabet allows."""

    def __init__(self, n: int):
        self.n, self.bits = n, 63 // n
        self.clear()

    def clear(self):
        self.rank = np.full(0x110000, -1, np.int64)
        self.alphabet = np.zeros(0, np.uint32)
        self.held: dict[str | None, list] = {}

    def fits(self, seen: np.ndarray) -> bool:
        new = seen[self.rank[seen] < 0]
        if len(self.alphabet) + len(new) > 1 << self.bits:
            return False
        self.rank[new] = np.arange(len(self.alphabet), len(self.alphabet) + len(new))
        self.alphabet = np.concatenate([self.alphabet, new.astype(np.uint32)])
        return True

    def add(self, lang: str | None, points: np.ndarray, at: np.ndarray):
        """Count a block; yields batches that must leave because the alphabet is full."""
        n, size = self.n, len(points) - self.n + 1
        if size <= 0:
            return
        keep = _valid(at, size, n)
        seen = np.flatnonzero(np.bincount(points))
        if not self.fits(seen):
            yield from self.flush()
            if not self.fits(seen):
                h = text.mix(_fold([points[i : size + i] for i in range(n)], 0))
                where = np.flatnonzero(keep)
                _, first, c = np.unique(h[where], return_index=True, return_counts=True)
                yield _batch(lang, points[where[first][:, None] + np.arange(n)], c)
                self.clear()
                return
        r = self.rank[points]
        key = r[:size].copy()
        for i in range(1, n):
            key <<= self.bits
            key |= r[i : size + i]
        key = np.sort(key[keep])
        if len(key):
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            held = self.held.setdefault(lang, [])
            held.append((key[edge], np.diff(np.concatenate([edge, [len(key)]]))))
            if sum(len(k) for k, _ in held) > max(1 << 20, 2 * len(held[0][0])):
                self.held[lang] = [_merge(held)]

    def flush(self):
        for lang, held in self.held.items():
            key, c = _merge(held)
            digits = np.stack([(key >> (self.bits * (self.n - 1 - i))) & ((1 << self.bits) - 1) for i in range(self.n)], axis=1)
            for i in range(0, len(key), 100_000):
                yield _batch(lang, self.alphabet[digits[i : i + 100_000]], c[i : i + 100_000])
        self.clear()


def _merge(held: list) -> tuple[np.ndarray, np.ndarray]:
    key, c = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    order = np.argsort(key, kind="stable")
    key, c = key[order], c[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[edge], np.add.reduceat(c, edge) if len(edge) else c


def _batch(lang: str | None, points: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(c), np.int32))), _encode(points), pa.array(c.astype(np.int64))], names=["lang", "gram", "c"])


def count_ngrams(docs: DataFrame, n: int = ORDER) -> DataFrame:
    """(lang, gram, c) over all documents."""

    def work(batches):
        text.trim()
        counter = _Counter(n)
        for batch in batches:
            for lang, _, block in _by_lang(batch):
                yield from counter.add(lang, *text.code_points(block))
        yield from counter.flush()

    return docs.select("lang", "text").mapInArrow(work, _COUNTS).groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discounts(levels: dict[int, DataFrame]) -> DataFrame:
    """(lang_, m, v, d1, d2, d3): n-grams of each order and language, their modified Kneser-Ney discounts from the counts of counts; where these say nothing, 0.5, 1 and 1.5."""
    n = [F.count(F.when(F.col("c") == i, 1)).cast("double") for i in (1, 2, 3, 4)]
    every = reduce(DataFrame.unionAll, (level.select("lang", F.lit(m).alias("m"), "c") for m, level in levels.items()))
    t = every.groupBy("lang", "m").agg(F.count("*").alias("v"), *(x.alias(f"n{i}") for i, x in enumerate(n, 1)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    safe = lambda i, other: F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(F.lit(other))
    bound = lambda i, other: F.greatest(F.lit(0.0), F.least(F.lit(float(i)), F.coalesce(safe(i, other), F.lit(other))))
    return storage.table(t.select(F.col("lang").alias("lang_"), "m", "v", bound(1, 0.5).alias("d1"), bound(2, 1.0).alias("d2"), bound(3, 1.5).alias("d3")), "discounts")


def model_table(counts: DataFrame, n: int = ORDER) -> DataFrame:
    """(lang, gram, m, logp, logb) of all n-grams of 0 to n characters: log-probability of the last given those before, and log of the mass that gram, as a context, leaves to its backoff.

    The lower orders count distinct left neighbours. The empty gram has the uniform distribution that the single characters back off to.
    Each step is a table of its own, so that the driver has no plan of many joins to hold and to work out again as its parts end.
    """
    levels = {n: counts.select("lang", "gram", "c")}
    for m in range(n - 1, 0, -1):
        levels[m] = storage.table(levels[m + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c")), "level")
    discounts = _discounts(levels)
    lower = discounts.where("m = 1").select(F.col("lang_").alias("lang"), F.lit("").alias("gram"), (1 / F.col("v")).alias("p"))
    none = F.lit(None).cast("double")
    rows = []
    for m in range(1, n + 1):
        d = levels[m].join(F.broadcast(discounts.where(F.col("m") == m).drop("m", "v")), F.col("lang").eqNullSafe(F.col("lang_"))).drop("lang_")
        d = d.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = F.substring("gram", 1, m - 1) if m > 1 else F.lit("")
        d = d.select("lang", "gram", "c", "d", context.alias("ctx"), (F.substring("gram", 2, m) if m > 1 else F.lit("")).alias("suffix"))
        totals = d.groupBy(F.col("lang").alias("tl"), F.col("ctx").alias("tc")).agg(F.sum("c").alias("total"), F.sum("d").alias("left"))
        totals = storage.table(totals.select("tl", "tc", "total", (F.col("left") / F.col("total")).alias("b")), "contexts")
        p = d.join(totals, F.col("lang").eqNullSafe(F.col("tl")) & (F.col("ctx") == F.col("tc")))
        low = lower.select(F.col("lang").alias("ll"), F.col("gram").alias("lg"), F.col("p").alias("lp"))
        p = p.join(low, F.col("lang").eqNullSafe(F.col("ll")) & (F.col("suffix") == F.col("lg")))
        rows.append(lower.select("lang", "gram", F.lit(m - 1).alias("m"), F.log("p").alias("logp"), none.alias("logb")))
        rows.append(totals.select("tl", "tc", F.lit(m - 1), none, F.log("b")))
        lower = storage.table(p.select("lang", "gram", ((F.col("c") - F.col("d")) / F.col("total") + F.col("b") * F.col("lp")).alias("p")), "probabilities")
    shorter = reduce(DataFrame.unionAll, rows).groupBy("lang", "gram", "m").agg(F.max("logp").alias("logp"), F.max("logb").alias("logb")).where("logp is not null")
    return shorter.unionAll(lower.select("lang", "gram", F.lit(n), F.log("p"), none))


def _fold(points: list[np.ndarray], seed: int) -> np.ndarray:
    h = points[0].astype(text.U64)
    h += text.U64(seed)
    for p in points[1:]:
        h *= text.U64(text._P)
        h += p
    return h


def _gram_hash(points: list[np.ndarray], seed: int, m: int) -> np.ndarray:
    seed = (seed + m * 0x632BE59BD9B4E019) % (1 << 64)
    return text.mix(_fold(points, seed)) if points else np.array([seed], text.U64)


def _hashed(table: DataFrame) -> DataFrame:
    """(key, logp, logb) of a model_table()."""

    def work(batches):
        text.trim()
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, orders = batch.column("lang"), batch.column("m").to_numpy()
            key = np.zeros(batch.num_rows, text.U64)
            for lang in pc.unique(langs).to_pylist():
                own = (pc.is_null(langs) if lang is None else pc.fill_null(pc.equal(langs, lang), False)).to_numpy(zero_copy_only=False)
                for m in np.unique(orders[own]):
                    rows = np.flatnonzero(own & (orders == m))
                    points, _ = text.code_points(text.strings(batch.column("gram").take(pa.array(rows))))
                    points = points.reshape(len(rows), m)
                    key[rows] = _gram_hash([points[:, i] for i in range(m)], text.seed_of(lang), int(m))
            yield pa.record_batch([pa.array(key.view(np.int64)), batch.column("logp"), batch.column("logb")], names=["key", "logp", "logb"])

    return table.mapInArrow(work, "key long, logp double, logb double")


class Model:
    """The sorted hash arrays of a model_table(), as a worker holds them."""

    def __init__(self, table: pa.Table, n: int):
        self.n = n
        self.arrays = text.HashArrays(table["key"].to_numpy().view(text.U64), logp=table["logp"].to_numpy(), logb=np.nan_to_num(table["logb"].to_numpy().astype(float)))

    def score(self, lang: str | None, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each window of n code points, 0 where the window crosses rows; whether it lies in one row."""
        n, size, seed = self.n, max(0, len(points) - self.n + 1), text.seed_of(lang)
        keep = _valid(at, size, n)
        logp = np.zeros(size)
        if not size:
            return logp, keep
        place = self.arrays.find(_gram_hash([points[i : size + i] for i in range(n)], seed, n))
        values = self.arrays.values
        held = keep & (place >= 0)
        logp[held] = values["logp"][place[held]]
        todo, m = np.flatnonzero(keep & (place < 0)), n
        while len(todo):
            first = todo + (n - m)
            ctx = self.arrays.find(np.broadcast_to(_gram_hash([points[first + i] for i in range(m - 1)], seed, m - 1), len(todo)))
            logp[todo] += np.where(ctx >= 0, values["logb"][ctx], 0)
            m -= 1
            at_m = self.arrays.find(np.broadcast_to(_gram_hash([points[first + 1 + i] for i in range(m)], seed, m), len(todo)))
            logp[todo] += np.where(at_m >= 0, values["logp"][at_m], 0 if m else -20.0)
            todo = todo[at_m < 0] if m else todo[:0]
        return logp, keep


def _score_batch(model: Model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of n-grams, sum of log-probabilities and of their squares, for each row."""
    out = np.zeros((3, batch.num_rows))
    for lang, rows, block in _by_lang(batch):
        points, at = text.code_points(block)
        logp, keep = model.score(lang, points, at)
        cut = np.minimum(at, len(logp))
        for i, x in enumerate((keep.astype(float), logp, logp * logp)):
            out[i, rows] = text.row_sums(x, cut)
    return out[0].astype(np.int64), out[1], out[2]


class Scores:
    """How documents are scored: by sorted hash arrays that every worker holds or, where those are too large, by parts of the arrays.

    The arrays of the longest n-grams, which hold every n-gram of the documents counted, are then cut by the leading bits of the hash into
    parts of at most `limit` bytes. The texts are taken in blocks of about BLOCK_BYTES; a block asks each part once for all its distinct
    n-grams, and what comes back is put together with its texts. So no worker holds more than a part, and what is shuffled beside
    the texts is 8 bytes there and back for each distinct n-gram of a block, not for each of a text.
    """

    def __init__(self, docs: DataFrame, n: int = ORDER, limit: int | None = None):
        spark, self.n = docs.sparkSession, n
        self.table = storage.table(model_table(storage.table(count_ngrams(docs, n), "counts"), n), "model")
        size, limit = self.table.count() * 24, storage.BROADCAST_BYTES if limit is None else limit
        self.bits = 0 if size <= limit else max(1, int(np.ceil(np.log2(size / limit)))) if limit else 2
        self.shared = storage.new_folder(spark, "ngrams")
        if self.bits:
            rows = _hashed(self.table.where(F.col("m") == n)).withColumn("part", F.shiftrightunsigned("key", 64 - self.bits).cast("int"))
            rows.repartition(1 << self.bits, "part").write.partitionBy("part").parquet(self.shared)
        else:
            _hashed(self.table).sort(F.col("key") < 0, "key").write.parquet(self.shared)

    def by_parts(self, docs: DataFrame) -> DataFrame:
        """(lang, key, n, s, q) of each distinct text; key is its hash. The documents must be those that were counted."""
        n, bits, folder, spark = self.n, self.bits, self.shared, docs.sparkSession
        d = docs.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("key")).where("text is not null")
        size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        d = d.withColumn("block", F.pmod(F.xxhash64("lang", "key"), F.lit(size // BLOCK_BYTES + 1)))

        def hashes(t: pa.Table):
            """(language, rows, hashes of the windows in one row each, the rows' offsets into them) in turn, and all distinct hashes."""
            out = []
            for lang, rows, block in _by_lang(t.select(["lang", "text"]).combine_chunks().to_batches()[0]):
                points, at = text.code_points(block)
                size = max(0, len(points) - n + 1)
                keep = _valid(at, size, n)
                h = _gram_hash([points[i : size + i] for i in range(n)], text.seed_of(lang), n)[keep] if size else np.zeros(0, text.U64)
                out.append((lang, rows, h, np.concatenate([[0], np.cumsum(keep)])[np.minimum(at, size)]))
            return out, np.unique(np.concatenate([h for _, _, h, _ in out])) if out else np.zeros(0, text.U64)

        def ask(t: pa.Table) -> pa.Table:
            text.trim()
            distinct = hashes(t)[1]
            cuts = np.searchsorted(distinct >> text.U64(64 - bits), np.arange((1 << bits) + 1, dtype=text.U64))
            some = np.flatnonzero(np.diff(cuts))
            return pa.table({"block": pa.array([t["block"][0].as_py()] * len(some), pa.int64()), "part": pa.array(some.astype(np.int32)), "grams": pa.array([distinct[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())})

        def answer(batches):
            text.trim()
            for batch in batches:
                out = []
                for part, grams in zip(batch.column("part").to_pylist(), batch.column("grams").to_pylist()):
                    arrays = storage.held(f"{folder}/part={part}", lambda t: text.HashArrays(t["key"].to_numpy().view(text.U64), logp=t["logp"].to_numpy()))
                    out.append(arrays.values["logp"][arrays.find(np.frombuffer(grams, text.U64))].tobytes())
                yield pa.record_batch([batch.column("block"), batch.column("part"), pa.array(out, pa.binary())], names=["block", "part", "logp"])

        def total(t: pa.Table, answers: pa.Table) -> pa.Table:
            text.trim()
            parts, distinct = hashes(t)
            logp = np.frombuffer(b"".join(answers.sort_by("part")["logp"].to_pylist()), float)
            sums = np.zeros((3, t.num_rows))
            for _, rows, h, at in parts:
                x = logp[np.searchsorted(distinct, h)]
                for i, v in enumerate((np.ones(len(x)), x, x * x)):
                    sums[i, rows] = text.row_sums(v, at)
            out = pa.table({"lang": t["lang"], "key": t["key"], "n": sums[0].astype(np.int64), "s": sums[1], "q": sums[2]}).combine_chunks()
            once = list({(a, b): i for i, (a, b) in enumerate(zip(out["lang"].to_pylist(), out["key"].to_pylist()))}.values())
            return out.take(pa.array(once, pa.int64()))

        spread = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) >> bits)
        asked = d.groupBy("block").applyInArrow(ask, "block long, part int, grams binary")
        answers = asked.repartition(spread << bits, "part", F.pmod("block", F.lit(spread))).sortWithinPartitions("part").mapInArrow(answer, "block long, part int, logp binary")
        return d.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, "lang string, key long, n long, s double, q double")


def score(docs: DataFrame, scores: Scores) -> DataFrame:
    """(doc_id, lang, n, s, q): n-grams, sum of log-probabilities and of squares of each row."""
    if scores.bits:
        rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("key"))
        by = scores.by_parts(docs).select(F.col("lang").alias("sl"), F.col("key").alias("sk"), "n", "s", "q")
        joined = rows.join(by, F.col("lang").eqNullSafe(F.col("sl")) & (F.col("key") == F.col("sk")), "left")
        return joined.select("doc_id", "lang", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("q", F.lit(0.0)).alias("q"))

    shared, order = scores.shared, scores.n

    def work(batches):
        text.trim()
        for batch in batches:
            n, s, q = _score_batch(storage.held(shared, lambda t: Model(t, order)), batch)
            yield pa.record_batch([batch.column("doc_id"), batch.column("lang").cast(pa.string()), pa.array(n), pa.array(s), pa.array(q)], names=["doc_id", "lang", "n", "s", "q"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, n long, s double, q double"
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(work, schema)


def bands(scored: DataFrame) -> DataFrame:
    """(lang, median, spread, sigma) over all documents of each language that have an n-gram."""
    x = scored.where("n > 0").withColumn("x", F.round(-F.col("s") / F.col("n"), 4))
    bins = storage.table(x.groupBy("lang", "x").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "bins")
    mean = F.sum("s") / F.sum("n")
    centre = bins.groupBy("lang").agg(F.expr("percentile(x, 0.5, k)").alias("median"), F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / F.sum("n") - mean * mean)).alias("sigma")).withColumnRenamed("lang", "cl")
    off = bins.join(F.broadcast(centre), F.col("lang").eqNullSafe(F.col("cl"))).withColumn("off", F.round(F.abs(F.col("x") - F.col("median")), 5))
    spread = off.groupBy("lang", "median", "sigma").agg(F.expr("percentile(off, 0.5, k)").alias("mad"))
    return spread.select("lang", "median", F.greatest(F.lit(0.001), 1.4826 * F.col("mad")).alias("spread"), "sigma")


def quality_rules(docs: DataFrame, n: int = ORDER, low: float = LOW, high: float = HIGH, limit: int | None = None) -> DataFrame:
    """(doc_id, lang, n_grams, perplexity, lower, upper, keep) of every row."""
    scored = storage.table(score(docs, Scores(docs, n, limit)), "scored")
    b = bands(scored).withColumnRenamed("lang", "bl")
    half = F.col("spread") + F.col("sigma") / F.sqrt("n")
    x = -F.col("s") / F.col("n")
    d = scored.join(F.broadcast(b), F.col("lang").eqNullSafe(F.col("bl")), "left").withColumn("n", F.nullif("n", F.lit(0)))
    lower, upper = F.col("median") - low * half, F.col("median") + high * half
    return d.select("doc_id", "lang", F.coalesce("n", F.lit(0)).alias("n_grams"), F.round(F.exp(x), 6).alias("perplexity"), F.round(F.exp(lower), 6).alias("lower"), F.round(F.exp(upper), 6).alias("upper"), F.coalesce((x >= lower) & (x <= upper), F.lit(True)).alias("keep"))


def filter_documents(docs: DataFrame, n: int = ORDER, low: float = LOW, high: float = HIGH, limit: int | None = None) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns."""
    scores = Scores(docs, n, limit)
    if scores.bits:
        by = storage.table(scores.by_parts(docs), "scores")
        texts = docs.select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("key"))
        scored = texts.join(by.withColumnsRenamed({"lang": "sl", "key": "sk"}), F.col("lang").eqNullSafe(F.col("sl")) & (F.col("key") == F.col("sk")))
        b = bands(scored).withColumnRenamed("lang", "bl")
        by = by.join(F.broadcast(b), F.col("lang").eqNullSafe(F.col("bl")))
        half, x = F.col("spread") + F.col("sigma") / F.sqrt("n"), -F.col("s") / F.col("n")
        bad = by.where("n > 0").where((x < F.col("median") - low * half) | (x > F.col("median") + high * half)).select(F.col("lang").alias("sl"), F.col("key").alias("sk"))
        row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("key"))
        return row.join(bad, F.col("lang").eqNullSafe(F.col("sl")) & (F.col("key") == F.col("sk")), "left_anti").select("row.*")
    b = bands(score(docs, scores))
    band = {r["lang"]: (r["median"], r["spread"], r["sigma"]) for r in b.collect()}  # a row a language
    at, shared = (docs.columns.index("lang"), docs.columns.index("text")), scores.shared

    def work(batches):
        text.trim()
        for batch in batches:
            part = pa.record_batch([batch.column(at[0]).cast(pa.string()), batch.column(at[1])], names=["lang", "text"])
            count, s, _ = _score_batch(storage.held(shared, lambda t: Model(t, n)), part)
            langs = part.column("lang").to_pylist()
            median, spread, sigma = (np.array([band.get(x, (0.0, 0.0, 0.0))[i] for x in langs]) for i in range(3))
            some = np.maximum(count, 1)
            half, x = spread + sigma / np.sqrt(some), -s / some
            yield batch.filter(pa.array((count == 0) | ((x >= median - low * half) & (x <= median + high * half))))

    return docs.mapInArrow(work, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _level_sql(m: int) -> str:
    source = "counts" if m == ORDER else f"l{m + 1}"
    rows = "SELECT lang, gram, c FROM counts" if m == ORDER else f"SELECT lang, substring(gram, 2) AS gram, count(*) AS c FROM {source} GROUP BY ALL"
    low = "SELECT lang, '' AS gram, 1.0 / count(*) AS p FROM l1 GROUP BY lang" if m == 1 else f"SELECT lang, gram, p FROM p{m - 1}"
    bound = lambda i, other: f"greatest(0.0, least({i}.0, CASE WHEN n{i} > 0 AND n{i + 1} > 0 THEN {i} - {i + 1} * (n1::DOUBLE / (n1 + 2 * n2)) * n{i + 1} / n{i} ELSE {other} END)) AS d{i}"
    return f"""l{m} AS MATERIALIZED ({rows}),
        """, f"""k{m} AS (SELECT lang, {bound(1, 0.5)}, {bound(2, 1.0)}, {bound(3, 1.5)} FROM (SELECT lang, {", ".join(f"(count(*) FILTER (c = {i}))::DOUBLE AS n{i}" for i in (1, 2, 3, 4))} FROM l{m} GROUP BY lang)),
        e{m} AS (SELECT l.lang, gram, c::DOUBLE AS c, CASE WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END AS d, substring(gram, 1, {m - 1}) AS ctx FROM l{m} l JOIN k{m} k ON l.lang IS NOT DISTINCT FROM k.lang),
        t{m} AS (SELECT lang, ctx, sum(c) AS total, sum(d) / sum(c) AS b FROM e{m} GROUP BY ALL),
        p{m} AS MATERIALIZED (SELECT e.lang, e.gram, (e.c - e.d) / t.total + t.b * w.p AS p FROM e{m} e JOIN t{m} t ON e.lang IS NOT DISTINCT FROM t.lang AND e.ctx = t.ctx
            JOIN ({low}) w ON e.lang IS NOT DISTINCT FROM w.lang AND substring(e.gram, 2) = w.gram),
        """


_SQL = [_level_sql(m) for m in range(1, ORDER + 1)]
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, lang, text, row_number() OVER () AS row_no FROM documents),
        g AS MATERIALIZED (SELECT row_no, lang, substring(text, i, {ORDER}) AS gram FROM (SELECT row_no, lang, text, unnest(range(1, length(text) - {ORDER - 2})) AS i FROM d)),
        counts AS MATERIALIZED (SELECT lang, gram, count(*) AS c FROM g GROUP BY ALL),
        {"".join(a for a, _ in reversed(_SQL))}{"".join(b for _, b in _SQL)}
        s AS (SELECT g.row_no, count(*) AS n, sum(ln(p.p)) AS s, sum(ln(p.p) * ln(p.p)) AS q FROM g JOIN p{ORDER} p ON g.lang IS NOT DISTINCT FROM p.lang AND g.gram = p.gram GROUP BY g.row_no),
        x AS (SELECT d.doc_id, d.lang, s.n, s.q, s.s, round(-s.s / s.n, 4) AS x FROM d JOIN s USING (row_no)),
        m AS (SELECT lang, quantile_cont(x, 0.5) AS median, sqrt(greatest(0.0, sum(q) / sum(n) - (sum(s) / sum(n)) ** 2)) AS sigma FROM x GROUP BY lang),
        b AS (SELECT x.lang, any_value(median) AS median, any_value(sigma) AS sigma, greatest(0.001, 1.4826 * quantile_cont(round(abs(x - median), 5), 0.5)) AS spread FROM x JOIN m ON x.lang IS NOT DISTINCT FROM m.lang GROUP BY x.lang),
        f AS (SELECT d.doc_id, d.lang, s.n, -s.s / s.n AS x, median - {LOW} * (spread + sigma / sqrt(s.n)) AS low, median + {HIGH} * (spread + sigma / sqrt(s.n)) AS high FROM d LEFT JOIN s USING (row_no) LEFT JOIN b ON d.lang IS NOT DISTINCT FROM b.lang)
SELECT doc_id, lang, coalesce(n, 0)::BIGINT AS n_grams, round(exp(x), 6) AS perplexity, round(exp(low), 6) AS lower, round(exp(high), 6) AS upper, coalesce(x BETWEEN low AND high, true) AS keep FROM f"""
