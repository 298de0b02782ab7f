"""Toxicity: class-conditional modified Kneser-Ney models of words, compared by length-normalised log-likelihood.

For each class c (toxic, ordinary) of labelled documents

    P_c(w | v) = (n_c(vw) - D) / n_c(v.) + g_c(v) * P_c(w),      P_c(w) = (a_c(w) - D) / A_c + g_c * n(w) / N

where a_c(w) counts the distinct words before w in the class's documents and n_c(vw) the distinct words before the pair, so that copies of
a passage count once, the discounts D come from the class's counts of counts, and n(w) / N is shared by both classes: Spark counts every
word of every document of the corpus. An expression too rare to tell the classes apart, whose count in the toxic class lies within SURE
standard deviations of what its count in both would give by chance, is discounted wholly and so left to the shared counts (with discounts
D alone, words that merely happen to be new to the smaller class decide: README). A word that neither class's documents hold leaves only the
backoff masses in the comparison, since n(w) / N cancels. The score of a document is

    (log P_toxic - log P_ordinary - words * M) / (words + PAD)

where M is what the difference comes to per word in ordinary documents; it is toxic from a threshold on, which is fitted to labelled
documents that the models weren't trained on: of all thresholds midway between two neighbouring scores, the one with the largest share of
toxic documents caught less STRICT times that of ordinary ones. M is that of each language with at least LEAST ordinary documents to fit
it, the threshold that of each language with as many of both classes; other languages have those of all documents together.

All labelled documents that have a text are used: those whose md5 of the doc_id begins with 0 to 7 train the models, the others fit M and
the thresholds, and every count is divided by its class's total. (The SQL takes the first SAMPLE of each class and half; the rows are
the same where there are no more.) Neither texts nor sequences of words are kept on disk: a row is known by the hash of doc_id, lang and
text, and what is shuffled of the sequences is what a task has distinct, packed, by the hash of the last two words. The finished model lies in the shared folder as sorted hash arrays, from which each worker reads it. A
word whose counts tell nothing apart, and that ends no pair that does, isn't in it: it leaves the backoff masses, as a new word does.

Defined results: a null or empty text has no words, score 0 and isn't toxic; a label that is null or belongs to no document with a text is
ignored; a document labelled twice counts as toxic if one label says so; of several texts of a labelled doc_id the one of least md5 is
taken; a labelled document of one word or none trains nothing; where a class has no pair of words to train with, all scores are 0 and
nothing is toxic; without documents to fit it, the threshold is THRESHOLD; documents with a null lang, or all if there is no such column,
are a language of their own; repeated rows are scored each for itself; an empty table gives an empty result; other columns are carried
through by filter_documents and ignored by toxicity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm import storage, text

#: Labelled documents of each class and half in the SQL.
SAMPLE = 2500
SURE = 4.0
PAD = 10
STRICT = 3
LEAST = 10
THRESHOLD = 0.05
_BLOCK = 1 << 19
#: Words of which a task ships what is distinct at once; bytes of the texts that train, for each part that is counted by itself.
SHIPPED, PART_BYTES = 1 << 20, 8 << 20
_WORDS, _CONTEXTS, _PAIRS, _MASS = range(4)


def _language(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, key) of the rows with both a doc_id and a text; key is the hash of all three."""
    return _language(docs).where("doc_id is not null and text is not null").withColumn("key", F.xxhash64("doc_id", "lang", "text"))


def _picks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, toxic, fold, lang, size) of every labelled document, size being its text's bytes; fold 0 trains, fold 1 fits the threshold.

    Only hashes are shuffled: who needs the texts reads the documents again and knows the rows by their keys.
    """
    t = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    fold = (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) >= "8").cast("int").alias("fold")
    of = storage.table(t.select(F.col("doc_id").alias("picked"), "toxic", fold), "labelled")
    d = storage.sieve(_keyed(docs), "doc_id", of, "picked").select("doc_id", F.unhex(F.md5("text")).alias("md5"), "lang", "key", F.octet_length("text").alias("size"))
    one = d.groupBy("doc_id").agg(F.min(F.struct("md5", "lang", "key", "size")).alias("d")).join(of, F.col("doc_id") == F.col("picked"))
    return storage.table(one.select("d.key", "toxic", "fold", "d.lang", "d.size"), "labelled-rows")


def _planes(x: np.ndarray) -> bytes:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _distinct(seen: list[tuple]) -> tuple[np.ndarray, ...]:
    """(words, v, w, pair, u, kind): the distinct (words, u, v, w, kind) of the list, whose u, v and w are places in sorted words.

    v and w are those of each distinct pair, in order; pair, u and kind those of each distinct row, in the order of pairs.
    """
    words, place = np.unique(np.concatenate([x[0] for x in seen]), return_inverse=True)
    first = np.concatenate([[0], np.cumsum([len(x[0]) for x in seen])]).astype(np.int64)
    u, v, w = (np.concatenate([place[x[i] + at] for x, at in zip(seen, first)]).astype(np.int64) for i in (1, 2, 3))
    kind = np.concatenate([x[4] for x in seen]).astype(text.U64)
    bits = max(1, int(len(words) - 1).bit_length())
    pairs, pair = np.unique(v << 32 | w, return_inverse=True)
    row = np.unique(pair.astype(text.U64) << text.U64(bits + 2) | u.astype(text.U64) << text.U64(2) | kind)
    mask = text.U64((1 << bits) - 1)
    return words, pairs >> 32, pairs & 0xFFFFFFFF, (row >> text.U64(bits + 2)).astype(np.int64), (row >> text.U64(2) & mask).astype(np.int64), (row & text.U64(3)).astype(np.uint8)


def _shipped(seen: list[tuple], bits: int) -> pa.RecordBatch:
    """The distinct rows of the list, those of each part (by the hash of v and w) in a row: sorted words, and places in them, byte by byte."""
    words, v, w, pair, u, kind = _distinct(seen)
    part = (text.pair_hash(words[v], words[w]) >> text.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(v), np.int64)
    by_pair, by_row = np.argsort(part, kind="stable"), np.argsort(part[pair], kind="stable")
    pair_cuts, row_cuts = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=1 << bits))]) for x in (part, part[pair]))
    count, out = np.bincount(pair, minlength=len(v)), []
    for k in np.flatnonzero(np.diff(pair_cuts)):
        p, r = by_pair[pair_cuts[k] : pair_cuts[k + 1]], by_row[row_cuts[k] : row_cuts[k + 1]]
        used = np.zeros(len(words), bool)
        used[v[p]] = used[w[p]] = used[u[r]] = True
        rank = np.cumsum(used) - 1
        body = b"".join((_planes(np.diff(rank[v[p]], prepend=0)), _planes(rank[w[p]]), _planes(count[p]), _planes(rank[u[r]]), kind[r].tobytes()))
        out.append((int(k), len(p), len(r), words[used].tobytes(), pa.compress(body, "zstd", asbytes=True)))
    return pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["part", "pairs", "rows", "words", "body"])


def _received(pairs: int, rows: int, words: bytes, body: bytes) -> tuple:
    """A row of _shipped() as _distinct() takes it."""
    raw = np.frombuffer(pa.decompress(body, 12 * pairs + 5 * rows, "zstd", asbytes=True), np.uint8)
    cuts = np.cumsum([0, 4 * pairs, 4 * pairs, 4 * pairs, 4 * rows])
    v, w, count, u = (np.ascontiguousarray(raw[i:j].reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for i, j in zip(cuts, cuts[1:]))
    return np.frombuffer(words, text.U64), u, np.repeat(np.cumsum(v), count), np.repeat(w, count), raw[cuts[-1] :]


def _pairs(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """(v, w, t, o, in_t, in_o) of every pair of words: distinct words before it in the toxic and the ordinary documents that train; whether they hold it.

    A task ships what is distinct in about SHIPPED of its words; each of the parts that it goes to is counted by itself.
    """
    train = picks.where("fold = 0")
    folder, spark = storage.new_folder(docs.sparkSession, "trains"), docs.sparkSession
    train.select("key", "toxic").write.parquet(folder)
    size = train.agg(F.sum("size")).first()[0] or 0
    bits = int(size // PART_BYTES).bit_length()

    def ship(batches):
        text.trim()
        seen = []
        for batch in batches:
            known = storage.held(folder, lambda t: text.HashArrays(t["key"].to_numpy().view(text.U64), toxic=t["toxic"].to_numpy().astype(np.uint8)))
            place = known.find(batch.column(0).to_numpy().view(text.U64))
            rows = np.flatnonzero(place >= 0)
            toxic = known.values["toxic"][place[rows]]
            for first, block in text.slices(text.strings(batch.column(1).take(pa.array(rows))), _BLOCK):
                h, at = text.words(block)
                if len(h) < 2:
                    continue
                begin = np.zeros(len(h) + 1, bool)
                begin[at] = True
                i = np.flatnonzero(~begin[: len(h)])
                alone = begin[i - 1]
                kind = np.repeat(toxic[first : first + len(block)], np.diff(at))[i] | alone.astype(np.uint8) << 1
                seen.append((h, np.where(alone, i, i - 2), i - 1, i, kind))
                if sum(len(x[0]) for x in seen) > SHIPPED:
                    yield _shipped(seen, bits)
                    seen = []
        if seen:
            yield _shipped(seen, bits)

    def count(batches):
        text.trim()
        part, seen = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if row[0] != part and seen:
                    yield from counted(seen)
                    seen = []
                part = row[0]
                seen.append(_received(*row[1:]))
        if seen:
            yield from counted(seen)

    def counted(seen):
        words, v, w, pair, _, kind = _distinct(seen)
        n = [np.bincount(pair[kind == k], minlength=len(v)) for k in range(4)]
        columns = [words[v].view(np.int64), words[w].view(np.int64), n[1].astype(np.int32), n[0].astype(np.int32), (n[1] + n[3] > 0).astype(np.int8), (n[0] + n[2] > 0).astype(np.int8)]
        yield pa.record_batch([pa.array(x) for x in columns], names=["v", "w", "t", "o", "in_t", "in_o"])

    texts = storage.sieve(_keyed(docs), "key", train, "key").select("key", "text")
    parts = texts.mapInArrow(ship, "part int, pairs int, rows int, words binary, body binary").repartition(1 << bits, "part").sortWithinPartitions("part")
    return storage.table(parts.mapInArrow(count, "v long, w long, t int, o int, in_t tinyint, in_o tinyint"), "pairs")


def _discounted(level: DataFrame) -> tuple[DataFrame, dict]:
    """level (t, o: counts in the toxic and the ordinary documents) with dt and do, their modified Kneser-Ney discounts, or the counts themselves for an expression that doesn't tell the classes apart; sums of t and o."""
    n = level.agg(*(F.count(F.when(F.col(x) == i, 1)).alias(f"{x}{i}") for x in "to" for i in (1, 2, 3, 4)), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "to")).first().asDict()
    share = n["t"] / max(1, n["t"] + n["o"])
    both = F.col("t") + F.col("o")
    unsure = F.abs(F.col("t") - F.lit(share) * both) < SURE * F.sqrt(F.lit(share) * (1 - F.lit(share)) * both)

    def discount(x: str):
        c = [0, *(n[f"{x}{i}"] for i in (1, 2, 3, 4))]
        rare = c[1] + 2 * c[2]
        one = lambda i, other: other if not (c[i] and c[i + 1]) else float(i) if not rare else max(0.0, min(float(i), i - (i + 1) * (c[1] / rare) * c[i + 1] / c[i]))
        d = F.when(F.col(x) == 1, one(1, 0.5)).when(F.col(x) == 2, one(2, 1.0)).otherwise(one(3, 1.5))
        return F.when(F.col(x) == 0, 0.0).when(unsure, F.col(x).cast("double")).otherwise(d)

    return level.withColumns({"dt": discount("t"), "do": discount("o")}), n


def corpus_counts(docs: DataFrame, only: str | None = None) -> DataFrame:
    """(word, n): occurrences of every word, by its hash, in all documents; a task adds up its own first. With a folder of words (w), theirs, and those of all others together beside null."""

    def work(batches):
        text.trim()
        held = []
        for batch in batches:
            for _, block in text.slices(text.strings(batch.column(0)), _BLOCK):
                held.append(np.unique(text.words(block)[0].view(np.int64), return_counts=True))
                if len(held) > 1 and sum(len(k) for k, _ in held[1:]) > max(1 << 18, len(held[0][0])):
                    held = [_added(held)]
        if held:
            key, n = _added(held)
            if only:
                own = storage.held(only, lambda t: text.HashArrays(t["w"].to_numpy().view(text.U64))).find(key.view(text.U64)) >= 0
                yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([n[~own].sum()], pa.int64())], names=["word", "n"])
                key, n = key[own], n[own]
            yield pa.record_batch([pa.array(key), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _added(held: list) -> tuple[np.ndarray, np.ndarray]:
    key, of = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return key, np.bincount(of, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)


class Model:
    """The two class models in sorted hash arrays."""

    def __init__(self, table: pa.Table):
        kind, key, t, o = (table[c].to_numpy() for c in ("kind", "key", "t", "o"))
        at = kind == _MASS
        self.mass = (float(t[at][0]), float(o[at][0])) if at.any() else None
        self.words, self.contexts, self.pairs = (text.HashArrays(key[kind == k].view(text.U64), t=t[kind == k], o=o[kind == k]) for k in (_WORDS, _CONTEXTS, _PAIRS))

    def score(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Words of each row and log P_toxic - log P_ordinary of its text."""
        w, at = text.words(column)
        if self.mass is None or not len(w):
            return np.diff(at), np.zeros(len(at) - 1)
        place = self.words.find(w)
        p = [np.where(place >= 0, self.words.values[k][place], m) if len(self.words.keys) else np.full(len(w), m) for k, m in zip("to", self.mass)]
        follows = np.ones(len(w), bool)
        follows[at[:-1][at[:-1] < len(w)]] = False
        second = np.flatnonzero(follows)
        ctx = self.contexts.find(w[second - 1])
        second, ctx = second[ctx >= 0], ctx[ctx >= 0]
        known = np.flatnonzero(place[second] >= 0)
        pair = self.pairs.find(text.pair_hash(w[second[known] - 1], w[second[known]]))
        known, pair = known[pair >= 0], pair[pair >= 0]
        for k, x in zip("to", p):
            x[second] *= self.contexts.values[k][ctx]
            x[second[known]] += self.pairs.values[k][pair]
        return np.diff(at), text.row_sums(np.log(p[0] / p[1]), at)


def _pair_keys(batches):
    for batch in batches:
        v, w, t, o = (batch.column(c) for c in ("v", "w", "t", "o"))
        key = text.pair_hash(v.to_numpy().view(text.U64), w.to_numpy().view(text.U64))
        yield pa.record_batch([pa.array(np.full(len(key), _PAIRS, np.int32)), pa.array(key.view(np.int64)), t, o], names=["kind", "key", "t", "o"])


def train(docs: DataFrame, picks: DataFrame) -> str:
    """The folder that holds the class models' hash arrays."""
    raw = _pairs(docs, picks)
    pairs, _ = _discounted(raw)
    single, n = _discounted(storage.table(raw.groupBy("w").agg(F.sum("in_t").alias("t"), F.sum("in_o").alias("o")), "words"))
    folder, spark = storage.new_folder(docs.sparkSession, "toxicity"), docs.sparkSession
    left = single.agg(F.sum("dt").alias("t"), F.sum("do").alias("o")).first()
    mass = (left["t"] / n["t"], left["o"] / n["o"]) if n["t"] and n["o"] else None
    rows = spark.createDataFrame([(_MASS, 0, *mass)] if mass else [], "kind int, key long, t double, o double")
    if mass:
        kept = storage.table(pairs.where("t > dt or o > do").drop("in_t", "in_o"), "kept")
        ends = kept.select(F.col("w").alias("end")).distinct()
        own = single.join(ends, F.col("w") == F.col("end"), "left").where("t > dt or o > do or end is not null")
        known = storage.new_folder(spark, "known")
        own.select("w", ((F.col("t") - F.col("dt")) / n["t"]).alias("t"), ((F.col("o") - F.col("do")) / n["o"]).alias("o")).write.parquet(known)
        counts = storage.table(corpus_counts(docs, known), "counts")
        total = counts.agg(F.sum("n")).first()[0]
        shared = F.coalesce(F.col("n"), F.lit(0)) / total
        words = spark.read.schema("w long, t double, o double").parquet(known).join(counts, F.col("w") == F.col("word"), "left")
        words = words.select(F.lit(_WORDS).alias("kind"), F.col("w").alias("key"), (F.col("t") + mass[0] * shared).alias("t"), (F.col("o") + mass[1] * shared).alias("o"))
        sums = storage.sieve(pairs, "v", kept.select("v").distinct(), "v").groupBy(F.col("v").alias("tv")).agg(*(F.sum(x).alias(f"s{x}") for x in ("t", "o", "dt", "do")))
        share = lambda x, of: F.when(F.col(of) > 0, F.col(x) / F.col(of))
        totals = storage.table(sums.select("tv", "st", "so", F.coalesce(share("sdt", "st"), F.lit(1.0)).alias("bt"), F.coalesce(share("sdo", "so"), F.lit(1.0)).alias("bo")).where("bt < 1 or bo < 1"), "contexts")
        contexts = totals.select(F.lit(_CONTEXTS).alias("kind"), F.col("tv").alias("key"), F.col("bt").alias("t"), F.col("bo").alias("o"))
        kept = kept.select("v", "w", (F.col("t") - F.col("dt")).alias("xt"), (F.col("o") - F.col("do")).alias("xo")).join(totals, F.col("v") == F.col("tv"))
        both = kept.select("v", "w", *(F.coalesce(share(f"x{x}", f"s{x}"), F.lit(0.0)).alias(x) for x in "to")).mapInArrow(_pair_keys, rows.schema)
        rows = rows.unionAll(words).unionAll(contexts).unionAll(both)
    rows.coalesce(8).write.parquet(folder)
    return folder


def _scores(folder: str, texts) -> tuple[np.ndarray, np.ndarray]:
    """In a worker: words of each text and log P_toxic - log P_ordinary."""
    model = storage.held(folder, Model)
    parts = [model.score(block) for _, block in text.slices(text.strings(texts), _BLOCK)]
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (0, 1))


def fit(docs: DataFrame, labels: DataFrame):
    """(the model's folder, M and threshold of each language that has its own, those of the others)."""
    picks = _picks(docs, labels)
    folder = train(docs, picks)

    def work(batches):
        text.trim()
        for batch in batches:
            n, s = _scores(folder, batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(n.astype(np.int64)), pa.array(s.astype(float))], names=["key", "n", "s"])

    fits = picks.where("fold = 1")
    rows = storage.sieve(_keyed(docs), "key", fits, "key").select("key", "text").mapInArrow(work, "key long, n long, s double")
    scored = storage.table(fits.join(rows.dropDuplicates(["key"]), "key").select("toxic", "lang", "n", "s"), "scored")
    scored = scored.select(F.lit(False).alias("whole"), "lang", "n", "s", "toxic").unionAll(scored.select(F.lit(True), F.lit(None).cast("string"), "n", "s", "toxic"))
    of = {(r["whole"], r["lang"]): r for r in _thresholds(scored).collect()}  # a row a language
    chosen = lambda r: THRESHOLD if r["threshold"] is None else r["threshold"]
    whole = of.get((True, None))
    others = (whole["mean"], chosen(whole)) if whole else (0.0, THRESHOLD)
    own = {lang: (r["mean"], chosen(r) if r["ts"] >= LEAST else others[1]) for (w, lang), r in of.items() if not w and r["os"] >= LEAST}
    return folder, own, others


def _thresholds(scored: DataFrame) -> DataFrame:
    """(whole, lang, mean, os, ts, threshold): M, documents of each class, and the best of the thresholds midway between neighbouring scores, null if there is none; ties go to the largest."""
    ordinary = lambda c: F.sum(F.when(F.col("toxic") == 0, F.col(c)))
    count = lambda c: F.count(F.when(F.col("toxic") == c, 1))
    mean = F.coalesce(F.round(ordinary("s") / F.greatest(F.lit(1), ordinary("n")), 6), F.lit(0.0))
    means = storage.table(scored.groupBy("whole", "lang").agg(mean.alias("mean"), count(0).alias("os"), count(1).alias("ts")), "means")
    of = means.select(F.col("whole").alias("w"), F.col("lang").alias("l"), "mean", "os", "ts")
    each = scored.join(F.broadcast(of), (F.col("whole") == F.col("w")) & F.col("lang").eqNullSafe(F.col("l")))
    llr = (F.round((F.col("s") - F.col("n") * F.col("mean")) / (F.col("n") + PAD), 6) + 0.0).alias("llr")
    steps = each.select("w", "l", "os", "ts", "toxic", llr).groupBy("w", "l", "os", "ts", "llr").agg(count(1).alias("t"), count(0).alias("o"))
    up = Window.partitionBy("w", "l").orderBy("llr")
    down = Window.partitionBy("w", "l").orderBy(F.desc("llr")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("below", F.lag("llr").over(up)).withColumn("t", F.sum("t").over(down)).withColumn("o", F.sum("o").over(down))
    gain = (F.col("t") / F.greatest(F.lit(1), "ts") - STRICT * F.col("o") / F.greatest(F.lit(1), "os")).alias("gain")
    best = steps.where("ts > 0 and os > 0 and below is not null").groupBy("w", "l").agg(F.max(F.struct(gain, "llr", "below")).alias("b"))
    best = best.select("w", "l", ((F.col("b.llr") + F.col("b.below")) / 2).alias("threshold"))
    return means.join(best, (F.col("whole") == F.col("w")) & F.col("lang").eqNullSafe(F.col("l")), "left").select("whole", "lang", "mean", "os", "ts", "threshold")


def _llr(n, s, mean):
    return np.round((s - n * mean) / (n + PAD), 6) + 0.0


def _judge(fitted, texts, langs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, score and verdict of each row."""
    folder, own, others = fitted
    n, s = _scores(folder, texts)
    mean, threshold = np.array([own.get(x, others) for x in langs.to_pylist()]).reshape(-1, 2).T
    llr = _llr(n, s, mean)
    return n, llr, (llr >= threshold) & (n > 0)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, llr, toxic) of every row; llr is the score."""
    fitted = fit(docs, labels)

    def work(batches):
        text.trim()
        for batch in batches:
            n, llr, toxic = _judge(fitted, batch.column(1), batch.column(2))
            yield pa.record_batch([batch.column(0), pa.array(n.astype(np.int64)), pa.array(llr), pa.array(toxic)], names=["doc_id", "n_words", "llr", "toxic"])

    return _language(docs).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, llr double, toxic boolean")


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that toxicity() doesn't call toxic, with all their columns."""
    fitted = fit(docs, labels)
    at, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def work(batches):
        text.trim()
        for batch in batches:
            langs = pa.nulls(batch.num_rows) if lang is None else batch.column(lang).cast(pa.string())
            yield batch.filter(pa.array(~_judge(fitted, batch.column(at), langs)[2]))

    return docs.mapInArrow(work, docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_DISCOUNT = lambda i, other: f"greatest(0.0, least({i}.0, CASE WHEN n{i} > 0 AND n{i + 1} > 0 THEN {i} - {i + 1} * (n1::DOUBLE / (n1 + 2 * n2)) * n{i + 1} / n{i} ELSE {other} END)) AS d{i}"


def _discount_sql(level: str, keys: str) -> str:
    return f"""(SELECT toxic, {keys}, c, CASE WHEN abs(t - q * b) < {SURE} * sqrt(q * (1 - q) * b) THEN c WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END AS d FROM
        (SELECT *, sum(c) OVER (PARTITION BY {keys}) AS b, coalesce(sum(c) FILTER (toxic = 1) OVER (PARTITION BY {keys}), 0) AS t FROM {level})
        CROSS JOIN (SELECT coalesce(sum(c) FILTER (toxic = 1), 0)::DOUBLE / sum(c) AS q FROM {level}) JOIN
        (SELECT toxic, {_DISCOUNT(1, 0.5)}, {_DISCOUNT(2, 1.0)}, {_DISCOUNT(3, 1.5)} FROM (SELECT toxic, {", ".join(f"(count(*) FILTER (c = {i}))::DOUBLE AS n{i}" for i in (1, 2, 3, 4))} FROM {level} GROUP BY toxic)) USING (toxic))"""


_LLR = f"round((s - n_words * m) / (n_words + {PAD}), 6) + 0.0 AS llr"

ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_no, doc_id, text, lang, coalesce(regexp_extract_all(lower(text), '{text.WORD_RE}'), []) AS w FROM documents),
        lab AS (SELECT doc_id, max(toxic)::INT AS toxic, md5(doc_id::VARCHAR) AS md5 FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL) GROUP BY doc_id),
        picks AS (SELECT *, (md5[1] >= '8')::INT AS fold FROM lab QUALIFY row_number() OVER (PARTITION BY toxic, md5[1] >= '8' ORDER BY md5) <= {SAMPLE}),
        r AS MATERIALIZED (SELECT row_no, toxic, fold, lang, w FROM d JOIN picks USING (doc_id) WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(text), lang NULLS FIRST) = 1),
        seq AS MATERIALIZED (SELECT DISTINCT toxic, CASE WHEN i > 2 THEN w[i - 2] END AS u, w[i - 1] AS v, w[i] AS w FROM (SELECT toxic, w, unnest(range(2, len(w) + 1)) AS i FROM r WHERE fold = 0)),
        n2 AS MATERIALIZED (SELECT toxic, v, w, count(*) AS c FROM seq WHERE u IS NOT NULL GROUP BY ALL),
        p2 AS MATERIALIZED {_discount_sql("n2", "v, w")},
        n1 AS MATERIALIZED (SELECT toxic, w, count(DISTINCT v) AS c FROM seq GROUP BY ALL),
        p1 AS MATERIALIZED {_discount_sql("n1", "w")},
        mass AS (SELECT toxic, sum(c) AS total, sum(d) / sum(c) AS g FROM p1 GROUP BY toxic),
        tok AS MATERIALIZED (SELECT row_no, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v FROM (SELECT row_no, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        sh AS (SELECT w, count(*)::DOUBLE / (SELECT count(*) FROM tok) AS s FROM tok GROUP BY w),
        ctx AS (SELECT toxic, v, sum(c) AS total, sum(d) / sum(c) AS b FROM p2 GROUP BY ALL),
        uni AS (SELECT sh.w, m.toxic, coalesce((p1.c - p1.d) / m.total, 0) + m.g * sh.s AS p FROM sh CROSS JOIN mass m LEFT JOIN p1 ON p1.w = sh.w AND p1.toxic = m.toxic),
        lp AS (SELECT t.row_no, t.i, u.toxic, ln(coalesce((p2.c - p2.d) / ctx.total, 0) + coalesce(ctx.b, 1) * u.p) AS lp FROM tok t JOIN uni u ON u.w = t.w LEFT JOIN ctx ON ctx.v = t.v AND ctx.toxic = u.toxic LEFT JOIN p2 ON p2.v = t.v AND p2.w = t.w AND p2.toxic = u.toxic),
        raw AS MATERIALIZED (SELECT d.row_no, d.doc_id, d.lang, len(d.w)::BIGINT AS n_words, CASE WHEN (SELECT count(*) FROM mass) = 2 THEN coalesce(x.s, 0) ELSE 0 END AS s FROM d LEFT JOIN (SELECT row_no, sum(CASE WHEN toxic = 1 THEN lp ELSE -lp END) AS s FROM lp GROUP BY row_no) x USING (row_no)),
        f1 AS (SELECT raw.lang, raw.n_words, raw.s, r.toxic FROM raw JOIN r USING (row_no) WHERE fold = 1),
        f AS (SELECT false AS whole, * FROM f1 UNION ALL SELECT true, NULL, n_words, s, toxic FROM f1),
        mn AS (SELECT whole, lang, coalesce(round(sum(s) FILTER (toxic = 0) / greatest(1, sum(n_words) FILTER (toxic = 0)), 6), 0) AS m, count(*) FILTER (toxic = 0) AS os, count(*) FILTER (toxic = 1) AS ts FROM f GROUP BY ALL),
        g AS (SELECT f.whole, f.lang, {_LLR}, os, ts, count(*) FILTER (toxic = 1) AS t, count(*) FILTER (toxic = 0) AS o FROM f JOIN mn ON f.whole = mn.whole AND f.lang IS NOT DISTINCT FROM mn.lang GROUP BY ALL),
        st AS (SELECT whole, lang, llr, os, ts, lag(llr) OVER (PARTITION BY whole, lang ORDER BY llr) AS below, sum(t) OVER (PARTITION BY whole, lang ORDER BY llr DESC) AS t, sum(o) OVER (PARTITION BY whole, lang ORDER BY llr DESC) AS o FROM g),
        th AS (SELECT whole, lang, (llr + below) / 2 AS threshold FROM st WHERE ts > 0 AND os > 0 AND below IS NOT NULL QUALIFY row_number() OVER (PARTITION BY whole, lang ORDER BY t / ts - {STRICT} * o / os DESC, llr DESC) = 1),
        own AS (SELECT mn.lang, m, CASE WHEN ts >= {LEAST} THEN coalesce(threshold, {THRESHOLD}) END AS threshold FROM mn LEFT JOIN th ON NOT th.whole AND mn.lang IS NOT DISTINCT FROM th.lang WHERE NOT mn.whole AND os >= {LEAST}),
        oth AS (SELECT coalesce((SELECT m FROM mn WHERE whole), 0) AS m, coalesce((SELECT threshold FROM th WHERE whole), {THRESHOLD}) AS threshold),
        sc AS (SELECT doc_id, n_words, s, coalesce(own.m, oth.m) AS m, coalesce(own.threshold, oth.threshold) AS threshold FROM raw CROSS JOIN oth LEFT JOIN own ON raw.lang IS NOT DISTINCT FROM own.lang)
SELECT doc_id, n_words, {_LLR}, llr >= threshold AND n_words > 0 AS toxic FROM sc"""
