"""Quality rules, toxicity and the classifier."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strata.llm import nbsvm, quality_rules, storage, text, toxicity
from tests.llm.conftest import SCHEMA, row, same_as_sql, sentence


def kneser_ney(texts, n):
    """p(gram) of the n-grams of the texts, by dictionaries."""
    levels = {n: Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))}
    for m in range(n - 1, 0, -1):
        levels[m] = Counter(g[1:] for g in levels[m + 1])
    p = {"": 1 / len(levels[1])}
    for m in range(1, n + 1):
        c = Counter(levels[m].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0
        d = [0] + [min(float(i), max(0.0, i - (i + 1) * y * c[i + 1] / c[i])) if c[i] and c[i + 1] else o for i, o in ((1, 0.5), (2, 1.0), (3, 1.5))]
        total, left = defaultdict(float), defaultdict(float)
        for g, k in levels[m].items():
            total[g[:-1]] += k
            left[g[:-1]] += d[min(k, 3)]
        p |= {g: (k - d[min(k, 3)]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p[g[1:]] for g, k in levels[m].items()}
    return p


def test_perplexity_is_that_of_dictionaries(spark):
    rng = random.Random(2)
    texts = [sentence(rng, rng.randint(1, 40)) for _ in range(40)] + ["été à Noël", "x"]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    p = kneser_ney(texts, 3)
    for limit in (None, 0):
        got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, n=3, limit=limit).collect()}
        for i, t in enumerate(texts):
            lp = [math.log(p[t[k : k + 3]]) for k in range(len(t) - 2)]
            assert got[i]["n_grams"] == len(lp)
            assert got[i]["perplexity"] is None if not lp else abs(got[i]["perplexity"] - math.exp(-sum(lp) / len(lp))) < 1e-5


def test_no_step_of_the_perplexity_model_is_a_large_plan(hard, monkeypatch):
    joins, table = [], storage.table
    plan = lambda df: len(re.findall(r"\bJoin\b", df._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr(storage, "table", lambda df, what: joins.append(plan(df)) or table(df, what))
    last = quality_rules.model_table(quality_rules.count_ngrams(hard))
    assert max([*joins, plan(last)]) <= 3 and plan(last) == 0


def test_bands_reject_what_is_unlike_its_language(spark):
    rng = random.Random(3)
    rows = [row(i, sentence(rng), "en") for i in range(60)] + [row(100, "".join(rng.choice("qxzjvkw#%&") for _ in range(400)))]
    docs = spark.createDataFrame(rows, SCHEMA)
    for limit in (None, 0):
        kept = quality_rules.filter_documents(docs, limit=limit)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(60))


def test_quality_of_hard_rows(hard, empty):
    got = quality_rules.quality_rules(hard).collect()
    assert len(got) == hard.count()
    assert all(r["keep"] and r["perplexity"] is None for r in got if r["n_grams"] == 0)
    assert quality_rules.quality_rules(empty).count() == 0 == quality_rules.filter_documents(empty).count()
    a, b = (sorted(map(str, quality_rules.filter_documents(hard, limit=x).collect())) for x in (None, 0))
    assert a == b and len(a) == sum(r["keep"] for r in got)


def test_large_alphabets_are_counted():
    rng = random.Random(4)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(6000)), "abcab"]
    for n in (2, 5):
        counter, found = quality_rules._Counter(n), Counter()
        for t in texts:
            points, at = text.code_points(text.strings(pa.array([t])))
            for b in [*counter.add("x", points, at)]:
                found.update(dict(zip(b["gram"].to_pylist(), b["c"].to_pylist())))
        for b in counter.flush():
            found.update(dict(zip(b["gram"].to_pylist(), b["c"].to_pylist())))
        assert found == Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))


def test_words_and_hashes():
    texts = ["The rain, the RAIN's été", None, "", "  ", "Ünï-code_x9"]
    h, at = text.words(pa.array(texts))
    want = [["the", "rain", "the", "rain", "s", "été"], [], [], [], ["ünï", "code", "x9"]]
    assert np.diff(at).tolist() == [len(w) for w in want]
    assert h.tolist() == [text.word_hash(w) for ws in want for w in ws]
    a = text.HashArrays(np.sort(h), v=np.arange(len(h)))
    assert (a.find(h) >= 0).all() and (a.find(h + np.uint64(1)) < 0).all()


def test_toxic_words_are_found(spark):
    rng = random.Random(5)
    bad = lambda: " ".join(w if rng.random() > 0.06 else rng.choice(["scum", "moron"]) for w in sentence(rng, 150).split())
    rows = [row(i, bad() if i % 3 == 0 else sentence(rng, 150)) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity(docs, labels).collect()}
    assert not any(got[i] for i in range(300) if i % 3) and sum(got[i] for i in range(200, 300) if i % 3 == 0) >= 30
    kept = toxicity.filter_documents(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in got.items() if not t}


def test_toxicity_of_hard_rows(hard, empty, labels, spark):
    got = toxicity.toxicity(hard, labels).collect()
    assert len(got) == hard.count() and not any(r["toxic"] for r in got if r["n_words"] == 0)
    assert toxicity.toxicity(empty, labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert not any(r["toxic"] or r["llr"] for r in toxicity.toxicity(hard, none).collect())
    assert toxicity.filter_documents(hard, none).count() == hard.count()


def test_labelled_documents_of_one_word_or_none_train_nothing(spark, hard, labels):
    more = labels.unionAll(spark.createDataFrame([(i, 1, i % 2) for i in (42, 43, 45, 46, 47, 48, 49)], labels.schema))
    assert same_as_sql(toxicity.toxicity(hard, more), toxicity.ORACLE_SQL, documents=hard, labels=more)
    short = spark.createDataFrame([row(i, "word" if i % 2 else "") for i in range(40)], SCHEMA)
    of = spark.createDataFrame([(i, 1, i % 3 and 1) for i in range(40)], labels.schema)
    assert same_as_sql(toxicity.toxicity(short, of), toxicity.ORACLE_SQL, documents=short, labels=of)
    assert not any(r["toxic"] for r in toxicity.toxicity(short, of).collect())


def test_very_unequal_classes(spark, labels):
    rng = random.Random(15)
    bad = lambda: " ".join(w if rng.random() > 0.06 else rng.choice(["scum", "moron"]) for w in sentence(rng, 800).split())
    texts = [bad() if i % 2 else "one two three" if i < 40 else sentence(rng, 100) for i in range(200)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    for of in ([(i, 1, i % 2) for i in range(150)], [(i, 1, i % 2) for i in range(150) if i % 2 == 0 or i < 20]):
        lab = spark.createDataFrame(of, labels.schema)
        got = toxicity.toxicity(docs, lab)
        assert same_as_sql(got, toxicity.ORACLE_SQL, documents=docs, labels=lab)
        assert sum(r["toxic"] for r in got.collect() if r["doc_id"] % 2 and r["doc_id"] >= 150) >= 23
        assert sum(r["toxic"] for r in got.collect() if r["doc_id"] % 2 == 0 and r["doc_id"] >= 150) <= 2


def test_all_labelled_documents_are_used(spark, labels):
    rng = random.Random(22)
    bad = lambda i: " ".join(rng.choice(["scum", "moron", "rain", "hill"]) for _ in range(8)) if i % 90 == 0 else sentence(rng, 8)
    docs = spark.createDataFrame([row(i, bad(i), rng.choice(["en", "de", None])) for i in range(5600)], SCHEMA)
    lab = spark.createDataFrame([(i, 1, int(i % 90 == 0)) for i in range(5600)], labels.schema)
    bound = f"<= {toxicity.SAMPLE}"
    assert toxicity.ORACLE_SQL.count(bound) == 1
    assert same_as_sql(toxicity.toxicity(docs, lab), toxicity.ORACLE_SQL.replace(bound, "<= 1000000"), documents=docs, labels=lab)


def test_pairs_are_those_of_dictionaries_in_any_number_of_parts(spark, monkeypatch):
    rng = random.Random(23)
    docs = spark.createDataFrame([row(i, sentence(rng, rng.randint(0, 40))) for i in range(60)] + [row(3, "Stone, stone, stone"), row(60, "one"), row(61, None), row(None, "none of it")], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 62, 2)] + [(3, 1, 1)], "doc_id long, quality int, toxic int")
    md5 = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    toxic, before, held = {r["doc_id"]: r["toxic"] for r in labels.collect()}, defaultdict(set), defaultdict(set)
    for d in sorted(x for x in toxic if md5(x)[0] < "8"):
        w = re.findall("[a-z]+", min(((md5(r["text"]), r["text"]) for r in docs.where(F.col("doc_id") == d).collect() if r["text"] is not None), default=("", ""))[1].lower())
        for i in range(1, len(w)):
            held[w[i - 1], w[i]].add(toxic[d])
            before[w[i - 1], w[i]] |= {(toxic[d], w[i - 2])} if i > 1 else set()
    h = lambda x: int(np.array([text.word_hash(x)], np.uint64).view(np.int64)[0])
    want = {(h(v), h(w), *(sum(c == k for c, _ in before[v, w]) for k in (1, 0)), *(int(k in of) for k in (1, 0))) for (v, w), of in held.items()}
    for size in (8 << 20, 64):
        monkeypatch.setattr(toxicity, "PART_BYTES", size)
        got = [tuple(r) for r in toxicity._pairs(docs, toxicity._picks(docs, labels)).collect()]
        assert len(got) == len(want) > 100 and {*got} == want


def test_toxicity_keeps_no_texts_and_no_word_sequences_on_disk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).cast("int").alias("toxic"))
    folder = Path(storage.shared_dir(spark).removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = held()
    toxicity.fit(docs, labels)
    assert held() - before < 0.8 * docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_every_word_of_the_corpus_is_counted(spark, hard):
    want = Counter(text.word_hash(w) for r in hard.collect() for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (r["text"] or "").lower()))
    assert {r["word"] % (1 << 64): r["n"] for r in toxicity.corpus_counts(hard).collect()} == want


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=40) > 0, 1, -1)
    cost = np.full(40, 0.7)
    w = nbsvm.dual_descent([np.arange(6)] * 40, list(x), y, cost, 6, epochs=2000, tolerance=1e-9)
    value = lambda w: (w @ w) / 2 + 0.7 * np.maximum(0, 1 - y * (x @ w[:6] + w[6])).sum()
    best = value(w)
    assert all(value(w + 0.01 * rng.normal(size=7)) >= best - 1e-6 for _ in range(300))


def brute_features(t):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    return set(w) | set(zip(w, w[1:]))


def test_features_are_distinct_words_and_pairs():
    h, rows = nbsvm.hashes(pa.array(["a b a b", None, "b"]))
    assert len(h) == 8 and rows.tolist() == [0] * 4 + [2] + [0] * 3
    held = text.HashArrays(np.unique(h))
    place, at = nbsvm.features(pa.array(["a b a b", None, "b", "x y"]), held)
    assert np.diff(at).tolist() == [4, 0, 1, 0]
    assert all((np.diff(place[i:j]) > 0).all() for i, j in zip(at, at[1:]))


def test_margins_are_those_of_dictionaries(spark, hard, labels):
    for limit in (None, 0):
        got = {(r["doc_id"], r["margin"]) for r in nbsvm.classify(hard, labels, limit=limit).collect()}
        label = {}
        for r in labels.collect():
            if r["doc_id"] is not None and r["quality"] is not None:
                label[r["doc_id"]] = max(label.get(r["doc_id"], 0), r["quality"])
        rows = [r for r in hard.collect() if r["doc_id"] in label and r["text"] is not None]
        md5 = lambda x: hashlib.md5(str(x).encode()).hexdigest()
        sample = [min((md5(r["text"]), r["text"]) for r in rows if r["doc_id"] == d)[1] for d in sorted({r["doc_id"] for r in rows}, key=md5)]
        y = np.array([1 if label[d] else -1 for d in sorted({r["doc_id"] for r in rows}, key=md5)])
        seen = Counter(f for t in sample for f in brute_features(t))
        vocabulary = [f for f, k in seen.items() if k >= nbsvm.HELD]
        n = {c: Counter(f for r in rows if label[r["doc_id"]] == c for f in brute_features(r["text"])) for c in (0, 1)}
        r = nbsvm.ratios(np.array([n[1][f] for f in vocabulary], float), np.array([n[0][f] for f in vocabulary], float))
        at = {f: i for i, f in enumerate(vocabulary)}
        places = lambda t: np.array(sorted(at[f] for f in brute_features(t) if f in at), int)
        x = [places(t) for t in sample]
        cost = np.array([len(y) / (2 * (y == c).sum()) for c in y])
        w = nbsvm.dual_descent(x, [nbsvm._unit(r[p]) for p in x], y, cost, len(vocabulary))
        for d, m in got:
            texts = [q["text"] for q in hard.collect() if q["doc_id"] == d]
            assert any(abs(m - (nbsvm._unit(r[places(t)]) @ w[:-1][places(t)] + w[-1])) < 1e-4 for t in texts), (d, m)


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(6)
    junk = lambda: " ".join(rng.choice(["buy", "click", "cheap", "now", "win"]) for _ in range(50))
    docs = spark.createDataFrame([row(i, junk() if i % 4 == 0 else sentence(rng)) for i in range(300)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in nbsvm.classify(docs, labels).collect()}
    right = sum((got[i]["margin"] > 0) == (i % 4 > 0) for i in range(150, 300))
    assert right >= 148 and all(got[i]["keep"] for i in range(300) if i % 4)


def test_classifier_of_hard_rows(hard, empty, labels, spark):
    assert nbsvm.classify(hard, labels).count() == hard.count()
    assert nbsvm.classify(empty, labels).count() == 0
    assert all(r["keep"] and r["margin"] == 0 for r in nbsvm.classify(hard, spark.createDataFrame([], labels.schema)).collect())


def test_toxic_documents_of_every_language_are_found(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.toxicity(docs, labels).withColumnRenamed("toxic", "got").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    share = {(r["lang"], r["toxic"]): r["share"] for r in rows.groupBy("lang", "toxic").agg(F.avg(F.col("got").cast("int")).alias("share")).collect()}
    assert {lang for lang, _ in share} == {"de", "en", "es", "fr"}
    assert all(s > 0.85 if toxic else s < 0.03 for (_, toxic), s in share.items()), share


def test_one_mislabelled_document_doesnt_decide_what_is_kept(spark):
    rng = random.Random(6)
    junk = lambda: " ".join(rng.choice(["buy", "click", "cheap", "now", "win"]) for _ in range(50))
    docs = spark.createDataFrame([row(i, junk() if i % 4 == 0 else sentence(rng)) for i in range(300)], SCHEMA)
    odd = next(i for i in range(0, 150, 4) if hashlib.md5(str(i).encode()).hexdigest()[0] in "ef")
    labels = spark.createDataFrame([(i, int(i % 4 > 0 or i == odd), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in nbsvm.classify(docs, labels).collect()}
    assert sum(got[i] for i in range(152, 300, 4)) <= 2 and all(got[i] for i in range(150, 300) if i % 4)
