"""Jaccard join, packing, licences, byte-pair encoding and the pipeline."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strata.llm import bpe, jaccard_join, licenses, packing, quality_rules, storage, toxicity
from tests.llm.conftest import SCHEMA, row, same_as_sql, sentence


def words(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())


def shingles(t, n=3):
    w = words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_pairs(rows, threshold=0.5):
    docs = {(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None and shingles(r["text"])}
    out = []
    for (a, x), (b, y) in itertools.combinations(docs, 2):
        j = len(x & y) / len(x | y)
        if a != b and j >= threshold:
            out.append((min(a, b), max(a, b), round(j, 6)))
    return sorted(out)


def near_copies(rng, n, rate):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(80)]
    return [" ".join(w if rng.random() > rate else f"x{rng.randint(0, 9999)}" for w in base) for _ in range(n)]


def test_pairs_are_those_of_brute_force(spark, hard):
    rng = random.Random(7)
    texts = [t for rate in (0.0, 0.02, 0.05, 0.08) for t in near_copies(rng, 12, rate)] + [sentence(rng) for _ in range(20)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"{passage} " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 60))) for _ in range(30)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    want = brute_pairs(docs.collect())
    got = sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()))
    assert set(got) <= set(want) and len(got) == len(set(got)) >= 0.97 * len(want) > 100
    assert sorted(map(tuple, jaccard_join.jaccard_join(hard).collect())) == brute_pairs(hard.collect())


def test_a_row_for_each_document_with_its_class_and_links(spark, hard, empty, monkeypatch):
    rng = random.Random(21)
    copies = near_copies(rng, 12, 0.01)
    rows = [row(i, copies[i % 12]) for i in range(60)] + [row(60 + i, sentence(rng)) for i in range(20)]
    rows += [row(5, copies[8]), row(60, copies[3]), row(61, rows[62][1]), row(62, rows[62][1]), row(90, None), row(None, copies[0]), row(None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).unionAll(hard)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 3)
    monkeypatch.setattr(jaccard_join, "VISITORS", 2)
    got = jaccard_join.document_links(docs)
    assert same_as_sql(got, jaccard_join.ORACLE_SQL, documents=docs)
    ids, got = [r["doc_id"] for r in docs.select("doc_id").collect()], got.collect()
    assert len(got) == len(set(ids) - {None}) + ids.count(None)
    assert {r["doc_id"]: r["links"] for r in got if r["links"]} == Counter(x for p in brute_pairs(docs.collect()) for x in p[:2])
    assert jaccard_join.document_links(empty).count() == 0


def test_the_query_gives_as_many_rows_as_there_are_documents(spark, tmp_path):
    texts = ["one two three four five" + " six" * (i % 2) for i in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, jaccard_join.op8(spark, str(tmp_path)).collect())) == [(i, 0, 39) for i in range(40)]


def test_blocks_only_divide_the_work(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(near_copies(rng, 40, 0.02))], SCHEMA)
    want = sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()))
    monkeypatch.setattr(jaccard_join, "MEMBERS", 5)
    monkeypatch.setattr(jaccard_join, "VISITORS", 3)
    assert sorted(map(tuple, jaccard_join.jaccard_join(docs).collect())) == want


def test_shuffled_tasks_and_ids_that_are_strings(spark, monkeypatch):
    rng = random.Random(19)
    texts = [t for _ in range(4) for t in near_copies(rng, 10, 0.03)]
    docs = spark.createDataFrame([(f"d{i:02}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    want = sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()))
    assert len(want) > 100 and set(want) <= {(a, b, j) for a, b, j in brute_pairs(docs.collect())}
    assert sorted(r["doc_id"] for r in jaccard_join.remove_near_duplicates(docs).collect()) == ["d00", "d10", "d20", "d30"]
    monkeypatch.setattr(jaccard_join, "MANY", 0)
    monkeypatch.setattr(jaccard_join, "SPLIT", 4)
    got = sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()))
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)


def test_a_passage_in_many_documents_sends_none_to_every_other(spark, monkeypatch):
    rng = random.Random(31)
    passage = " ".join(f"p{i}" for i in range(45))
    texts = [f"{passage} " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(32)) for _ in range(300)] + near_copies(rng, 20, 0.03)
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    counts, plain = {}, storage.table

    def table(df, what):
        out = plain(df, what)
        counts[what] = out.count()
        return out

    monkeypatch.setattr(storage, "table", table)
    got = sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()))
    assert got == brute_pairs(docs.collect()) and len(got) > 100
    assert max(counts.values()) <= (jaccard_join.BANDS + 1) * len(texts), counts


def test_prefixes_leave_out_no_pair():
    rng = np.random.default_rng(32)
    for block in range(30):
        sets = [np.unique(np.concatenate([rng.choice(40, rng.integers(1, 25)), 40 + rng.choice(12, rng.integers(0, 12), replace=False)])) for _ in range(70)]
        union, places = np.unique(np.concatenate(sets[:60]), return_inverse=True)
        index = jaccard_join._Index(places, np.array([len(s) for s in sets[:60]]), len(union), 0.5)
        for s in sets:
            at = np.flatnonzero(np.isin(union, s))
            seen = index.sharing(at, len(s), 0.5, 1 << 30)
            assert all(seen[j] for j in range(60) if 2 * len(np.intersect1d(s, sets[j])) >= len(np.union1d(s, sets[j])))
            assert index.sharing(at, len(s), 0.5, -1) is None


def test_the_sieve_lets_every_key_through(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(3000)] + [(None, "x")], "doc_id long, text string")
    keys = spark.createDataFrame([(i,) for i in range(0, 3000, 30)], "k long")
    for most in (1 << 20, 1):
        got = {r["doc_id"] for r in storage.sieve(rows, "doc_id", keys, "k", most).collect()}
        assert set(range(0, 3000, 30)) <= got and None not in got and (len(got) < 600 or most == 1)
    assert storage.sieve(rows, "doc_id", keys.where("false"), "k").count() == 0


def test_the_union_bounds_every_overlap():
    rng = np.random.default_rng(20)
    for _ in range(50):
        sets = [np.unique(rng.integers(0, 60, 20).astype(np.uint64) << np.uint64(32)) for _ in range(6)]
        short = [(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets]
        rows = lambda k, some: [{"task": 1, "sig": i, "kind": k, "tokens": short[i]} for i in some]
        column = jaccard_join._union(pa.Table.from_pylist(rows(0, range(3))))["tokens"][0].as_py()
        got = jaccard_join._bound(0.5)(pa.Table.from_pylist([{"task": 1, "sig": None, "kind": 0, "tokens": column}, *rows(2, range(3, 6))]))["sig"].to_pylist()
        union = set(np.concatenate(sets[:3]).tolist())
        assert got == [i for i in range(3, 6) if len(union & set(sets[i].tolist())) >= 0.5 * len(sets[i])]
        assert set(got) >= {i for i in range(3, 6) for j in range(3) if 2 * len(np.intersect1d(sets[i], sets[j])) >= len(np.union1d(sets[i], sets[j]))}


def brute_keep(rows):
    """Rows that stay: of each group that pairs connect the least doc_id; rows without id or words."""
    own = sorted({(r["doc_id"], shingles(r["text"])) for r in rows if r["doc_id"] is not None and shingles(r["text"])}, key=lambda x: (x[0], sorted(x[1])))
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(own)), 2):
        if len(own[i][1] & own[j][1]) / len(own[i][1] | own[j][1]) >= 0.5:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    stay = {own[i] for i in range(len(own)) if find(i) == i}
    free = [r for r in rows if r["doc_id"] is None or not shingles(r["text"])]
    return sorted(r["doc_id"] for r in free if r["doc_id"] is not None) + sorted(d for d, _ in stay), sum(r["doc_id"] is None for r in free)


@pytest.mark.parametrize("limit", [None, 0])
def test_one_of_each_group_stays(spark, hard, empty, limit):
    rng = random.Random(9)
    groups = [near_copies(rng, 8, 0.01) for _ in range(5)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(t for g in groups for t in g)], SCHEMA)
    kept = jaccard_join.remove_near_duplicates(docs, limit=limit)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 8, 16, 24, 32]
    kept = jaccard_join.remove_near_duplicates(hard, limit=limit).collect()
    ids, nulls = brute_keep(hard.collect())
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(ids) and sum(r["doc_id"] is None for r in kept) == nulls
    assert jaccard_join.remove_near_duplicates(empty, limit=limit).count() == 0 == jaccard_join.jaccard_join(empty).count()


def test_components_of_a_long_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(map(tuple, jaccard_join.components(edges).collect()))
    assert got == {i: 0 for i in range(1, n + 1)} | {101: 100}


def brute_cost(pieces, costs, window):
    f = [0.0] + [float("inf")] * len(pieces)
    for j in range(1, len(pieces) + 1):
        for i in range(j):
            n = sum(pieces[i:j])
            if n <= window:
                f[j] = min(f[j], f[i] + window - n + costs[j - 1])
    return f[-1]


def test_cuts_are_the_best():
    rng = random.Random(10)
    for _ in range(300):
        window = rng.randint(3, 20)
        pieces = [rng.randint(1, window) for _ in range(rng.randint(1, 14))]
        costs = [rng.choice([0, 1, 5]) for _ in pieces]
        cuts, cost = packing.best_cuts(pieces, costs, window)
        assert abs(cost - brute_cost(pieces, costs, window)) < 1e-9 and cuts[-1] == len(pieces)
        ends = [0, *cuts]
        total = sum(window - sum(pieces[i:j]) + costs[j - 1] for i, j in zip(ends, ends[1:]))
        assert abs(total - cost) < 1e-9 and all(sum(pieces[i:j]) <= window for i, j in zip(ends, ends[1:]))


def sentence_lengths(t):
    """By a regular expression over the words and what is between them."""
    out, n = [], 0
    for m in re.finditer(r"([^ \t\n\v\f\r]+)([ \t\n\v\f\r]*)", t or ""):
        n += 1
        if m[1][-1] in ".!?" or "\n" in m[2] or "\r" in m[2]:
            out.append(n)
            n = 0
    return out + [n] * (n > 0)


def brute_windows(rows, window=packing.WINDOW, shard=packing.SHARD):
    """(doc_ids, starts, ends) of the windows of rows with distinct doc_ids, by the quadratic dynamic programme over each shard's cuts."""
    out, at = [], 0
    rows = sorted(((r["doc_id"], sentence_lengths(r["text"])) for r in rows if sentence_lengths(r["text"])), key=lambda r: (r[0] is not None, r[0] or 0))
    shards = {}
    for d, lengths in rows:
        shards.setdefault(at // shard, []).append((d, lengths))
        at += sum(lengths)
    for docs in shards.values():
        cuts = [(0, 0.0)]  # words before it, cost
        starts = {}
        for d, lengths in docs:
            starts[d] = cuts[-1][0]
            for n in lengths:
                while n > window:
                    cuts.append((cuts[-1][0] + window, packing.HARD))
                    n -= window
                cuts.append((cuts[-1][0] + n, packing.SENTENCE))
            cuts[-1] = (cuts[-1][0], 0.0)
        f, came, low = [0.0], [0], 0
        for j in range(1, len(cuts)):
            while cuts[j][0] - cuts[low][0] > window:
                low += 1
            f.append(min(f[i] + window - (cuts[j][0] - cuts[i][0]) + cuts[j][1] for i in range(low, j)))
            came.append(next(i for i in range(low, j) if f[i] + window - (cuts[j][0] - cuts[i][0]) + cuts[j][1] == f[j]))
        ends, j = [], len(cuts) - 1
        while j:
            ends.append((cuts[came[j]][0], cuts[j][0]))
            j = came[j]
        order = [(d, starts[d], starts[d] + sum(lengths)) for d, lengths in docs]
        for lo, hi in reversed(ends):
            part = [(d, max(lo, s) - s, min(hi, e) - s) for d, s, e in order if s < hi and e > lo]
            out.append(tuple(map(tuple, zip(*part))))
    return out


@pytest.mark.parametrize("factor", [1, 1 << 30])
def test_windows_are_those_of_brute_force_whatever_the_ids(spark, factor):
    rng = random.Random(17)
    texts = [" ".join(sentence(rng, rng.choice([1, 3, 8, 20, 50, 90])) for _ in range(rng.randint(1, 6))) for _ in range(200)]
    docs = spark.createDataFrame([row(i * factor, t) for i, t in enumerate(texts)] + [row(None, sentence(rng)), row(5 * factor + 1 if factor > 1 else 1000, None)], SCHEMA)
    for window, shard in ((64, 1500), (64, 1 << 22), (128, 5000)):
        got = packing.pack(docs, window=window, shard=shard).orderBy("shard", "window").collect()
        assert [(tuple(r["doc_ids"]), tuple(r["starts"]), tuple(r["ends"])) for r in got] == brute_windows(docs.collect(), window, shard)
        assert len({r["shard"] for r in got}) > 5 or shard > 5000 or window == 128


def test_packing_of_ids_that_are_strings(spark):
    docs = spark.createDataFrame([(f"d{i:03}", "One two three. Four five.") for i in range(50)] + [(None, "x")], "doc_id string, text string")
    got = packing.pack(docs, window=16, shard=100).orderBy("shard", "window").collect()
    order = [d for r in got for d in r["doc_ids"]]
    assert order[0] is None and order[1:] == sorted(order[1:]) and set(order[1:]) == {f"d{i:03}" for i in range(50)}


def test_packing_holds_every_word_in_order(spark, hard, empty):
    for window in (16, packing.WINDOW):
        got = packing.pack(hard, window=window).orderBy("shard", "window").collect()
        words_in = {}
        for r in got:
            assert 0 < r["n_words"] <= window and r["padding"] == window - r["n_words"]
            for d, s, e in zip(r["doc_ids"], r["starts"], r["ends"]):
                words_in[d] = words_in.get(d, 0) + e - s
        want = {}
        for r in hard.collect():
            if n := sum(sentence_lengths(r["text"])):
                want[r["doc_id"]] = want.get(r["doc_id"], 0) + n
        assert words_in == want
        order = [d for r in got for d in r["doc_ids"] if d is not None]
        assert order == sorted(order)
    assert packing.pack(empty).count() == 0


def test_rules_are_gated_by_their_keywords():
    assert len(licenses.RULES) >= 200
    for name, _, keyword, expression in licenses.RULES:
        re.compile(expression)
        assert any(r in keyword for r in licenses.ROOTS), (name, keyword)


def test_overlaps_are_resolved():
    found = lambda t: [licenses.RULES[i][0] for i, _, _ in licenses.scan_text(t)]
    assert found("Licensed under the Apache\n License, Version 2.0.") == ["Apache-2.0"]
    assert found("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0-only"]
    assert found("under CC BY-NC-SA 4.0 or the MIT License") == ["CC-BY-NC-SA-4.0", "MIT"]
    assert found("GNU Affero General Public License v3") == ["AGPL-3.0-only"]
    names = lambda t: [n for n, *_ in licenses.detections(t)]
    assert found("SPDX-License-Identifier: MIT OR Apache-2.0") == ["SPDX-tag"] and names("x SPDX-License-Identifier: MIT OR Apache-2.0.") == ["MIT", "Apache-2.0"]
    assert [n.lower() for n in names("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND xyz-1.0")] == ["gpl-2.0-only", "classpath-exception-2.0", "xyz-1.0"]
    assert found("no licence here") == found("") == licenses.scan_text(None) == []
    t = licenses.normalise("licensed under cc by-nc 4.0, gplv3+, BSD Zero Clause and the openrail-m licence")
    everything = [(i, m.start(), m.end()) for i, r in enumerate(licenses.RULES) for m in re.finditer(r[3], t)]
    assert licenses.resolve(everything) == licenses.scan_text(t)


def plain_resolve(found):
    """Each candidate against all that are taken."""
    kept = []
    for rule, start, end in sorted(set(found), key=lambda f: (-licenses.RULES[f[0]][1], f[1] - f[2], f[1], f[0])):
        higher = [k for k in kept if licenses.RULES[k[0]][1] > licenses.RULES[rule][1]]
        if not any(s <= start and end <= e for _, s, e in kept) and not any(start <= s and e <= end for _, s, e in higher):
            kept.append((rule, start, end))
    return sorted(kept, key=lambda f: (f[1], f[2], f[0]))


def test_overlaps_against_all_pairs():
    rng = random.Random(18)
    for _ in range(500):
        found = [(rng.randrange(len(licenses.RULES)), s, s + rng.randint(1, 12)) for s in (rng.randint(0, 40) for _ in range(rng.randint(0, 25)))]
        assert licenses.resolve(found) == plain_resolve(found)


def test_very_long_texts_of_detections():
    t = "licensed under cc by 4.0. " * 40_000
    began = time.time()
    assert len(licenses.scan_text(t)) == 40_000 and time.time() - began < 20


def test_licenses_without_a_prefilter(spark, hard, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: [(d["rule"], d["start"], d["end"]) for d in r["detections"]] for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        t = licenses.normalise(r["text"])
        assert got[r["doc_id"]] == licenses.resolve([(i, m.start(), m.end()) for i, x in enumerate(licenses._compiled()[1]) for m in x.finditer(t)])
    assert licenses.scan(hard).count() == hard.count() and licenses.scan(empty).count() == 0


def test_licenses_with_any_white_space(spark):
    spaces = [chr(c) for c in range(0x110000) if re.fullmatch(r"\s", chr(c))]
    texts = [t.replace(" ", x) for x in spaces for t in ("CC BY-SA 4.0", "all rights reserved", "in the public domain")]
    got = {r["doc_id"]: r["n_detections"] for r in licenses.scan(spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert all(got[i] == len(licenses.scan_text(t)) > 0 for i, t in enumerate(texts))


def test_tokens_are_those_of_merging(spark, hard, empty):
    import tiktoken

    v = bpe.vocabulary(bpe.VOCABULARY)
    reference = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(11)
    texts = [sentence(rng) for _ in range(50)] + ["", " ", "\n\n  x", "naïve façade 東京 🙂🙂", "<|endoftext|>", "a" * 3000, "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(2000)), "abcabc " * 50]
    assert bpe.encode_texts(texts) == [reference.encode_ordinary(t) for t in texts]
    assert [bpe.decode_tokens(t) for t in bpe.encode_texts(texts)] == texts
    got = bpe.round_trip(hard).collect()
    assert len(got) == hard.count() and all(r["same"] in (True, None) for r in got) and bpe.encode(empty).count() == 0
    with pytest.raises(KeyError):
        bpe.decode_tokens([10**9])


def test_a_forgetful_encoder_gives_the_same(monkeypatch):
    rng = random.Random(12)
    texts = [sentence(rng) for _ in range(20)]
    want = bpe.encode_texts(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    e = bpe.Encoder(bpe.vocabulary(bpe.VOCABULARY))
    for t, w in zip(texts, want):
        assert e.encode_texts([bpe._pattern(bpe.PATTERN).findall(t)])[0].tolist() == w


def test_very_long_words_take_linear_time():
    e, took = bpe.Encoder(bpe.vocabulary(bpe.VOCABULARY)), []
    for n in (20_000, 200_000):
        word = "".join(random.Random(n).choice("abcdefgh") for _ in range(n))
        began = time.time()
        e.encode_words([word])
        took.append(time.time() - began)
    assert took[1] < 40 * took[0] + 1 and len(e.tokens) > 50_000
    v = bpe.vocabulary(bpe.VOCABULARY)
    assert b"".join(v.tokens[x] for x in e.tokens[e.ends[1] :]).decode() == word
    monkey = [v.follows(1, x) for x in range(300)]
    v.apart.clear()
    assert [v.follows(1, x) for x in range(300)] == monkey


def test_what_isnt_restored_is_told():
    flat, off, _ = bpe._encode(["abc def", None, "xyz"], bpe.VOCABULARY, bpe.PATTERN)
    block = lambda *t: pa.array(t, pa.large_string())
    told = lambda b: bpe._restores(flat, off, b, bpe.VOCABULARY).tolist()
    assert told(block("abc def", None, "xyz")) == [True, True, True] and told(block("abc dff", None, "xyz")) == [False, True, True] and told(block("abc def", None, "xyzz")) == [True, True, False]


def pipeline_documents(docs, labels):
    """Rows that the filters and the brute-force removal of near duplicates leave, and how many of those have no doc_id."""
    keep = Counter((r["doc_id"], r["lang"], r["perplexity"], r["keep"]) for r in quality_rules.quality_rules(docs).collect())
    rejected = {d for d, _, _, k in keep if not k}
    assert not any(k and d in rejected for d, _, _, k in keep), "the test needs one verdict for a doc_id"
    docs = docs.where(docs.doc_id.isNull() | ~docs.doc_id.isin(list(rejected)))
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect() if r["toxic"]}
    return docs.where(docs.doc_id.isNull() | ~docs.doc_id.isin(list(toxic))).collect()


def test_pipeline_is_its_stages_one_after_the_other(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    rows = pipeline_documents(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    stay = set(brute_keep(rows)[0])
    want = brute_windows([r for r in rows if r["doc_id"] in stay])
    got = corpus_pipeline.run(spark, d).orderBy("shard", "window").collect()
    assert [(tuple(r["doc_ids"]), tuple(r["starts"]), tuple(r["ends"])) for r in got] == want
    assert len(corpus_pipeline.STAGES) == 4


def test_pipeline_of_hard_rows_and_empty_tables(spark, hard, empty, labels, tmp_path):
    import corpus_pipeline

    for name, docs in (("hard", hard), ("empty", empty)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.read.parquet(f"{tmp_path}/hard/documents.parquet"), f"{tmp_path}/hard")
        assert out.columns == hard.columns and out.count() > 20, name
    rows = toxicity.filter_documents(quality_rules.filter_documents(hard), labels).collect()
    ids, nulls = brute_keep(rows)
    own = Counter()
    for r in rows:
        own[r["doc_id"]] += sum(sentence_lengths(r["text"]))
    words_in, order = Counter(), []
    for r in corpus_pipeline.run(spark, f"{tmp_path}/hard").orderBy("shard", "window").collect():
        for d, s, e in zip(r["doc_ids"], r["starts"], r["ends"]):
            words_in[d] += e - s
            order.append(d)
    single = [d for d in set(ids) if sum(r["doc_id"] == d for r in rows) == 1 and own[d]]
    assert len(single) > 20 and all(words_in[d] == own[d] for d in single) and words_in[None] == own[None]
    assert set(words_in) - {None} == {d for d in ids if own[d]} and [d is None for d in order] == sorted((d is None for d in order), reverse=True)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
