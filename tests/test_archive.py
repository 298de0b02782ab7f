"""Archives of file trees and tables: creation, probing, extraction, faults."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata import errors
from strata.functions import bits
from strata.operators import dedup, layout, manifest
from strata.options import Options
from strata.plans import archive
from strata.sources import container, files

FAST = {"rounds": 50}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("in") / "root"
    rng = random.Random(1)
    common = rng.randbytes(20000)
    content = {"a.txt": b"hello" * 999, "empty": b"", ".bashrc": b"x", "sub/copy1.bin": common, "sub/copy2.bin": common, "sub/shifted.bin": b"?" + common, "sub/deep/é ü.dat": rng.randbytes(3000), "zeros.bin": bytes(50000), "sub/a.tar.gz": b"\1\2" * 700}
    for name, data in content.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
        os.utime(p, (1_600_000_000, 1_600_000_000))
    (root / "none").mkdir()
    os.chmod(root / "a.txt", 0o640)
    os.symlink("a.txt", root / "link")
    return root, content


def restored(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(folder) for f in fs}


def test_scan(spark, tree):
    root, content = tree
    got = {r["path"]: r for r in files.scan(spark, [str(root)]).collect()}
    assert {p for p, r in got.items() if r["type"] == "f"} == {f"root/{n}" for n in content}
    assert {p for p, r in got.items() if r["type"] == "d"} == {"root", "root/sub", "root/sub/deep", "root/none"}
    assert got["root"]["size"] == sum(map(len, content.values())) and got["root/none"]["size"] == 0
    assert got["root/a.txt"]["permissions"] == int(f"{0o640:09b}"[::-1], 2)
    with pytest.raises(errors.InvalidArgument):
        files.scan(spark, [str(root), str(root / "sub")])
    with pytest.raises(errors.NotFound):
        files.scan(spark, [str(root) + "?"])
    both = files.scan(spark, [str(root / "a.txt"), str(root / "sub")], skip=(str(root / "a.txt"),))
    assert "a.txt" not in {r["path"] for r in both.collect()}


@pytest.mark.parametrize("options", [Options(max_block=4096), Options(("delta", "lzma", "aes256"), 1, "secret", True, False, 30000, FAST), Options((), 0, None, False, True, 1 << 20)])
def test_extraction_gives_back_the_tree(spark, tree, tmp_path, options):
    root, content = tree
    path = str(tmp_path / "x.stra")
    archive.create_archive(files.scan(spark, [str(root)]), path, options)
    assert archive.is_encrypted(path) == ("aes256" in options.codecs)
    n = archive.extract_archive(spark, path, str(tmp_path / "out"), options.password, FAST)
    assert restored(tmp_path / "out") == {f"root/{k}": v for k, v in content.items()} and n == len(content) + 4
    s = os.stat(tmp_path / "out/root/a.txt")
    assert s.st_mode & 0o777 == 0o640 and s.st_mtime == 1_600_000_000 and (tmp_path / "out/root/none").is_dir()
    with pytest.raises(errors.CannotWrite):
        archive.extract_archive(spark, path, str(tmp_path / "out"), options.password, FAST)
    assert restored(tmp_path / "out") == {f"root/{k}": v for k, v in content.items()}
    if options.dedup:
        blocks = container.headers(path)[1]
        assert sum(r[2] for b in blocks for r in b.refs) >= (20000 if options.max_block > 20001 else 1000)
    if options.password:
        with pytest.raises(errors.WrongPassword):
            archive.read_entries(spark, path, "wrong", FAST)


def test_workers_hold_a_block_at_once(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    entries = manifest.from_table(spark.createDataFrame([(f"f{i:02}", "ab" * 3000 + str(rng.random())) for i in range(40)], "p string, t string"), F.col("p"), F.col("t"))
    path = str(tmp_path / "b.stra")
    archive.create_archive(entries, path, Options(("zlib",), dedup=False, max_block=8192))
    reader = container._Reader(path, 1 << 30)
    (partition,) = reader.partitions()
    assert [b.num_rows for b in reader.read(partition)] == [1] * (len(container.headers(path)[1]))
    frames, plain = [], type(entries).mapInArrow
    monkeypatch.setattr(type(entries), "mapInArrow", lambda self, f, schema, *a: frames.append(f) or plain(self, f, schema, *a))
    archive.read_payloads(spark, path)
    blocks = [b for b in reader.read(partition) if b.column(0)[0].as_py() == container.DATA]
    out = list(frames[-1]([pa.Table.from_batches(blocks).combine_chunks().to_batches()[0]]))
    assert len(out) == len(blocks) > 20 and all(sum(len(x) for x in b.column(3).to_pylist()) <= 8192 for b in out)


def test_a_password_is_never_dropped(spark, tree, tmp_path):
    for codecs in (("zlib",), ()):
        with pytest.raises(errors.WrongPassword):
            archive.create_archive(files.scan(spark, [str(tree[0])]), str(tmp_path / "y"), Options(codecs, password="p"))
    with pytest.raises(errors.UnknownCodec):
        archive.create_archive(files.scan(spark, [str(tree[0])]), str(tmp_path / "y"), Options(("nothing",)))
    assert not os.path.exists(tmp_path / "y")


def test_every_changed_byte_is_noticed(spark, tmp_path):
    entries = manifest.from_table(spark.createDataFrame([("a/x", "hello " * 30), ("a/y", "world"), ("b", "")], "p string, t string"), F.col("p"), F.col("t"))
    path = str(tmp_path / "z.stra")
    archive.create_archive(entries, path, Options(("zlib",)))
    data = open(path, "rb").read()
    assert {r["path"]: bytes(r["data"]) for r in archive.read_files(spark, path).collect()} == {"a/x": b"hello " * 30, "a/y": b"world", "b": b""}

    def whole(x):
        with open(path, "wb") as f:
            f.write(x)
        reader = container._Reader(path, 1 << 20)
        return [b for p in reader.partitions() for b in reader.read(p)]

    assert len(whole(data)) == 2
    for i in range(len(data)):
        with pytest.raises(errors.StrataError):
            whole(data[:i] + bytes([data[i] ^ 0x10]) + data[i + 1 :])
        with pytest.raises(errors.StrataError):
            whole(data[:i])


def test_empty_tables(spark, tmp_path):
    entries = manifest.from_table(spark.createDataFrame([], "p string, t string"), F.col("p"), F.col("t"))
    path = str(tmp_path / "e.stra")
    archive.create_archive(entries, path)
    assert archive.read_files(spark, path).count() == 0 and archive.extract_archive(spark, path, str(tmp_path / "o")) == 0


def test_positions_and_places(spark):
    sizes = [0, 5, 0, 0, 7, 100, 0, 1]
    e = spark.createDataFrame([("f", f"p{i}", s) for i, s in enumerate(sizes)], "type string, path string, size long")
    placed = layout.positions(e, ["path"])
    at = {r["path"]: r["global_pos"] for r in placed.collect()}
    assert [at[f"p{i}"] for i in range(8)] == [sum(sizes[:i]) for i in range(8)]
    points = spark.createDataFrame([(i,) for i in range(115)], "pos long")
    got = {r["pos"]: (r["path"], r["offset"]) for r in layout.locate(placed, points, 10).collect()}
    flat = [(f"p{i}", k) for i, s in enumerate(sizes) for k in range(s)]
    assert [got[i] for i in range(113)] == flat and got[114] == (None, None)
    starts = spark.createDataFrame([(3,), (50,), (51,)], "pos long")
    asof = {r["pos"]: r["start"] for r in layout.as_of(points, starts, 8).collect()}
    assert asof == {i: None if i < 3 else 3 if i < 50 else 50 if i < 51 else 51 for i in range(115)}


def test_names_and_permissions(spark):
    d = spark.createDataFrame([(p,) for p in ("a/.bashrc", "a.tar.gz", "x/y", "d.x/z", "w.", "..b")], "p string")
    assert [r[0] for r in d.select(bits.extension(F.col("p"))).collect()] == ["", ".gz", "", "", ".", ".b"]
    got = spark.range(512).select("id", bits.reverse_permissions(bits.reverse_permissions(F.col("id").cast("int"))).alias("x")).collect()
    assert all(r["id"] == r["x"] for r in got)


def test_references_are_made_one(spark):
    rows = [(1, 0, 100, 10), (1, 10, 110, 5), (1, 15, 300, 5), (1, 30, 305, 5), (2, 0, 200, 1)]
    r = spark.createDataFrame(rows, "g int, copy_pos long, original_pos long, length long")
    got = sorted((x["g"], x["copy_pos"], x["original_pos"], x["length"], x["parts"]) for x in dedup.coalesce_references(r, ["g"]).collect())
    assert got == [(1, 0, 100, 15, 2), (1, 15, 300, 5, 1), (1, 30, 305, 5, 1), (2, 0, 200, 1, 1)]


def test_pieces_of_long_texts_are_hashed_in_linear_time(spark):
    import hashlib
    import time

    from strata.operators import chunking

    texts = ["é" * 100 + "ab", None, "", "x" * 64, "plain " * 30, "日本語" * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = sorted((r["k"], r["pos"], r["length"], r["h1"], r["h2"]) for r in chunking.fixed_hashes(d, "k", "t", 64).collect())
    half = lambda x, i: int.from_bytes(hashlib.sha256(x.encode()).digest()[i : i + 8], "little", signed=True)
    assert got == sorted((k, p, len(t[p : p + 64]), half(t[p : p + 64], 0), half(t[p : p + 64], 8)) for k, t in enumerate(texts) for p in range(0, len(t or ""), 64))
    long = spark.createDataFrame([(1, "été " * 1_000_000)], "k long, t string")
    began = time.time()
    assert chunking.fixed_hashes(long, "k", "t", 64).selectExpr("count(*)", "sum(length)").first()[:] == (62500, 4_000_000)
    assert time.time() - began < 30


def test_streams_are_deduplicated(spark, tmp_path):
    from strata.streaming.incremental import dedup_stream

    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for k in range(2):
        spark.createDataFrame([("a", 5 + k), ("b", 7), (f"c{k}", 9)], "hash string, pos long").write.mode("append").parquet(source)
        dedup_stream(spark.readStream.schema("hash string, pos long").parquet(source), table, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["hash"], r["pos"]) for r in spark.read.parquet(table).collect()) == [("a", 5), ("b", 7), ("c0", 9), ("c1", 9)]


def test_entry_module(spark):
    import __spark_entry__

    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 30
    assert __spark_entry__.entry(spark).count() > 0


def test_command_line(spark, tree, tmp_path, monkeypatch):
    from strata.__main__ import main

    monkeypatch.setattr("pyspark.sql.SparkSession.stop", lambda self: None)
    path = str(tmp_path / "c.stra")
    assert main(["a", path, str(tree[0]), "--level", "1", "--no-filter"]) == 0
    assert main(["x", path, str(tmp_path / "o")]) == 0
    assert restored(tmp_path / "o") == {f"root/{k}": v for k, v in tree[1].items()}
    assert main(["x", path, str(tmp_path / "o")]) == -errors.CannotWrite.code


def test_progress_and_abort(spark):
    from strata.plans.progress import smoothed, watched

    seen = []
    with watched(spark, lambda p: seen.append(p) or True, 0.05):
        spark.range(0, 3_000_000, 1, 6).selectExpr("sum(id * id)").collect()
    with pytest.raises(errors.Aborted), watched(spark, lambda p: False, 0.05):
        spark.range(0, 1 << 40, 1, 4).selectExpr("sum(sqrt(id))").collect()
    assert spark.range(5).count() == 5 and smoothed(64.0, 0.0) == 63.0


def test_windows_bound_references(spark):
    rows = [(b"x", 600, p) for p in (0, 1000, 9000, 9500)] + [(b"y", 10, 700), (b"y", 10, 710)]
    c = spark.createDataFrame(rows, "hash binary, length long, global_pos long")
    marked = lambda **k: {r["global_pos"]: r["original_pos"] for r in dedup.mark_references(c, **k).collect()}
    assert marked() == {0: None, 1000: 0, 9000: 0, 9500: 0, 700: None, 710: None}
    assert marked(window=5000) == {0: None, 1000: 0, 9000: None, 9500: 9000, 700: None, 710: None}
