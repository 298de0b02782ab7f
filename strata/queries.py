"""The library's own queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import os
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata import shared
from strata.functions import bits, codecs, crypto, filters, recency
from strata.functions.checksums import crc16_column
from strata.operators import chunking, dedup, layout, manifest, stats
from strata.options import LEVELS, Options, memory_estimate
from strata.plans import archive
from strata.sources import files

BLOCK = 65536


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    shared.bound_batches(spark)
    return spark.read.parquet(f"{d}/{table}.parquet")


def _entries(spark: SparkSession, d: str, payload: bool = False) -> DataFrame:
    """documents as files: source is the folder, doc_id the name, lang the extension."""
    path = F.concat_ws("", "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("."), "lang")
    out = manifest.from_table(_read(spark, d, "documents"), path, F.col("text"), doc_id=F.col("doc_id"))
    return out if payload else out.drop("payload")


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return layout.positions(manifest.solid_key(_entries(spark, d)), list(manifest.SOLID))


def manifest_global_pos(spark, d):
    return _placed(spark, d).select("doc_id", "ext", "size", "global_pos")


def block_map_solid(spark, d):
    return layout.solid_blocks(_placed(spark, d), BLOCK).select("block_id", "doc_id", "begin", "length", "at")


def block_map_per_file(spark, d):
    return layout.file_blocks(_placed(spark, d), 4096).select("block_id", "doc_id", "begin", "length")


def block_bytes(spark, d):
    return block_map_solid(spark, d).groupBy("block_id").agg(F.sum("length").alias("n_bytes"), F.count("*").alias("n_files"))


def _points(placed):
    return layout.solid_blocks(placed, BLOCK).select((F.col("block_id") * BLOCK).alias("pos")).distinct()


def locate_blocks(spark, d):
    placed = shared.cut(_placed(spark, d))
    return layout.locate(placed, _points(placed)).select("pos", F.regexp_extract("path", r"/0*(\d+)\.", 1).cast("long").alias("doc_id"), "offset")


def asof_locate(spark, d):
    placed = shared.cut(_placed(spark, d))
    return layout.as_of(_points(placed), placed.where("size > 0").select(F.col("global_pos").alias("pos")), BLOCK)


def dir_contained_size(spark, d):
    p = _read(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"[?#].*$", "").alias("path"), F.octet_length("html").cast("long").alias("size"), F.lit("f").alias("type"))
    return manifest.contained_sizes(p)


def byte_histogram(spark, d):
    return stats.histogram(_read(spark, d, "documents"), "lang", "text")


def byte_entropy_by_lang(spark, d):
    return stats.entropy(byte_histogram(spark, d), ["lang"]).select("lang", "n_bytes", F.round("entropy", 9).alias("entropy"))


def entropy_by_alignment(spark, d):
    return stats.entropy_by_position(_read(spark, d, "documents"), "doc_id", "text").select("doc_id", "k", F.round("entropy", 6).alias("entropy"))


def alignment_choice(spark, d):
    return stats.alignment_choice(_read(spark, d, "documents"), "doc_id", "text")


def stride_mode(spark, d):
    return stats.stride_mode(_read(spark, d, "documents"), "doc_id", "text")


def literal_modes(spark, d):
    return stats.literal_modes(_read(spark, d, "documents"), "doc_id", "text")


def fixed_chunk_dedup(spark, d):
    c = chunking.fixed_hashes(_read(spark, d, "documents"), "doc_id", "text", 256)
    c = c.withColumn("id", F.struct("doc_id", "pos"))
    first = dedup.first_by_window(c, ["h1", "h2"], "id")
    return first.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count(F.when(F.col("original") < F.col("id"), 1)).alias("n_duplicates"), F.coalesce(F.sum(F.when(F.col("original") < F.col("id"), F.col("length"))), F.lit(0)).alias("duplicate_length"))


def exact_duplicate_docs(spark, d):
    c = _read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return dedup.first_occurrence(c, ["hash"], "doc_id").where("original < doc_id").select("doc_id", F.col("original").alias("original_id"), "hash")


def _refs(spark, d):
    c = chunking.fixed_hashes(_read(spark, d, "documents"), "doc_id", "text", 64).where("length = 64").drop("length")
    c = c.withColumn("id", F.col("doc_id") * (1 << 32) + F.col("pos"))
    return dedup.first_by_window(c, ["h1", "h2"], "id").where("original < id").select("doc_id", F.col("pos").alias("copy_pos"), F.col("original").alias("original_pos"), F.lit(64).cast("long").alias("length"))


def dedup_coalesce(spark, d):
    return dedup.coalesce_references(_refs(spark, d), ["doc_id"])


def delta_copy_pos(spark, d):
    return dedup.delta_positions(dedup_coalesce(spark, d), ["doc_id"]).select("doc_id", "copy_pos", "length", "copy_delta")


def delta_copy_pos_roundtrip(spark, d):
    x = dedup.delta_positions(dedup_coalesce(spark, d), ["doc_id"]).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("copy_pos"))).drop("copy_pos")
    return dedup.undelta_positions(x, ["doc_id"], "n").select("doc_id", "copy_pos", "length")


def cdc_chunks(spark, d):
    return chunking.content_chunks(_read(spark, d, "documents"), "doc_id", "text").withColumn("hash", F.lower(F.hex("hash")))


def cdc_dedup_ratio(spark, d):
    c = cdc_chunks(spark, d).join(_read(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("id", F.struct("doc_id", "pos"))
    big = dedup.first_occurrence(c.where(f"length >= {dedup.LEAST_CHUNK}"), ["hash", "length"], "id")
    return big.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum("length").alias("n_bytes"), F.sum(F.when(F.col("original") < F.col("id"), F.col("length")).otherwise(0)).alias("duplicate_bytes"))


def cdc_covers(spark, d):
    """Chunks of every document lie end to end and cover it."""
    c = cdc_chunks(spark, d).groupBy("doc_id").agg(F.sum("length").alias("n_bytes"), F.max(F.col("pos") + F.col("length")).alias("end_pos"))
    return c


def _events(spark, d):
    return _read(spark, d, "events").select("user_id", "event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("us"))


def lpc_order(k):
    return lambda spark, d: dedup.differences(_events(spark, d), ["user_id"], ["event_id"], "us", k).select("user_id", "event_id", "delta")


def lpc_roundtrip(spark, d):
    x = dedup.differences(_events(spark, d), ["user_id"], ["event_id"], "us", 3)
    return dedup.undifferences(x, ["user_id"], ["event_id"], 3).select("user_id", "event_id", F.col("restored").alias("us"))


def perm_bits(spark, d):
    return spark.range(512).select(F.col("id").cast("int").alias("mode"), bits.reverse_permissions(F.col("id").cast("int")).alias("permissions"))


def leb128_size(spark, d):
    return _read(spark, d, "lineitem").groupBy(bits.varint_size(F.col("l_partkey")).alias("n_bytes")).agg(F.count("*").alias("n"), F.sum(bits.varint_size(F.col("l_orderkey"))).cast("long").alias("order_bytes"))


def path_parts(spark, d):
    p = manifest.solid_key(_entries(spark, d))
    return p.select("doc_id", "filename", "ext")


def crc32_payload(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.crc32("text").alias("crc32"), crc16_column(F.col("text").cast("binary")).alias("crc16"))


def sha256_payload(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def _blocks(spark, d):
    """documents of a source put together in blocks of 256."""
    t = _read(spark, d, "documents").withColumn("block", F.expr("doc_id div 256"))
    return t.groupBy("source", "block").agg(F.encode(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), ""), "UTF-8").alias("data")).withColumn("id", F.col("block") * 1000 + F.regexp_replace("source", "[^0-9]", "").cast("long"))


def codec_ratio_by_source(spark, d):
    b = _blocks(spark, d)
    e = codecs.encode_column(b, "id", "data", ("delta", "zlib"))
    return e.groupBy((F.col("id") % 1000).alias("source_no")).agg(F.sum(F.element_at("sizes", 1)).alias("n_bytes"), F.sum(F.element_at("sizes", -1)).alias("stored_bytes"))


def codec_roundtrip(spark, d):
    t = _read(spark, d, "pages")
    e = codecs.encode_column(t, "page_id", "html", ("delta", "zlib"))
    return codecs.decode_column(e, "page_id", ("delta", "zlib")).select("page_id", F.decode("data", "UTF-8").alias("html"))


def encrypted_roundtrip(spark, d):
    """Spark's own authenticated encryption of a payload, and back."""
    t, key = _read(spark, d, "pages"), F.unhex(F.sha2(F.lit("a test key"), 256))
    e = t.select("page_id", F.aes_encrypt(F.col("html").cast("binary"), key, F.lit("GCM")).alias("sealed"))
    return e.select("page_id", F.decode(F.aes_decrypt("sealed", key, F.lit("GCM")), "UTF-8").alias("html"))


def archive_roundtrip(spark, d):
    """All documents into an archive in the shared folder, with deduplication and codecs, and back."""
    path = f"{shared.folder(spark).removeprefix('file:').replace('///', '/', 1)}/{uuid.uuid4().hex}.stra"
    archive.create_archive(_entries(spark, d, True).drop("doc_id"), path, Options(max_block=1 << 20))
    f = archive.read_files(spark, path)
    return f.select(F.regexp_extract("path", r"/0*(\d+)\.", 1).cast("long").alias("doc_id"), F.decode("data", "UTF-8").alias("text"))


def memory_estimates(spark, d):
    rows = [(level, threads, memory_estimate(Options.of_level(level), threads)) for level in LEVELS for threads in (1, 8)]
    return spark.createDataFrame(rows, "level int, threads int, n_bytes long")


def _path(spark, suffix: str = "") -> str:
    return f"{shared.folder(spark).removeprefix('file:').replace('///', '/', 1)}/{uuid.uuid4().hex}{suffix}"


def archive_entries(spark, d):
    """What an archive of all documents says of its files: order, positions, sizes and permissions."""
    path = _path(spark, ".stra")
    archive.create_archive(_entries(spark, d, True).drop("doc_id"), path, Options(("zstd",), max_block=1 << 20))
    return archive.read_entries(spark, path).select("path", "type", "size", "global_pos", bits.reverse_permissions(F.col("permissions")).alias("mode"))


def _restored(spark, d) -> str:
    path, folder = _path(spark, ".stra"), _path(spark)
    archive.create_archive(_entries(spark, d, True).drop("doc_id"), path, Options(("delta", "zstd"), max_block=1 << 20))
    archive.extract_archive(spark, path, folder)
    return folder


def _scanned(spark, folder: str) -> DataFrame:
    return files.scan(spark, sorted(e.path for e in os.scandir(folder)))


def restored_tree(spark, d):
    """All documents as files: archived, extracted and scanned again, each folder of the top being a root."""
    return _scanned(spark, _restored(spark, d)).select("path", "type", "size", F.when(F.col("type") == "f", bits.reverse_permissions(F.col("permissions"))).alias("mode"), F.when(F.col("type") == "f", F.unix_seconds("mtime")).alias("mtime"))


def restored_halves(spark, d):
    """Hash of the second half of each extracted file, by a positioned read of it."""
    t = _scanned(spark, _restored(spark, d)).where("type = 'f'")
    t = t.withColumn("begin", F.expr("size div 2")).withColumn("length", F.col("size") - F.col("begin"))
    return files.read_ranges(t, ["path"]).select("path", F.sha2("data", 256).alias("hash"))


def encrypted_archive(spark, d):
    """All documents through archives with and without a password: what the header says, and the texts read back."""
    out = []
    for password in (None, "a test password"):
        path, settings = _path(spark, ".stra"), {"rounds": 1000}
        names = ("zstd", "aes256") if password else ("zstd",)
        archive.create_archive(_entries(spark, d, True).drop("doc_id"), path, Options(names, password=password, max_block=1 << 20, settings=settings))
        f = archive.read_files(spark, path, password, settings)
        out.append(f.select(F.lit(archive.is_encrypted(path)).alias("encrypted"), F.regexp_extract("path", r"/0*(\d+)\.", 1).cast("long").alias("doc_id"), F.decode("data", "UTF-8").alias("text")))
    return out[0].unionAll(out[1])


def ctr_roundtrip(spark, d):
    """Pages under this library's AES-256 in counter mode, and back; the sealed bytes have a counter of 16 bytes before them."""
    context = codecs.Context(key=bytes(range(32)), nonce=b"a test nonce")
    e = codecs.encode_column(_read(spark, d, "pages"), "page_id", "html", ("aes256",), context)
    back = codecs.decode_column(e, "page_id", ("aes256",), context).withColumnRenamed("page_id", "p")
    sealed = e.select("page_id", F.octet_length("payload").cast("long").alias("n_sealed"))
    return sealed.join(back, F.col("page_id") == F.col("p")).select("page_id", "n_sealed", F.decode("data", "UTF-8").alias("html"))


def derived_keys(spark, d):
    """Key and its check of a password for each language, with 100 rounds."""
    rows = _read(spark, d, "documents").select("lang").distinct()

    def work(batches):
        for batch in batches:
            made = [crypto.derive(x or "", b"a test salt", 100) for x in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([k.hex() for k, _ in made]), pa.array([c.hex() for _, c in made])], names=["lang", "key", "check"])

    return rows.mapInArrow(work, "lang string, key string, check string")


def codec_bounds(spark, d):
    """What each document can take at most under a chain, and whether it takes no more."""
    names = ("delta", "zlib", "aes256")
    e = codecs.encode_column(_read(spark, d, "documents"), "doc_id", "text", names, codecs.Context(key=bytes(32)))

    def work(batches):
        for batch in batches:
            bounds = [codecs.bound_of(x[0], names) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(bounds), pa.array([x[-1] <= b for x, b in zip(batch.column(1).to_pylist(), bounds)])], names=["doc_id", "bound", "kept"])

    return e.select("doc_id", "sizes").mapInArrow(work, "doc_id long, bound long, kept boolean")


def filter_segments(spark, d):
    """Bytes of each document in the segments that the filter makes of it, and whether it is restored."""

    def work(batches):
        for batch in batches:
            data = [(x or "").encode() for x in batch.column(1).to_pylist()]
            coded = [filters.encode(x) for x in data]
            yield pa.record_batch([batch.column(0), pa.array([sum(n for _, n in filters.segments(c)) for c in coded]), pa.array([filters.decode(c) == x for c, x in zip(coded, data)])], names=["doc_id", "n_bytes", "restored"])

    return _read(spark, d, "documents").select("doc_id", "text").mapInArrow(work, "doc_id long, n_bytes long, restored boolean")


def recency_places(spark, d):
    """Each event's type as its place in its user's list of the three last used types, -1 where it isn't there; and whether the list gives it back."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("event_id")
        kinds = t["event_type"].to_pylist()
        codes = recency.encode(kinds, 3)
        return pa.table({"user_id": t["user_id"], "event_id": t["event_id"], "place": pa.array([p for p, _ in codes], pa.int32()), "restored": pa.array([a == b for a, b in zip(recency.decode(codes, 3), kinds)])})

    return _read(spark, d, "events").select("user_id", "event_id", "event_type").groupBy("user_id").applyInArrow(run, "user_id long, event_id long, place int, restored boolean")


def windowed_references(spark, d):
    """Content-defined chunks of the solid order, and the equal chunk less than 64 KiB before each that may stand for it."""
    placed = layout.positions(manifest.solid_key(_entries(spark, d)), list(manifest.SOLID)).select(F.col("doc_id").alias("of"), "global_pos")
    c = cdc_chunks(spark, d).join(placed, F.col("doc_id") == F.col("of")).select("doc_id", "pos", F.col("length").cast("long").alias("length"), "hash", (F.col("global_pos") + F.col("pos")).alias("global_pos"))
    return dedup.mark_references(shared.cut(c), 65536).select("doc_id", "pos", "length", "global_pos", "original_pos")


QUERIES = {
    "manifest_global_pos": manifest_global_pos,
    "block_map_solid": block_map_solid,
    "block_map_per_file": block_map_per_file,
    "block_bytes": block_bytes,
    "locate_blocks": locate_blocks,
    "asof_locate": asof_locate,
    "dir_contained_size": dir_contained_size,
    "byte_histogram": byte_histogram,
    "byte_entropy_by_lang": byte_entropy_by_lang,
    "entropy_by_alignment": entropy_by_alignment,
    "alignment_choice": alignment_choice,
    "stride_mode": stride_mode,
    "fixed_chunk_dedup": fixed_chunk_dedup,
    "exact_duplicate_docs": exact_duplicate_docs,
    "dedup_coalesce": dedup_coalesce,
    "delta_copy_pos": delta_copy_pos,
    "delta_copy_pos_roundtrip": delta_copy_pos_roundtrip,
    "cdc_chunks": cdc_chunks,
    "cdc_dedup_ratio": cdc_dedup_ratio,
    "cdc_covers": cdc_covers,
    "lpc_order1": lpc_order(1),
    "lpc_order2": lpc_order(2),
    "lpc_order3": lpc_order(3),
    "lpc_roundtrip": lpc_roundtrip,
    "perm_bits": perm_bits,
    "leb128_size": leb128_size,
    "path_parts": path_parts,
    "crc32_payload": crc32_payload,
    "sha256_payload": sha256_payload,
    "codec_ratio_by_source": codec_ratio_by_source,
    "codec_roundtrip": codec_roundtrip,
    "encrypted_roundtrip": encrypted_roundtrip,
    "archive_roundtrip": archive_roundtrip,
    "memory_estimates": memory_estimates,
    "literal_modes": literal_modes,
    "archive_entries": archive_entries,
    "restored_tree": restored_tree,
    "restored_halves": restored_halves,
    "encrypted_archive": encrypted_archive,
    "ctr_roundtrip": ctr_roundtrip,
    "derived_keys": derived_keys,
    "codec_bounds": codec_bounds,
    "filter_segments": filter_segments,
    "recency_places": recency_places,
    "windowed_references": windowed_references,
}

_E = "e AS (SELECT doc_id, '.' || lang AS ext, lpad(doc_id::VARCHAR, 20, '0') || '.' || lang AS filename, source || '/' || lpad(doc_id::VARCHAR, 20, '0') || '.' || lang AS path, octet_length(encode(text))::BIGINT AS size FROM documents)"
_P = _E + ", p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY ext, filename, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS global_pos FROM e)"
_B = _P + f", b AS (SELECT *, unnest(range(global_pos // {BLOCK}, (global_pos + size - 1) // {BLOCK} + 1)) AS block_id FROM p WHERE size > 0), m AS (SELECT block_id, doc_id, (greatest(global_pos, block_id * {BLOCK}) - global_pos)::BIGINT AS begin, (least(global_pos + size, (block_id + 1) * {BLOCK}) - greatest(global_pos, block_id * {BLOCK}))::BIGINT AS length, (greatest(global_pos, block_id * {BLOCK}) - block_id * {BLOCK})::BIGINT AS \"at\" FROM b)"
_POINTS = f", pt AS (SELECT DISTINCT (block_id * {BLOCK})::BIGINT AS pos FROM m)"
_HEX = "h AS (SELECT lang, doc_id, regexp_extract_all(hex(encode(text)), '..') AS x FROM {0})"
_BY = "y AS (SELECT doc_id, i - 1 AS pos, x[i] AS byte FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM h))"
_ALIGN = f"WITH {_HEX.format('documents')}, {_BY}, k AS (SELECT doc_id, k::INT AS k, pos % k AS r, byte, count(*) AS n FROM y, unnest([1, 2, 4, 8, 16]) t(k) GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id, k, r) AS p FROM k), z AS (SELECT doc_id, k, r, -sum(p * log2(p)) + 0.0 AS entropy FROM s GROUP BY ALL), al AS (SELECT doc_id, k, round(avg(entropy), 6) AS entropy FROM z GROUP BY ALL)"


def _chunks(n: int) -> str:
    return f"c AS (SELECT doc_id, (k * {n})::BIGINT AS pos, substring(text, k * {n} + 1, {n}) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // {n} + 1)) AS k FROM documents WHERE length(text) > 0)), f AS (SELECT *, doc_id * 4294967296 + pos AS id, sha256(chunk) AS hash, min(doc_id * 4294967296 + pos) OVER (PARTITION BY sha256(chunk)) AS original FROM c)"


_REFS = f"{_chunks(64)}, r AS (SELECT doc_id, pos AS copy_pos, original AS original_pos, 64 AS length FROM f WHERE length(chunk) = 64 AND original < id), w AS (SELECT *, CASE WHEN lag(copy_pos + 64) OVER o = copy_pos AND lag(original_pos + 64) OVER o = original_pos THEN 0 ELSE 1 END AS fresh FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY copy_pos)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY copy_pos) AS island FROM w), g AS (SELECT doc_id, min(copy_pos)::BIGINT AS copy_pos, min(original_pos)::BIGINT AS original_pos, sum(length)::BIGINT AS length, count(*) AS parts FROM i GROUP BY doc_id, island)"
_EV = "v AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events)"


def _lpc(k: int) -> str:
    lag = [f"coalesce(lag(us, {i}) OVER o, 0)" for i in (1, 2, 3)]
    term = {1: f"us - {lag[0]}", 2: f"us - 2 * {lag[0]} + {lag[1]}", 3: f"us - 3 * {lag[0]} + 3 * {lag[1]} - {lag[2]}"}[k]
    return f"WITH {_EV} SELECT user_id, event_id, ({term})::BIGINT AS delta FROM v WINDOW o AS (PARTITION BY user_id ORDER BY event_id)"


_MEMORY = """WITH l(level, log, block) AS (VALUES (0, 0, 1), (1, 16, 8), (2, 16, 8), (3, 17, 16), (4, 17, 16), (5, 18, 32), (6, 18, 32), (7, 19, 64), (8, 19, 64), (9, 20, 128)),
        b AS (SELECT level, block * 1048576::BIGINT AS n, CASE WHEN level < 6 THEN 262144 ELSE 11 * (1::BIGINT << least(26, 18 + level)) END AS hungriest FROM l),
        f AS (SELECT *, n + n // 13 + 32 AS filtered FROM b)
    SELECT level::INT AS level, threads::INT AS threads, ((n + CASE WHEN level = 0 THEN 0 ELSE filtered + filtered + 1 + hungriest END) * threads)::BIGINT AS n_bytes FROM f, (VALUES (1), (8)) t(threads)"""


def _crc(poly: int, start: int) -> str:
    """The list x of bytes under a reflected CRC, by its table."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ poly if i & 1 else i >> 1
        table.append(f"{i}::BIGINT")
    return f"xor(list_reduce(x, lambda c, b: xor(c >> 8, ([{', '.join(table)}])[(xor(c, b) & 255) + 1]), {start}::BIGINT), {start})"


def _xored(terms: list[str]) -> str:
    return reduce(lambda a, b: f"xor({a}, {b})", terms)


_TABLE_SQL = "[" + ", ".join(f"{x}::BIGINT" for x in chunking._TABLE.tolist()) + "]"
#: Chunks: the hash at a place is the XOR of 32 shifted table entries, and a chunk's end is found from the last one's.
_CDC = f"""WITH RECURSIVE {_HEX.format('documents')}, y AS (SELECT doc_id, i - 1 AS pos, ('0x' || x[i])::INT AS byte FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM h WHERE len(x) > {chunking.LEAST})),
        v AS (SELECT doc_id, pos, t.t[byte + 1] AS v FROM y, (SELECT {_TABLE_SQL} AS t) t),
        r AS (SELECT doc_id, pos + k AS place, bit_xor(v >> k) AS hash FROM v, range(32) s(k) GROUP BY ALL),
        cuts AS (SELECT doc_id, list(place ORDER BY place) AS cuts FROM r WHERE hash & {chunking.MASK} = 0 GROUP BY doc_id),
        n AS (SELECT doc_id, len(x) AS n, coalesce(cuts, []) AS cuts FROM h LEFT JOIN cuts USING (doc_id) WHERE len(x) > 0),
        c(doc_id, n, cuts, pos, upto) AS (SELECT doc_id, n, cuts, 0::BIGINT, 0::BIGINT FROM n UNION ALL
            SELECT doc_id, n, cuts, upto, coalesce(list_filter(cuts, lambda p: p >= upto + {chunking.LEAST} AND p < least(n, upto + {chunking.MOST}))[1], least(n, upto + {chunking.MOST})) FROM c WHERE upto < n),
        ch AS (SELECT c.doc_id, pos, (upto - pos)::INT AS length, sha256(encode(text)[pos + 1 : upto]) AS hash FROM c JOIN documents USING (doc_id) WHERE upto > 0)"""

ORACLE = {
    "manifest_global_pos": f"WITH {_P} SELECT doc_id, ext, size, global_pos FROM p",
    "block_map_solid": f"WITH {_B} SELECT block_id, doc_id, begin, length, \"at\" FROM m",
    "block_map_per_file": f"WITH {_P}, k AS (SELECT *, unnest(range(0, (size - 1) // 4096 + 1)) AS k FROM p WHERE size > 0) SELECT (global_pos + k * 4096)::BIGINT AS block_id, doc_id, (k * 4096)::BIGINT AS begin, least(4096, size - k * 4096)::BIGINT AS length FROM k",
    "block_bytes": f"WITH {_B} SELECT block_id, sum(length)::BIGINT AS n_bytes, count(*) AS n_files FROM m GROUP BY block_id",
    "locate_blocks": f"WITH {_B}{_POINTS} SELECT pt.pos, p.doc_id, (pt.pos - p.global_pos)::BIGINT AS \"offset\" FROM pt JOIN p ON p.size > 0 AND pt.pos >= p.global_pos AND pt.pos < p.global_pos + p.size",
    "asof_locate": f"WITH {_B}{_POINTS}, s AS (SELECT global_pos FROM p WHERE size > 0) SELECT pt.pos, s.global_pos AS start FROM pt ASOF JOIN s ON pt.pos >= s.global_pos",
    "dir_contained_size": "WITH p AS (SELECT string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS x, octet_length(encode(html))::BIGINT AS size FROM pages), d AS (SELECT array_to_string(x[1:i], '/') AS dir, size FROM (SELECT x, size, unnest(range(1, len(x))) AS i FROM p)) SELECT dir, sum(size)::BIGINT AS contained_size, count(*) AS n_files FROM d GROUP BY dir",
    "byte_histogram": f"WITH {_HEX.format('documents')}, y AS (SELECT lang, unnest(x) AS b FROM h) SELECT lang, ('0x' || b)::INT AS byte, count(*) AS n FROM y GROUP BY ALL",
    "byte_entropy_by_lang": f"WITH {_HEX.format('documents')}, y AS (SELECT lang, unnest(x) AS b FROM h), c AS (SELECT lang, b, count(*) AS n FROM y GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS p FROM c) SELECT lang, sum(n)::BIGINT AS n_bytes, round(-sum(p * log2(p)) + 0.0, 9) AS entropy FROM s GROUP BY lang",
    "entropy_by_alignment": f"{_ALIGN} SELECT doc_id, k, entropy FROM al",
    "alignment_choice": f"{_ALIGN}, o AS (SELECT doc_id, k, round(entropy + CASE k WHEN 1 THEN 0 WHEN 2 THEN 0.05 WHEN 4 THEN 0.1 WHEN 8 THEN 0.3 ELSE 0.6 END, 6) AS score FROM al) SELECT doc_id, k, score FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score, k) = 1",
    "stride_mode": f"WITH {_HEX.format('documents')}, {_BY}, q AS (SELECT doc_id, len(x) AS size, len(x) // 4 AS q FROM h), st AS (SELECT y.doc_id, j, pos, byte FROM y JOIN q USING (doc_id), range(4) t(j) WHERE pos > j * q AND pos <= j * q + size - 1 - 3 * q), l AS (SELECT doc_id, (pos - coalesce(lag(pos) OVER (PARTITION BY doc_id, j, byte ORDER BY pos), 0)) & 255 AS d FROM st), c AS (SELECT doc_id, d, count(*) AS n FROM l WHERE d > 0 GROUP BY ALL), m AS (SELECT doc_id, d, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, d) = 1) SELECT doc_id, coalesce(d, 1)::INT AS stride, coalesce(n, 0) AS n FROM q LEFT JOIN m USING (doc_id)",
    "fixed_chunk_dedup": f"WITH {_chunks(256)} SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (original < id) AS n_duplicates, coalesce(sum(length(chunk)) FILTER (original < id), 0)::BIGINT AS duplicate_length FROM f GROUP BY doc_id",
    "exact_duplicate_docs": "SELECT doc_id, original_id, hash FROM (SELECT doc_id, sha256(text) AS hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS original_id FROM documents) WHERE original_id < doc_id",
    "dedup_coalesce": f"WITH {_REFS} SELECT doc_id, copy_pos, original_pos, length, parts FROM g",
    "delta_copy_pos": f"WITH {_REFS} SELECT doc_id, copy_pos, length, (copy_pos - coalesce(lag(copy_pos + length) OVER (PARTITION BY doc_id ORDER BY copy_pos), 0))::BIGINT AS copy_delta FROM g",
    "delta_copy_pos_roundtrip": f"WITH {_REFS} SELECT doc_id, copy_pos, length FROM g",
    "cdc_covers": "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, octet_length(encode(text))::BIGINT AS end_pos FROM documents WHERE text <> ''",
    "lpc_order1": _lpc(1),
    "lpc_order2": _lpc(2),
    "lpc_order3": _lpc(3),
    "lpc_roundtrip": f"WITH {_EV} SELECT user_id, event_id, us FROM v",
    "perm_bits": "SELECT i::INT AS mode, (" + " + ".join(f"(((i >> {k}) & 1) << {8 - k})" for k in range(9)) + ")::INT AS permissions FROM range(512) t(i)",
    "leb128_size": "SELECT greatest(1, ceil(length(ltrim(bin(l_partkey), '0')) / 7))::INT AS n_bytes, count(*) AS n, sum(greatest(1, ceil(length(ltrim(bin(l_orderkey), '0')) / 7)))::BIGINT AS order_bytes FROM lineitem GROUP BY 1",
    "path_parts": f"WITH {_E} SELECT doc_id, filename, ext FROM e",
    "sha256_payload": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "codec_roundtrip": "SELECT page_id, html FROM pages",
    "encrypted_roundtrip": "SELECT page_id, html FROM pages",
    "archive_roundtrip": "SELECT doc_id, text FROM documents",
    "memory_estimates": _MEMORY,
    "cdc_chunks": f"{_CDC} SELECT doc_id, pos, length, hash FROM ch",
    "cdc_dedup_ratio": f"{_CDC}, b AS (SELECT ch.*, source, row_number() OVER (PARTITION BY hash, length ORDER BY doc_id, pos) AS k FROM ch JOIN documents USING (doc_id) WHERE length >= {dedup.LEAST_CHUNK}) SELECT source, count(*) AS n_chunks, sum(length)::BIGINT AS n_bytes, coalesce(sum(length) FILTER (k > 1), 0)::BIGINT AS duplicate_bytes FROM b GROUP BY source",
    "windowed_references": f"{_CDC}, {_P}, g AS (SELECT ch.doc_id, ch.pos, ch.length::BIGINT AS length, hash, (global_pos + ch.pos)::BIGINT AS global_pos FROM ch JOIN p USING (doc_id)), f AS (SELECT *, (global_pos - min(global_pos) OVER (PARTITION BY hash, length)) // 65536 AS stretch FROM g), o AS (SELECT *, min(global_pos) OVER (PARTITION BY hash, length, stretch) AS first FROM f) SELECT doc_id, pos, length, global_pos, CASE WHEN length >= {dedup.LEAST_CHUNK} AND first < global_pos THEN first END AS original_pos FROM o",
    "crc32_payload": f"WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda y: ('0x' || y)::BIGINT) AS x FROM documents) SELECT doc_id, {_crc(0xEDB88320, 0xFFFFFFFF)} AS crc32, {_crc(0x8408, 0xFFFF)}::INT AS crc16 FROM b",
    "literal_modes": f"WITH {_HEX.format('documents')}, y AS (SELECT doc_id, i, ('0x' || x[i])::INT AS b FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM h)), z AS (SELECT doc_id, 'raw' AS k, b FROM y UNION ALL SELECT * FROM (SELECT doc_id, 'delta', (b - lag(b) OVER (PARTITION BY doc_id ORDER BY i)) & 255 AS b FROM y) WHERE b IS NOT NULL), n AS (SELECT doc_id, k, b, count(*) AS n FROM z GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY doc_id, k) AS p FROM n), e AS (SELECT doc_id, coalesce(-sum(p * log2(p)) FILTER (k = 'raw'), 0) AS raw, coalesce(-sum(p * log2(p)) FILTER (k = 'delta'), 8) AS delta FROM s GROUP BY doc_id) SELECT doc_id, CASE WHEN delta < raw - 0.2 THEN 'delta' WHEN raw < delta - 0.1 THEN 'raw' ELSE 'exclusion' END AS mode FROM e",
    "archive_entries": f"WITH {_P} SELECT path, 'f' AS type, size, global_pos, 438::INT AS mode FROM p",
    "restored_tree": f"WITH {_E} SELECT path, 'f' AS type, size, 438::INT AS mode, 0::BIGINT AS mtime FROM e UNION ALL SELECT split_part(path, '/', 1), 'd', sum(size)::BIGINT, NULL, NULL FROM e GROUP BY 1",
    "restored_halves": f"WITH {_E} SELECT path, sha256(encode(text)[size // 2 + 1 :]) AS hash FROM e JOIN documents USING (doc_id)",
    "encrypted_archive": "SELECT encrypted, doc_id, text FROM documents, (VALUES (true), (false)) t(encrypted)",
    "ctr_roundtrip": "SELECT page_id, (octet_length(encode(html)) + 16)::BIGINT AS n_sealed, html FROM pages",
    "derived_keys": """WITH RECURSIVE r(lang, i, h) AS (SELECT DISTINCT lang, 0, encode(coalesce(lang, '')) FROM documents UNION ALL SELECT lang, i + 1, unhex(sha256(h || encode('a test salt'))) FROM r WHERE i < 200),
        k AS (SELECT a.lang, lower(hex(a.h)) AS key, hex(b.h) AS x FROM r a JOIN r b ON a.lang IS NOT DISTINCT FROM b.lang WHERE a.i = 100 AND b.i = 200)
        SELECT lang, key, lower(""" + " || ".join("printf('%02X', " + _xored([f"('0x' || substring(x, {8 * w + 2 * k + 1}, 2))::INT" for w in range(8)]) + ")" for k in range(4)) + """) AS "check" FROM k""",
    "codec_bounds": "WITH f AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) SELECT doc_id, (n + n // 13 + 32 + 1 + 16)::BIGINT AS bound, true AS kept FROM f",
    "filter_segments": "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, true AS restored FROM documents",
    "recency_places": "WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), l AS (SELECT *, lag(i) OVER (PARTITION BY user_id, event_type ORDER BY i) AS last FROM e), p AS (SELECT l.user_id, l.event_id, any_value(l.last) AS last, count(DISTINCT b.event_type) AS place FROM l LEFT JOIN e b ON b.user_id = l.user_id AND b.i > l.last AND b.i < l.i GROUP BY ALL) SELECT user_id, event_id, CASE WHEN last IS NULL OR place >= 3 THEN -1 ELSE place END::INT AS place, true AS restored FROM p",
}
