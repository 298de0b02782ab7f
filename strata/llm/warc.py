"""WARC archives compressed with Zstandard: reader and writer.

An archive begins with a skippable frame (magic number 0x184D2A5D) that holds the dictionary, itself perhaps a Zstandard frame, and goes
on with one frame for each record. The reader streams it: it takes the dictionary from the leading frame, finds each frame's end, decodes
it by itself and checks the record: version line, named fields, WARC-Type, WARC-Record-ID, WARC-Date and Content-Length present, the
latter equal to the bytes of the block, the block followed by two line ends and nothing else, and the payload's digest if there is one.
Archives lie in any file system that pyarrow can open by URI, and each is one task's work: an archive of 1 GB, the usual size, is
read in pieces and decoded block by block, and only one record is held at a time, of at most MOST_RECORD_BYTES.

Defined results: an empty archive has no record; a frame that can't be decoded, or is cut off, and a dictionary that can't be read give one
row whose `error` says so, and reading ends there; a record of more than MOST_RECORD_BYTES is passed over, with a row that says so; a record that fails a check gives a row with its error and reading goes on with the next; an archive without a
leading skippable frame is read without dictionary; other skippable frames are passed over. The writer makes a record of every row: a
null url or html is written as an empty one, and read as such; repeated rows are records of their own; an empty table makes no
archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from strata.llm import storage, text

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_BYTES = 1 << 16
SAMPLE_BYTES = 4 << 20
ARCHIVE_BYTES = 256 << 20
MOST_RECORD_BYTES = 1 << 28
_PIECE = 1 << 20
_DATE = datetime(2024, 1, 1, tzinfo=UTC)
_SCHEMA = "archive string, position long, record_type string, record_id string, target_uri string, date string, content_length long, payload string, error string"


class Broken(ValueError):
    """A frame that can't be decoded: nothing after it can be found."""


def _system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def record_bytes(kind: str, uri: str, payload: bytes, record_id: str, date: datetime = _DATE) -> bytes:
    """A WARC/1.1 record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date.strftime("%Y-%m-%dT%H:%M:%SZ")), ("WARC-Target-URI", uri), ("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields, their names in lower case, and block of a record; ValueError says what is wrong with it."""
    head, end, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not end:
        raise ValueError("the header doesn't end")
    if lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC version line")
    fields: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:
            fields[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError("a header line that isn't a named field")
        last = name.decode("utf-8", "replace").lower()
        fields[last] = value.strip().decode("utf-8", "replace")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not fields.get(name):
            raise ValueError(f"no {name}")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise ValueError("content-length isn't a number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("content-length isn't that of the block")
    block = rest[:size]
    kind, _, digest = fields.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and digest != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("the digest isn't that of the block")
    return fields, block


def frames(stream, most: int = MOST_RECORD_BYTES) -> Iterator[tuple[int, bytes | None]]:
    """(position, content) of each record's frame of an archive; None for one of more than `most` bytes."""
    held, position, dictionary, leading = bytearray(), 0, None, True

    def need(n: int):
        while len(held) < n:
            piece = stream.read(max(_PIECE, n - len(held)))
            if not piece:
                raise Broken(f"{position}: the archive ends within a frame")
            held.extend(piece)

    while held or (piece := stream.read(_PIECE)):
        if not held:
            held.extend(piece)
        need(4)
        magic = int.from_bytes(held[:4], "little")
        if magic in SKIPPABLE:
            need(8)
            size = 8 + int.from_bytes(held[4:8], "little")
            need(size)
            if leading and magic == DICTIONARY_MAGIC:
                content = bytes(held[8:size])
                try:
                    if content[:4] == FRAME_MAGIC.to_bytes(4, "little"):
                        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=most)
                    dictionary = zstandard.ZstdCompressionDict(content)
                except zstandard.ZstdError as e:
                    raise Broken(f"{position}: the dictionary: {e}") from None
            del held[:size]
            position += size
        elif magic == FRAME_MAGIC:
            try:
                used, content = _frame(held, need, dictionary, most)
            except zstandard.ZstdError as e:
                raise Broken(f"{position}: {e}") from None
            yield position, content
            position += used
        else:
            raise Broken(f"{position}: not a frame")
        leading = False


def _frame(held: bytearray, need, dictionary, most: int) -> tuple[int, bytes | None]:
    """Take a frame off `held`, a block of at most 128 KiB of content at a time. (its bytes, its content, or None if that is more than `most`)."""
    need(6)
    if len(held) < 18:
        try:
            need(18)
        except Broken:  # the last frame may be as short
            pass
    header = bytes(held[: zstandard.frame_header_size(bytes(held[:18]))])
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
    checksum = zstandard.get_frame_parameters(bytes(held[:18])).has_checksum
    out, size, used, last = [decoder.decompress(header)], 0, len(header), False
    del held[:used]
    while not last:
        need(3)
        head = int.from_bytes(held[:3], "little")
        last, kind, n = head & 1, head >> 1 & 3, head >> 3
        n = 3 + (1 if kind == 1 else n) + (4 if last and checksum else 0)
        need(n)
        if size <= most:
            out.append(decoder.decompress(bytes(held[:n])))
            size += len(out[-1])
            if size > most:
                out = []
        del held[:n]
        used += n
    if size <= most and not decoder.eof:
        raise zstandard.ZstdError("the frame doesn't end with its last block")
    return used, b"".join(out) if size <= most else None


def read_records(stream, archive: str, most: int = MOST_RECORD_BYTES) -> Iterator[tuple]:
    """A row of read_archives() for each record."""
    try:
        for position, data in frames(stream, most):
            try:
                if data is None:
                    raise ValueError(f"a record of more than {most} bytes")
                f, block = parse_record(data)
                payload = block.decode("utf-8")
            except UnicodeDecodeError:
                yield archive, position, None, None, None, None, None, None, "the block isn't UTF-8"
            except ValueError as e:
                yield archive, position, None, None, None, None, None, None, str(e)
            else:
                yield archive, position, f["warc-type"], f["warc-record-id"], f.get("warc-target-uri"), f["warc-date"], len(block), payload, None
    except Broken as e:
        yield archive, int(str(e).split(":")[0]), None, None, None, None, None, None, str(e)


def read_archives(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(archive, position, record_type, record_id, target_uri, date, content_length, payload, error): a row for each record of the archives."""
    names = _SCHEMA.replace(",", "").split()[::2]
    types = [pa.int64() if x in ("position", "content_length") else pa.string() for x in names]

    def work(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = _system(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for row in read_records(stream, uri):
                        rows.append(row)
                        size += row[6] or 0
                        if size > 8 << 20 or len(rows) >= 10_000:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    listed = spark.createDataFrame([(u,) for u in uris], "uri string").coalesce(1).repartition(max(1, len(uris)))  # in turn: one to a task
    return listed.mapInArrow(work, _SCHEMA)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of the pages (page_id, url, html) in a folder; a task writes its own under a temporary name and renames each when whole. (uri, records) of each."""

    def work(batches):
        system, base = _system(folder)
        system.create_dir(base, recursive=True)
        state = {"stream": None}
        done = []

        def begin(samples: list[bytes]):
            try:
                dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
            except zstandard.ZstdError:  # too little to train with
                dictionary = zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            name = f"{base}/{uuid.uuid4().hex}"
            raw = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
            stream = system.open_output_stream(name + ".open", compression=None)
            stream.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
            state.update(stream=stream, name=name, size=0, records=0, coder=zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True))

        def end():
            if state["stream"] is not None:
                state["stream"].close()
                system.move(state["name"] + ".open", state["name"] + ".warc.zst")
                done.append((f"{folder}/{os.path.basename(state['name'])}.warc.zst", state["records"]))
                state["stream"] = None

        for batch in batches:
            ids, urls, pages_ = (batch.column(i).to_pylist() for i in range(3))
            if state["stream"] is None and ids:
                samples, size = [], 0
                for x in pages_:
                    if x and size < SAMPLE_BYTES:
                        samples.append(x.encode())
                        size += len(samples[-1])
                begin(samples)
            for i, url, html in zip(ids, urls, pages_):
                url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                data = record_bytes("resource", url, (html or "").encode(), str(uuid.uuid5(uuid.NAMESPACE_URL, f"{i} {url}")))
                frame = state["coder"].compress(data)
                state["stream"].write(frame)
                state["size"] += len(frame)
                state["records"] += 1
            if state["size"] > ARCHIVE_BYTES:
                end()
        end()
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["uri", "records"])

    return pages.select("page_id", "url", "html").mapInArrow(work, "uri string, records long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives in the shared folder and read from there; only archives that a finished task reported are read."""
    folder = storage.new_folder(spark, "warc")
    written = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder).collect()
    return read_archives(spark, [r["uri"] for r in written]).select("record_type", "target_uri", "content_length", "payload", "error")


ORACLE_SQL = """SELECT 'resource' AS record_type, coalesce(url, '') AS target_uri, octet_length(encode(coalesce(html, '')))::BIGINT AS content_length, coalesce(html, '') AS payload, NULL::VARCHAR AS error FROM pages"""
