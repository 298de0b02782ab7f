"""Codecs, filters, encryption, checksums and the container's grammar, by themselves."""

import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata import shared
from strata.errors import BadArchive, NotAnArchive, UnknownCodec, UnsafePath
from strata.functions import checksums, codecs, crypto, filters
from strata.functions.bits import read_varint, write_varint
from strata.functions.checksums import crc16
from strata.operators import chunking
from strata.options import LEVELS, Options, memory_estimate
from strata.plans import archive
from strata.sources import container

DATA = [b"", b"a", bytes(5000), os.urandom(5000), bytes(i * 3 % 256 for i in range(40000)), np.arange(20000, dtype="<u2").tobytes(), b"\xe8\1\2\3\0" * 9000, b"text and more text. " * 3000] + [bytes(n) for n in (63, 64, 65, 511, 512, 2047, 2048, 2049, 4095, 4096, 16384, 16385)]


def test_the_library_encrypts_as_numpy_does(monkeypatch):
    key = bytes(range(32))
    assert crypto._LIBRARY is not None
    for iv in (bytes(16), b"\xff" * 16, bytes(range(16)), b"\1" * 8 + b"\xff" * 8):
        for data in (b"", b"a", os.urandom(16), os.urandom(70001)):
            sealed = crypto.counter_mode(data, key, iv)
            assert sealed == crypto.in_numpy(data, key, iv) and crypto.counter_mode(sealed, key, iv) == data
    monkeypatch.setattr(crypto, "_LIBRARY", None)
    assert crypto.counter_mode(b"abc", key, bytes(16)) == crypto.in_numpy(b"abc", key, bytes(16))


def test_stretches_bound_what_is_held():
    for sizes in ([], [5], [9, 1, 1, 1], [1] * 10, [0, 0, 30, 0, 2]):
        got = list(shared.stretches(sizes, 4))
        assert [i for a, b in got for i in range(a, b)] == list(range(len(sizes)))
        assert all(b == a + 1 or sum(sizes[a:b]) <= 4 for a, b in got)


def test_known_answers():
    assert crc16(b"123456789") == 0x906E and zlib.crc32(b"123456789") == 0xCBF43926
    assert container.END_BLOCK == bytes.fromhex("9f160100")
    key = bytes(range(32))
    block = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)[None, :]
    assert crypto.encrypt_blocks(block, key).tobytes().hex() == "8ea2b7ca516745bfeafc49904b496089"
    key = bytes.fromhex("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4")
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    assert crypto.counter_mode(plain, key, bytes.fromhex("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff")).hex() == "601ec313775789a5b7a7f504bbf3d228f443e3ca4d62b59aca84e990cacaf5c5"
    assert crypto.counter_mode(bytes(48), key, b"\xff" * 16)[16:32] == crypto.counter_mode(bytes(16), key, bytes(16))


@given(st.integers(0, 2**63 - 1))
def test_varints(x):
    b = write_varint(x)
    assert read_varint(b"??" + b, 2) == (x, 2 + len(b)) and len(b) == max(1, -(-x.bit_length() // 7))


def test_broken_varints():
    for b in (b"", b"\x80", b"\xff" * 10 + b"\1"):
        with pytest.raises(ValueError):
            read_varint(b, 0)


@pytest.mark.parametrize("names", [(), ("identity",), ("delta",), ("zlib",), ("lzma",), ("zstd",), ("delta", "zlib", "aes256")])
def test_codecs_give_back_what_they_got(names):
    context = codecs.Context(key=bytes(range(32)), nonce=b"n")
    for d in DATA:
        payload, sizes = codecs.encode_block(d, 5, names, context)
        assert codecs.decode_block(payload, sizes, names, context) == d
        for name, before, after in zip(names, sizes, sizes[1:]):
            assert after <= codecs.find(name).bound(before)
        with pytest.raises(BadArchive):
            codecs.decode_block(payload + b"x", sizes, names, context)
    with pytest.raises(UnknownCodec):
        codecs.find("nothing")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 3), st.integers(1, 16), st.integers(1, 2))
def test_differences(data, order, step, width):
    assert filters.undifference(filters.difference(data, order, step, width), order, step, width) == data
    assert filters.branches(filters.branches(data), True) == data and filters.decode(filters.encode(data)) == data


def test_choices_of_the_filter():
    ramp = np.cumsum(np.random.default_rng(0).integers(-2, 3, (8192, 2)), axis=0).astype(np.uint8).tobytes()
    kind, _, channels, _ = filters.choose(ramp)
    assert kind == filters.DIFFERENCE and channels in (2, 4, 6)
    assert filters.choose(os.urandom(16384))[0] == filters.NONE
    assert filters.entropy(np.zeros(9, np.uint8)) == 0 == filters.entropy(np.zeros(0, np.uint8)) and filters.stride(np.arange(200, dtype=np.uint8)) == 1
    assert filters.stride(np.tile(np.arange(3, dtype=np.uint8), 999)) == 3 and filters.alignment(np.zeros(100, np.uint8)) == 0
    assert filters.alignment(np.tile(np.array([1, 200, 9, 77], np.uint8), 20000)) == 2


def sequential_cuts(data):
    """The chunker, a byte at a time."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + chunking.MOST)
        h = 0
        for i in range(at + 2016, end):
            h = h >> 1 ^ int(chunking._TABLE[data[i]])
            if i >= at + chunking.LEAST and h & chunking.MASK == 0:
                end = i
                break
        out.append(end - at)
        at = end
    return out


def test_chunks_are_those_of_the_sequential_model():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2047, 2048, 2049, 9000, 32767, 32768, 120_000):
        d = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert chunking.cut_lengths(d) == sequential_cuts(d)
    assert chunking.cut_lengths(bytes(70000)) == sequential_cuts(bytes(70000))


def test_chunks_meet_again_after_an_insertion():
    d = np.random.default_rng(6).integers(0, 256, 200_000).astype(np.uint8).tobytes()
    ends = lambda x, k: {len(x) - k - e for e in np.cumsum(chunking.cut_lengths(x))}
    assert len(ends(d, 0) & ends(b"x" + d, 0)) > 10


def test_file_trees():
    rows = [("d", "a", 9, 7, 0), ("f", "a/b.txt", 9, 0b110110110, 1234567890), ("f", "a/é \udcff", 0, 0, 1)]
    assert archive.read_tree(archive.write_tree(rows)) == rows
    for path in ("/abs", "../x", "a/../../x", "", "a//b", "."):
        with pytest.raises(UnsafePath):
            archive.read_tree(archive.write_tree([("f", path, 0, 0, 0)]))
    with pytest.raises(BadArchive):
        archive.read_tree(archive.write_tree(rows)[:-1])


def test_codec_headers():
    want = [("delta", b""), ("aes256", bytes(20))]
    data = container.SIGNATURE + container.write_codecs(want)
    assert container.read_codecs(data + b"rest") == (want, len(data))
    with pytest.raises(NotAnArchive):
        container.read_codecs(b"PK\3\4")
    for i in range(4, len(data)):
        with pytest.raises(BadArchive):
            container.read_codecs(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])


def test_memory_estimates_grow_with_threads():
    for level in LEVELS:
        o = Options.of_level(level, "secret" if level % 2 else None)
        assert memory_estimate(o, 2) == 2 * memory_estimate(o, 1) > o.max_block
        assert ("aes256" in o.codecs) == bool(level % 2) and (not o.codecs or o.codecs[-1] == "aes256" or level % 2 == 0)
    with pytest.raises(UnknownCodec):
        memory_estimate(Options(("nothing",)), 1)


@given(st.lists(st.integers(0, 12)), st.integers(1, 8))
def test_recency_lists(values, slots):
    from strata.functions import recency

    codes = recency.encode(values, slots)
    assert recency.decode([(p, v if p < 0 else None) for p, v in codes], slots) == values and all(-1 <= p < slots for p, _ in codes)


def test_literal_modes():
    ramp = np.arange(5000, dtype=np.int64).astype(np.uint8)
    assert filters.literal_mode(ramp, 1) == "delta" and filters.literal_mode(np.zeros(100, np.uint8), 3) == "exclusion"
    rng = np.random.default_rng(1)
    assert filters.literal_mode(rng.integers(0, 4, 5000).astype(np.uint8), 1) == "raw"


def test_trials_by_another_backend():
    context = codecs.Context(settings={"filter_backend": "lzma"})
    ramp = np.cumsum(np.random.default_rng(0).integers(-2, 3, (16384, 2)), axis=0).astype(np.uint8).tobytes()
    for c in (codecs.Context(), context):
        coded = codecs.find("delta").encode(ramp, 1, c)
        assert filters.decode(coded) == ramp and sum(n for _, n in filters.segments(coded)) == len(ramp)
        assert any(k == filters.DIFFERENCE for k, _ in filters.segments(coded))


def sequential_distances(data):
    """Four streams in step, each with the places where it last saw a byte, at first the start of the data."""
    counts, q = np.zeros(256, np.int64), len(data) // 4
    last = [[0] * 256 for _ in range(4)]
    at = [1 + j * q for j in range(4)]
    while at[3] < len(data):
        for j in range(4):
            b = data[at[j]]
            counts[(at[j] - last[j][b]) & 255] += 1
            last[j][b] = at[j]
            at[j] += 1
    counts[0] = 0
    return counts


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700))
def test_distances_are_those_of_the_sequential_model(data):
    assert (filters.distances(np.frombuffer(data, np.uint8)) == sequential_distances(data)).all()


def test_crc16_of_the_standard_check_and_of_a_table():
    assert checksums.crc16(b"123456789") == 0x906E
    for n in (0, 1, 2, 1000):
        data, c = os.urandom(n), 0xFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ 0x8408 if c & 1 else c >> 1
        assert checksums.crc16(data) == c ^ 0xFFFF


def test_xxh3_of_a_column(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(b"",), (None,)], "b binary").select(checksums.xxh3_column(F.col("b"))).collect()
    assert rows[0][0] == 0x2D06800538D394C2 and rows[1][0] is None
