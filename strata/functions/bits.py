"""Column expressions: permission bits, names, sizes of variable-length integers; and such integers themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_permissions(mode: Column) -> Column:
    """The nine permission bits in reverse order; its own inverse."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(mode, k).bitwiseAND(1), 8 - k) for k in range(9)])


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def extension(path: Column) -> Column:
    """From the last dot of the file name on; a name's first character doesn't begin an extension."""
    return F.regexp_extract(filename(path), r"(?s)^.+(\.[^.]*)$", 1)


def varint_size(x: Column) -> Column:
    """Bytes of a non-negative integer in groups of seven bits."""
    return F.ceil(F.length(F.bin(x)) / 7).cast("int")


def write_varint(x: int) -> bytes:
    if x < 0:
        raise ValueError("negative")
    out = bytearray()
    while x >= 128:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it); ValueError where it doesn't end or is 2^63 or more."""
    x = shift = 0
    while at < len(data) and shift < 63:
        b = data[at]
        at += 1
        x |= (b & 127) << shift
        shift += 7
        if b < 128:
            return x, at
    raise ValueError("a broken variable-length integer")
