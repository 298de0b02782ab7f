"""Media columns: baseline JPEG to dimensions, DC-only luminance thumbnails and their hashes.

The decoder reads markers, quantisation and Huffman tables, frame and scans, with any sampling, restart intervals and scans that aren't
interleaved. Of each block only the DC coefficient is reconstructed (the AC codes are decoded and passed over), so that the thumbnail has one
pixel for each 8 x 8 block of the luminance: DC * q / 8 + 128, limited to 0..255 and rounded. Any size that the format allows is decoded;
what is held beside the picture's bytes is its thumbnail, a byte for each block. The average hash has a bit for each cell of an 8 x 8
grid over the thumbnail, 1 where its mean is at least the mean of all; the difference hash compares neighbours of a 9 x 8 grid.

There is no image table, so media_of() makes one of `embeddings`: 64 values are the centres of the 8 x 8 blocks of a 64 x 64 picture,
interpolated between them and encoded with DC and AC codes by encode_all().

Defined results: null or empty bytes, bytes that aren't a baseline JPEG, and a broken or cut-off one give null in all columns but
`error`, which says why; repeated rows are decoded each for itself; an empty table gives an empty result; other columns are ignored; an
embedding that is null or not of 64 values has null bytes; equal values, and values that aren't finite, become grey.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strata.llm import storage

_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_AT = np.array([8 * (k // 8) + k % 8 for k in _ZIGZAG])
#: The tables of Annex K for luminance, as nearly every encoder has them: number of codes of each length, and their symbols.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
AC_COUNTS = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125])
AC_SYMBOLS = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a"
    "636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
#: Steps of quantisation of encode_all(): finest for the mean, coarser with frequency.
STEPS = (8 + 2 * np.add.outer(np.arange(8), np.arange(8))).astype(np.uint8)


class NotBaseline(ValueError):
    """Bytes that can't be read as a baseline JPEG."""


@cache
def huffman(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For each 16 bits that may come next: length of the code (0: none) and symbol."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for (first, last), bits, x in _codes(counts, symbols):
        length[first:last], symbol[first:last] = bits, x
    return length.tolist(), symbol.tolist()


def _codes(counts: bytes, symbols: bytes):
    """((first, end) of the 16 bits that begin with it, length, symbol) of each code."""
    code = at = 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            if at >= len(symbols) or code >= 1 << bits:
                raise NotBaseline("a broken Huffman table")
            yield (code << (16 - bits), (code + 1) << (16 - bits)), bits, symbols[at]
            code, at = code + 1, at + 1
        code <<= 1


@cache
def _steps(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For each 16 bits at an AC code: bits to pass over, of code and value, and coefficients to go on by; 64 at the end of the block, 999 where there is no code."""
    length, symbol = (np.array(x) for x in huffman(counts, symbols))
    on = np.where(symbol & 15, (symbol >> 4) + 1, np.where(symbol == 0xF0, 16, 64))
    return (length + (symbol & 15)).tolist(), np.where(length > 0, on, 999).tolist()


def _scan_dc(data: bytes, units: list[tuple], n: int, thumb: np.ndarray | None, first: int, across: int, q: int):
    """Decode the n units (one MCU each) of one restart interval, from unit `first` on.

    units lists (component, DC table, AC table, whether its DC is wanted, rows and columns of the component in an MCU, place in it) of an MCU's
    blocks; thumb gets the levels of those wanted.
    """
    total, at, acc, held = len(data) * 8, 0, 0, 0
    pred = {u[0]: 0 for u in units}
    take = int.from_bytes
    height, width = thumb.shape if thumb is not None else (0, 0)
    for k in range(first, first + n):
        for c, (dl, ds), (step, on), wanted, vs, hs, y, x in units:
            if held < 32:
                if at > len(data) + 8:
                    raise NotBaseline("the scan is cut off")
                acc = (acc & ((1 << held) - 1)) << 48 | take(data[at : at + 6].ljust(6, b"\0"), "big")
                held, at = held + 48, at + 6
            z = (acc >> (held - 16)) & 0xFFFF
            size = ds[z]
            if not dl[z] or size > 11:
                raise NotBaseline("a code that the table lacks")
            held -= dl[z]
            if size:
                held -= size
                v = (acc >> held) & ((1 << size) - 1)
                pred[c] += v if v >> (size - 1) else v - (1 << size) + 1
            i = 1
            while i < 64:
                if held < 32:
                    if at > len(data) + 8:
                        raise NotBaseline("the scan is cut off")
                    acc = (acc & ((1 << held) - 1)) << 48 | take(data[at : at + 6].ljust(6, b"\0"), "big")
                    held, at = held + 48, at + 6
                z = (acc >> (held - 16)) & 0xFFFF
                held -= step[z]
                i += on[z]
            if 64 < i and on[z] != 64:
                raise NotBaseline("a code that the table lacks" if on[z] == 999 else "more than 64 coefficients")
            if wanted:
                row, column = k // across * vs + y, k % across * hs + x
                if row < height and column < width:
                    level = (pred[c] * q + 1028) >> 3  # floor of x / 8 + 128.5
                    thumb[row, column] = 0 if level < 0 else 255 if level > 255 else level
    if at * 8 - held > total:
        raise NotBaseline("the scan is cut off")


def thumbnail(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """(width, height, components, luminance thumbnail) of a baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    at, quant, dc, ac, frame, restart, thumb, sizes, done = 2, {}, {}, {}, None, 0, None, [], set()
    word = lambda i: int.from_bytes(data[i : i + 2], "big")
    while True:
        if at + 2 > len(data):
            break
        if data[at] != 0xFF:
            raise NotBaseline("no marker where one must be")
        while at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        if at + 1 >= len(data):
            break
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            break
        if marker == 1 or 0xD0 <= marker <= 0xD7:
            continue
        size = word(at)
        if size < 2 or at + size > len(data):
            raise NotBaseline("a segment is cut off")
        seg = data[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            i = 0
            while i < len(seg):
                wide, t = seg[i] >> 4, seg[i] & 15
                n = 65 + 64 * wide
                if wide > 1 or i + n > len(seg):
                    raise NotBaseline("a broken quantisation table")
                quant[t] = int.from_bytes(seg[i + 1 : i + 2 + wide], "big")
                i += n
        elif marker == 0xC4:
            i = 0
            while i < len(seg):
                if i + 17 > len(seg):
                    raise NotBaseline("a broken Huffman table")
                n = sum(seg[i + 1 : i + 17])
                counts, symbols = bytes(seg[i + 1 : i + 17]), bytes(seg[i + 17 : i + 17 + n])
                if seg[i] >> 4:
                    ac[seg[i] & 15] = _steps(counts, symbols)
                else:
                    dc[seg[i] & 15] = huffman(counts, symbols)
                i += 17 + n
        elif marker == 0xC0:
            if len(seg) < 6 or seg[0] != 8 or len(seg) != 6 + 3 * seg[5] or not seg[5]:
                raise NotBaseline("a broken frame header")
            height, width = int.from_bytes(seg[1:3], "big"), int.from_bytes(seg[3:5], "big")
            frame = [(seg[i], seg[i + 1] >> 4, seg[i + 1] & 15, seg[i + 2]) for i in range(6, len(seg), 3)]
            if not height or not width or any(not 1 <= h <= 4 or not 1 <= v <= 4 for _, h, v, _ in frame):
                raise NotBaseline("dimensions out of bounds")
            hm, vm = max(f[1] for f in frame), max(f[2] for f in frame)
            cover = lambda n, s, m: -(-(-(-n * s // m)) // 8)
            sizes = [(cover(height, v, vm), cover(width, h, hm)) for _, h, v, _ in frame]
            thumb = np.zeros(sizes[0], np.uint8)
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise NotBaseline("not baseline")
        elif marker == 0xDD:
            restart = int.from_bytes(seg[:2], "big")
        elif marker == 0xDA:
            if frame is None or not seg or len(seg) != 4 + 2 * seg[0]:
                raise NotBaseline("a broken scan header")
            ids = [f[0] for f in frame]
            own = [(seg[1 + 2 * i], seg[2 + 2 * i]) for i in range(seg[0])]
            try:
                parts = [(ids.index(c), dc[t >> 4], ac[t & 15]) for c, t in own]
                q = quant[frame[0][3]]
            except (KeyError, ValueError):
                raise NotBaseline("a table or component that isn't there") from None
            end = at
            pieces, begin = [], at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] == 0:
                    end += 2
                elif 0xD0 <= data[end + 1] <= 0xD7:
                    pieces.append(data[begin:end])
                    end += 2
                    begin = end
                elif data[end + 1] == 0xFF:
                    end += 1
                else:
                    break
            pieces.append(data[begin:end])
            if len(parts) == 1:
                c, d, a = parts[0]
                down, across = sizes[c]
                units = [(c, d, a, c == 0, 1, 1, 0, 0)]
            else:
                across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
                units = [(c, d, a, c == 0, frame[c][2], frame[c][1], y, x) for c, d, a in parts for y in range(frame[c][2]) for x in range(frame[c][1])]
            n, first = across * down, 0
            for piece in pieces:
                k = min(n - first, restart or n)
                if k <= 0:
                    break
                _scan_dc(piece.replace(b"\xff\x00", b"\xff"), units, k, thumb, first, across, q)
                first += k
            if first < n:
                raise NotBaseline("the scan is cut off")
            done.update(c for c, _, _ in parts)
            at = end
    if frame is None or 0 not in done:
        raise NotBaseline("no scan of the luminance")
    return width, height, len(frame), thumb


@cache
def _cells(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of k cells over n pixels begins and ends."""
    lo = np.arange(k) * n // k
    return lo, np.maximum(lo + 1, (np.arange(k) + 1) * n // k)


def grid(thumb: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means of the cells of a grid over a thumbnail; a cell smaller than a pixel has that pixel's value."""
    (y0, y1), (x0, x1) = _cells(thumb.shape[0], rows), _cells(thumb.shape[1], columns)
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    np.cumsum(np.cumsum(thumb, 0, float), 1, out=total[1:, 1:])
    down = total[y1] - total[y0]
    return (down[:, x1] - down[:, x0]) / np.outer(y1 - y0, x1 - x0)


def _bits(x: np.ndarray) -> int:
    return int(np.packbits(x.ravel()).view(">i8")[0])


def average_hash(thumb: np.ndarray) -> int:
    g = grid(thumb, 8, 8)
    return _bits(g >= g.mean())


def difference_hash(thumb: np.ndarray) -> int:
    g = grid(thumb, 8, 9)
    return _bits(g[:, 1:] > g[:, :-1])


_DCT = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(8) + 1) / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]


def _tables(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for (first, _), bits, x in _codes(counts, symbols):
        code[x], length[x] = first >> (16 - bits), bits
    return code, length


def encode_all(pictures: np.ndarray, restart: int = 0) -> list[bytes]:
    """Grey baseline JPEGs of pictures of one size (picture, row, column; 0..255), with a restart interval of so many blocks."""
    p, h, w = pictures.shape
    padded = np.pad(pictures, ((0, 0), (0, -h % 8), (0, -w % 8)), "edge").astype(float) - 128
    rows, columns = padded.shape[1] // 8, padded.shape[2] // 8
    blocks = padded.reshape(p, rows, 8, columns, 8).transpose(0, 1, 3, 2, 4)
    z = np.rint(_DCT @ blocks @ _DCT.T / STEPS).astype(np.int64).reshape(p, rows * columns, 64)[:, :, _AT]
    each, step = rows * columns, restart or rows * columns
    z = z.reshape(p * each, 64)
    before = np.concatenate([[0], z[:-1, 0]])
    before[np.arange(p * each) % each % step == 0] = 0
    # a row for each code: block, place in the block (an end of block is at 64), symbol, value
    block, k = np.nonzero(z[:, 1:])
    k = k + 1
    same = np.concatenate([[False], block[1:] == block[:-1]])
    run = k - np.where(same, np.concatenate([[0], k[:-1]]), 0) - 1
    value = z[block, k]
    long = np.repeat(np.arange(len(k)), run // 16)
    end = np.setdiff1d(np.arange(p * each), block[k == 63])
    size = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    dc = z[:, 0] - before
    of = np.concatenate([np.arange(p * each), block[long], block, end])
    place = np.concatenate([np.zeros(p * each), k[long] - 0.5, k, np.full(len(end), 64)])
    values = np.concatenate([dc, np.zeros(len(long), np.int64), value, np.zeros(len(end), np.int64)])
    sizes = size(values)
    (dcode, dlen), (acode, alen) = _tables(DC_COUNTS, DC_SYMBOLS), _tables(AC_COUNTS, AC_SYMBOLS)
    symbol = np.concatenate([sizes[: p * each], np.full(len(long), 0xF0), (run % 16 << 4) | size(value), np.zeros(len(end), np.int64)])
    is_dc = np.arange(len(of)) < p * each
    code = np.where(is_dc, dcode[symbol], acode[symbol]) << sizes | np.where(values > 0, values, values + (1 << sizes) - 1)
    length = np.where(is_dc, dlen[symbol], alen[symbol]) + sizes
    order = np.lexsort((place, of))
    of, code, length = of[order], code[order], length[order]
    ends = np.cumsum(length)
    which = np.repeat(np.arange(len(code)), length)
    bits = (code[which] >> (ends[which] - 1 - np.arange(len(which)))) & 1
    bits = bits.astype(np.uint8)
    seg = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + seg(0xDB, bytes([0]) + STEPS.ravel()[_AT].tobytes()) + seg(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
    head += seg(0xC4, bytes([0x00]) + DC_COUNTS + DC_SYMBOLS) + seg(0xC4, bytes([0x10]) + AC_COUNTS + AC_SYMBOLS) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    begins = np.concatenate([[0], ends])[np.searchsorted(of, np.arange(p * each))].tolist() + [int(ends[-1]) if len(ends) else 0]
    out = []
    for i in range(p):
        parts = [head]
        for k, first in enumerate(range(0, each, step)):
            lo, hi = begins[i * each + first], begins[i * each + min(each, first + step)]
            x = bits[lo:hi]
            x = np.packbits(np.concatenate([x, np.ones(-len(x) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\0")
            parts += [bytes([0xFF, 0xD0 + (k - 1) % 8])] * (k > 0) + [x]
        out.append(b"".join(parts) + b"\xff\xd9")
    return out


def encode(picture: np.ndarray, restart: int = 0) -> bytes:
    """encode_all() of one picture."""
    return encode_all(picture[None], restart)[0]


#: Weight of each of 8 centres at each of 64 places, so that the levels between them are interpolated.
_BETWEEN = np.array([[max(0.0, 1 - abs(min(max((x - 3.5) / 8, 0), 7) - i)) for i in range(8)] for x in range(64)])


def pictures_of(values: np.ndarray) -> np.ndarray:
    """Pictures of 64 x 64 of rows of 64 values, their least as 0 and their largest as 255."""
    v = np.asarray(values, float)
    low, high = v.min(axis=1, keepdims=True), v.max(axis=1, keepdims=True)
    flat = ~np.isfinite(low + high) | (high <= low)
    with np.errstate(invalid="ignore", divide="ignore"):
        level = np.where(flat, 128.0, (v - low) / (high - low) * 255)
    return np.rint(_BETWEEN @ level.reshape(-1, 8, 8) @ _BETWEEN.T).astype(np.uint8)


def media_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, media): a JPEG of each embedding, with a restart interval of two rows of blocks."""
    storage.bound_batches(embeddings.sparkSession)

    def work(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            fit = [i for i, v in enumerate(rows) if v is not None and len(v) == 64 and None not in v]
            out = [None] * len(rows)
            for at in range(0, len(fit), 256):
                part = fit[at : at + 256]
                for i, x in zip(part, encode_all(pictures_of(np.array([rows[i] for i in part])), 16)):
                    out[i] = x
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "media"])

    return embeddings.select("vec_id", "embedding").mapInArrow(work, f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, media binary")


_SCHEMA = "width int, height int, components int, thumb_width int, thumb_height int, thumbnail binary, average_hash long, difference_hash long, error string"


def decode_media(media: DataFrame, key: str, column: str) -> DataFrame:
    """(key, width, height, components, thumb_width, thumb_height, thumbnail, average_hash, difference_hash, error) of every row's JPEG."""
    storage.bound_batches(media.sparkSession)
    names = [key, *(x.split()[0] for x in _SCHEMA.split(", "))]
    types = [pa.int32()] * 5 + [pa.binary(), pa.int64(), pa.int64(), pa.string()]

    def row(data):
        try:
            w, h, n, thumb = thumbnail(data or b"")
        except NotBaseline as e:
            return (None,) * 8 + (str(e),)
        return w, h, n, thumb.shape[1], thumb.shape[0], thumb.tobytes(), average_hash(thumb), difference_hash(thumb), None

    def work(batches):
        for batch in batches:
            rows = [row(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    return media.select(key, column).mapInArrow(work, f"{key} {media.schema[key].dataType.simpleString()}, {_SCHEMA}")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(media_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vec_id", "media")
