"""WARC, HTML and JPEG."""

import io
import math
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
import zstandard

from strata.llm import html_extract, jpeg, warc

PAGES = "page_id long, url string, html string, archive string, error string"


def test_archives_give_back_the_pages(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>page {i} é</p>" * i, None, None) for i in range(200)] + [(None, None, None, None, None), (5, "http://x/5", "<p>again</p>", None, None), (300, "http://x/y\r\nz", "x" * 3_000_000, None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    written = warc.write_archives(pages, str(tmp_path)).collect()
    got = warc.read_archives(spark, [r["uri"] for r in written]).collect()
    assert sorted((r["target_uri"].replace("%0D%0A", "\r\n"), r["payload"]) for r in got) == sorted((u or "", h or "") for _, u, h, _, _ in rows)
    assert all(r["error"] is None and r["content_length"] == len(r["payload"].encode()) for r in got)
    assert warc.write_archives(pages.where("false"), str(tmp_path)).count() == 0 == warc.read_archives(spark, []).count()


def archive(records, dictionary=True):
    d = zstandard.ZstdCompressionDict(b"WARC/1.1\r\nWARC-Type: resource\r\n" * 20, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = zstandard.ZstdCompressor().compress(d.as_bytes())
    head = warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw if dictionary else b""
    c = zstandard.ZstdCompressor(dict_data=d) if dictionary else zstandard.ZstdCompressor()
    return head + b"".join(c.compress(r) for r in records)


def test_faults_are_told():
    good = warc.record_bytes("resource", "http://x", b"hello", "1")
    bad = {
        "content-length isn't that of the block": good.replace(b"Content-Length: 5", b"Content-Length: 4"),
        "no warc-date": good.replace(b"WARC-Date", b"X-Date"),
        "not a WARC version line": good.replace(b"WARC/1.1", b"WARC/9.9"),
        "the digest isn't that of the block": good.replace(b"hello", b"hallo"),
        "content-length isn't a number": good.replace(b"Content-Length: 5", b"Content-Length: x"),
        "the header doesn't end": b"WARC/1.1\r\n",
        "a header line that isn't a named field": good.replace(b"Content-Type:", b"Content-Type"),
    }
    for d in (True, False):
        data = archive([good, *bad.values(), good], d)
        rows = list(warc.read_records(io.BytesIO(data), "a"))
        assert [r[-1] for r in rows] == [None, *bad, None] and rows[0][7] == "hello"
        for cut in (len(data) - 3, len(data) // 2):
            rows = list(warc.read_records(io.BytesIO(data[:cut]), "a"))
            assert rows[-1][-1] and all(r[-1] is None or r[-1] in bad for r in rows[:-1])
        assert list(warc.read_records(io.BytesIO(data + b"junk"), "a"))[-1][-1].endswith("not a frame")
    assert list(warc.read_records(io.BytesIO(b""), "a")) == []


def test_dictionaries_that_cant_be_read_are_told():
    good = warc.record_bytes("resource", "http://x", b"hello", "1")
    frame = zstandard.ZstdCompressor().compress(b"dictionary " * 50)
    for bad in (frame[:-5], frame[:9] + b"\xff" * 9 + frame[18:], b"\x28\xb5\x2f\xfd"):
        data = warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(bad).to_bytes(4, "little") + bad + zstandard.ZstdCompressor().compress(good)
        rows = list(warc.read_records(io.BytesIO(data), "a"))
        assert len(rows) == 1 and "dictionary" in rows[0][-1]


def test_records_beyond_the_bound_are_passed_over():
    records = [warc.record_bytes("resource", "http://x", b"ab" * n, str(n)) for n in (10, 2_000_000, 20)]
    for d in (True, False):
        rows = list(warc.read_records(io.BytesIO(archive(records, d)), "a", 1 << 20))
        assert [r[-1] for r in rows] == [None, "a record of more than 1048576 bytes", None] and len(rows[2][7]) == 40


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul>%s</ul></nav>
<div><p>%s</p><p>%s</p><p>%s</p></div><footer><a href=x>a</a> <a href=y>b</a></footer></body></html>""" % ("".join(f"<li><a href=/{i}>{i}</a></li>" for i in range(20)), "First words of the text. " * 12, "Second &amp; more. " * 20, "Third. " * 40)


def test_the_article_is_chosen():
    content, regions, lines = html_extract.extract(PAGE)
    assert content.count("First") == 12 and content.count("Second & more.") == 20 and content.count("Third.") == 40
    assert regions == 1 and "var a" not in content and "p{}" not in content and "\n7\n" not in content


def test_smoothing_is_the_weighted_mean():
    x = np.random.default_rng(1).random(17)
    for sigma in (0.5, 1.0, 2.3):
        r = int(np.ceil(3 * sigma))
        for i, v in enumerate(html_extract.smooth(x, sigma)):
            w = {j: np.exp(-((i - j) ** 2) / (2 * sigma**2)) for j in range(max(0, i - r), min(len(x), i + r + 1))}
            assert abs(v - sum(x[j] * k for j, k in w.items()) / sum(w.values())) < 1e-12


def test_pieces_don_t_matter(monkeypatch):
    want = html_extract.extract(PAGE)
    for n in (1, 7, 100):
        monkeypatch.setattr(html_extract, "PIECE", n)
        assert html_extract.extract(PAGE)[0].replace(" ", "") == want[0].replace(" ", "")


def test_hard_pages(spark):
    rows = [(1, "u", None, None, None), (2, "u", "", None, None), (None, "u", "<p>x", None, None), (3, "u", "<<<>>&#x;<p", None, None), (4, "u", "<p></p>" * 9, None, None), (5, "u", "plain", None, None), (5, "u", "plain", None, None), (6, "u", "<p>" + "long " * 300_000, None, None)]
    got = html_extract.extract_content(spark.createDataFrame(rows, PAGES)).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 8 and by[1]["text"] == by[2]["text"] == by[4]["text"] == "" and by[5]["text"] == "plain" and by[6]["n_chars"] == 1_499_999
    assert html_extract.extract_content(spark.createDataFrame([], PAGES)).count() == 0


class Plain(HTMLParser):
    """Events of a well-formed page, as a list."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("s", tag))

    def handle_startendtag(self, tag, attrs):
        self.events.append(("s", tag))

    def handle_endtag(self, tag):
        self.events.append(("e", tag))

    def handle_data(self, data):
        self.events.append(("d", data))


def brute_content(page):
    """Content of a well-formed page, line by line from the list of its events, with the smoothing and the threshold written out."""
    p = Plain()
    p.feed(page)
    p.close()
    lines, silent = [["", 0]], 0
    for kind, x in p.events:
        block = kind != "d" and x in html_extract.BLOCKS
        if kind == "d":
            if not silent:
                for k, part in enumerate(x.split("\n")):
                    if k:
                        lines.append(["", 0])
                    lines[-1][0] += part
            continue
        if x in html_extract.SILENT:
            silent += 1 if kind == "s" else -1
        if block and kind == "s":
            lines.append(["", 0])
        lines[-1][1] += 1
        if block and kind == "e":
            lines.append(["", 0])
    return lines


def test_content_is_that_of_brute_force(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for page in pages:
        p = html_extract.Lines()
        p.feed(page)
        p.close()
        lines = [(" ".join(t.split()), n) for t, n in brute_content(page) if t or n]
        assert list(zip(p.texts, p.tags)) == lines
        x = [len(t) / max(1, n) for t, n in lines]
        even = []
        for i in range(len(x)):
            w = {j: math.exp(-((i - j) ** 2) / 2) for j in range(max(0, i - 3), min(len(x), i + 4))}
            even.append(sum(x[j] * k for j, k in w.items()) / sum(w.values()))
        mean = sum(even) / len(even)
        least = math.sqrt(sum((e - mean) ** 2 for e in even) / len(even))
        chosen = [e >= least for e in even]
        got = html_extract.extract(page)
        assert got[0] == "\n".join(t for (t, _), c in zip(lines, chosen) if c and t)
        assert got[1:] == (sum(c and not (i and chosen[i - 1]) for i, c in enumerate(chosen)), len(lines))


def test_unclosed_silent_elements_silence_nothing():
    words = "Words after it. " * 50
    for tag in ("noscript", "template"):
        for page in (f"<body><{tag}><p>{words}</p></body>", f"<body><div><{tag}>x</div><p>{words}</p></body>", f"<body><{tag}><p>{words}", f"<{tag}><p>a</p><{tag}>no</{tag}><p>{words}</p>"):
            assert words.strip() in html_extract.extract(page)[0]
        assert "hidden" not in html_extract.extract(f"<p>{words}</p><{tag}><p>hidden</p></{tag}><p>{words}</p>")[0]


def whole_decode(data):
    """Pixels of a grey JPEG of encode(), by a decoder of its own: codes from a dictionary of bit strings, every coefficient, inverse transform."""
    at, codes, restart = 2, {}, 0
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        seg = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            steps = list(seg[1:])
        elif marker == 0xC0:
            h, w = int.from_bytes(seg[1:3], "big"), int.from_bytes(seg[3:5], "big")
        elif marker == 0xDD:
            restart = int.from_bytes(seg, "big")
        elif marker == 0xC4:
            code, k, table = 0, 17, codes.setdefault(seg[0] >> 4, {})
            for bits in range(1, 17):
                for _ in range(seg[bits]):
                    table[f"{code:0{bits}b}"] = seg[k]
                    code, k = code + 1, k + 1
                code *= 2
        elif marker == 0xDA:
            break
    rows, columns = -(-h // 8), -(-w // 8)
    body = re.split(rb"\xff[\xd0-\xd7]", data[at:-2])
    zigzag = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
    basis = [[(0.5 if u else math.sqrt(1 / 8)) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
    out = np.zeros((rows * 8, columns * 8))
    done = 0
    for part in body:
        bits = "".join(f"{x:08b}" for x in part.replace(b"\xff\0", b"\xff"))
        i = last = 0

        def symbol(kind):
            nonlocal i
            n = 1
            while bits[i : i + n] not in codes[kind]:
                n += 1
            i += n
            return codes[kind][bits[i - n : i]]

        def number(n):
            nonlocal i
            x = bits[i : i + n]
            i += n
            return 0 if not n else int(x, 2) if x[0] == "1" else int(x, 2) - (1 << n) + 1

        for _ in range(min(restart or rows * columns, rows * columns - done)):
            block = np.zeros((8, 8))
            last += number(symbol(0))
            block[0, 0], k = last * steps[0], 1
            while k < 64:
                rs = symbol(1)
                if rs == 0:
                    break
                k += rs >> 4
                if rs & 15:
                    block[divmod(zigzag[k], 8)] = number(rs & 15) * steps[k]
                k += 1
            r, c = divmod(done, columns)
            out[8 * r : 8 * r + 8, 8 * c : 8 * c + 8] = np.array(basis).T @ block @ np.array(basis) + 128
            done += 1
    return out[:h, :w]


def test_thumbnails_are_the_means_of_a_whole_decode():
    rng = np.random.default_rng(2)
    for k in range(40):
        h, w = (8 * rng.integers(1, 6, 2)).tolist()
        smooth = np.add.outer(np.linspace(0, rng.integers(0, 120), h), np.linspace(0, rng.integers(0, 120), w))
        pixels = np.clip(smooth + rng.normal(0, rng.choice([0, 2, 60]), (h, w)), 0, 255).astype(np.uint8)
        data = jpeg.encode(pixels, int(rng.integers(0, 5)))
        whole = whole_decode(data)
        assert abs(whole - pixels).max() < 90
        means = whole.reshape(h // 8, 8, w // 8, 8).mean(axis=(1, 3))
        gw, gh, n, thumb = jpeg.thumbnail(data)
        assert (gw, gh, n) == (w, h, 1) and (abs(thumb - np.clip(means, 0, 255)) <= 0.500001).all()


def test_large_pictures_take_linear_time():
    took = []
    for n in (512, 1024, 2048):
        pixels = np.random.default_rng(n).integers(0, 256, (n, n)).astype(np.uint8)
        data = jpeg.encode(pixels)
        began = time.time()
        _, _, _, thumb = jpeg.thumbnail(data)
        took.append(time.time() - began)
        assert abs(thumb - pixels.reshape(n // 8, 8, n // 8, 8).mean(axis=(1, 3))).max() <= 1.01
    assert took[2] < 12 * took[1] + 1


def test_any_size_that_the_format_allows():
    flat = jpeg.encode(np.full((8, 8), 128, np.uint8))
    at = flat.index(b"\xff\xc0")
    huge = flat[: at + 5] + (20000).to_bytes(2, "big") * 2 + flat[at + 9 :]
    with pytest.raises(jpeg.NotBaseline, match="cut off"):  # and not for its dimensions
        jpeg.thumbnail(huge)
    tall = jpeg.encode(np.full((65528, 8), 77, np.uint8))
    w, h, n, thumb = jpeg.thumbnail(tall)
    assert (w, h, n, thumb.shape) == (8, 65528, 1, (8191, 1)) and (thumb == 77).all()


def colour(width, height, y, c):
    """A JPEG of three components, the luminance sampled twice as often each way; all blocks of a component follow from its level list, in scan order."""
    one = jpeg.encode(np.array([[128]], np.uint8))  # of quantisation by 8, so that levels are kept
    head = one[: one.index(b"\xff\xc0")]
    frame = b"\xff\xc0\0\x11\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = one[one.index(b"\xff\xc4") : one.index(b"\xff\xda")]
    codes, code, at = {}, 0, 0
    for bits, k in enumerate(jpeg.DC_COUNTS, 1):
        for _ in range(k):
            codes[jpeg.DC_SYMBOLS[at]] = f"{code:0{bits}b}"
            code, at = code + 1, at + 1
        code <<= 1
    last, out, y, c = [0, 0, 0], "", iter(y), iter(c)
    for _ in range(-(-width // 16) * -(-height // 16)):
        for k in (0, 0, 0, 0, 1, 2):
            v = next(y if k == 0 else c) - 128
            d, last[k] = v - last[k], v
            n = abs(d).bit_length()
            out += codes[n] + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + "1010"
    out += "1" * (-len(out) % 8)
    scan = int(out, 2).to_bytes(len(out) // 8, "big").replace(b"\xff", b"\xff\0")
    return head + frame + tables + b"\xff\xda\0\x0c\x03\x01\0\x02\0\x03\0\0\x3f\0" + scan + b"\xff\xd9"


def test_sampled_colour():
    rng = np.random.default_rng(3)
    y, c = rng.integers(0, 256, 4 * 6).tolist(), rng.integers(0, 256, 2 * 6).tolist()
    w, h, n, thumb = jpeg.thumbnail(colour(45, 30, y, c))
    assert (w, h, n, thumb.shape) == (45, 30, 3, (4, 6))
    for mcu in range(6):
        r, k = divmod(mcu, 3)
        assert thumb[2 * r : 2 * r + 2, 2 * k : 2 * k + 2].ravel().tolist() == y[4 * mcu : 4 * mcu + 4]


def test_broken_pictures_are_told_and_never_crash():
    data, rng = jpeg.encode(np.add.outer(np.arange(24), np.arange(24)).astype(np.uint8) * 4, 2), random.Random(4)
    for i in range(len(data) - 2):
        with pytest.raises(jpeg.NotBaseline):
            jpeg.thumbnail(data[:i])
    for _ in range(400):
        x = bytearray(data)
        x[rng.randrange(len(x))] = rng.randrange(256)
        try:
            jpeg.thumbnail(bytes(x))
        except jpeg.NotBaseline:
            pass


def test_media_columns(spark):
    rows = [(1, [float(i) for i in range(64)]), (2, None), (3, [1.0]), (4, [2.0] * 64), (4, [2.0] * 64), (None, [float("nan")] * 64)]
    media = jpeg.media_of(spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, width int, error string"))
    got = jpeg.decode_media(media, "vec_id", "media").collect()
    by = {r["vec_id"]: r for r in got}
    assert len(got) == 6 and by[2]["error"] and by[3]["error"] and by[4]["average_hash"] == -1 and by[4]["difference_hash"] == 0
    means = jpeg.pictures_of(np.arange(64)[None])[0].reshape(8, 8, 8, 8).mean(axis=(1, 3))
    assert abs(np.array(list(by[1]["thumbnail"])).reshape(8, 8) - means).max() <= 1 and (by[1]["width"], by[1]["thumb_width"]) == (64, 8)
    assert jpeg.decode_media(media.where("false"), "vec_id", "media").count() == 0
