"""HTML content extraction by text-to-tag ratios.

The events of the standard library's parser, fed in pieces, are turned into lines: a line ends at a line end of the source or at the start
or end of a block element. A line's ratio is its characters of text divided by its tags (at least 1). The ratios are smoothed with a
Gaussian of SIGMA lines over 3 SIGMA on either side, normalised at the ends, and the lines are clustered by a threshold, the standard
deviation of the smoothed ratios times LAMBDA: lines from it on are content, in one region for each run of them.

Defined results: a null or empty page, one without text, and one whose ratios are all 0 give an empty text, 0 regions and lines as
counted; where all lines are equal the threshold is 0 and all of them are content; broken markup is read as the parser reads it; script,
style, noscript, template and comments hold no text; a noscript or template that isn't closed before its parent or the page ends is read
as though its start tag weren't there, so that it silences nothing; repeated rows are read each for itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strata.llm import storage
from strata.llm import text as kernels

SIGMA = 1.0
LAMBDA = 1.0
PIECE = 1 << 16
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Lines(HTMLParser):
    """Collects text and number of tags of each line.

    What a silent element holds is kept aside: it goes when the element is closed, and is read after all when the element turns out not
    to be closed, at the end tag of an element around it or the end of the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.tags: list[int] = []
        self._text: list[str] = []
        self._tags = 0
        self._open: list[str] = []  # open elements
        self._places: dict[str, list[int]] = {}  # where in it each name is
        self._silent: int | None = None  # place of the outermost silent one
        self._aside: list[tuple[bool, bool, str]] = []

    def _end(self):
        if self._text or self._tags:
            self.texts.append(" ".join("".join(self._text).split()))
            self.tags.append(self._tags)
            self._text, self._tags = [], 0

    def _tag(self, starts: bool, tag: str):
        if starts and tag in BLOCKS:
            self._end()
        self._tags += 1
        if not starts and tag in BLOCKS:
            self._end()

    def _data(self, data: str):
        first, *rest = data.split("\n")
        self._text.append(first)
        for line in rest:
            self._end()
            self._text.append(line)

    def _take(self, is_tag: bool, starts: bool, value: str):
        if self._silent is not None:
            self._aside.append((is_tag, starts, value))
        elif is_tag:
            self._tag(starts, value)
        else:
            self._data(value)

    def _unsilence(self, read: bool):
        aside, self._aside, self._silent = self._aside, [], None
        for is_tag, starts, value in aside if read else [x for x in aside if x[0]]:
            if not read:
                self._tags += 1
            elif is_tag:
                self._tag(starts, value)
            else:
                self._data(value)

    def handle_starttag(self, tag, attrs):
        self._take(True, True, tag)
        if tag in VOID:
            return
        if tag in SILENT and self._silent is None:
            self._silent = len(self._open)
        self._places.setdefault(tag, []).append(len(self._open))
        self._open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._take(True, True, tag)

    def handle_endtag(self, tag):
        places = self._places.get(tag)
        if places:
            place = places[-1]
            while len(self._open) > place:
                self._places[self._open.pop()].pop()
            if self._silent is not None and place <= self._silent:
                self._unsilence(place < self._silent)
        self._take(True, False, tag)

    def handle_data(self, data):
        self._take(False, False, data)

    def close(self):
        super().close()
        if self._silent is not None:
            self._unsilence(self._open[self._silent] not in ("script", "style"))
        self._end()


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """ratios under a Gaussian of sigma lines, its weights normalised over the lines there are."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    full = lambda x: np.convolve(x, kernel)[r : r + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def extract(html: str | None, sigma: float = SIGMA, weight: float = LAMBDA) -> tuple[str, int, int]:
    """(content, regions, lines) of a page."""
    parser = Lines()
    html = html or ""
    for i in range(0, len(html), PIECE):
        parser.feed(html[i : i + PIECE])
    parser.close()
    if not parser.texts:
        return "", 0, 0
    ratios = np.array([len(t) for t in parser.texts], float) / np.maximum(1, parser.tags)
    if not ratios.any():
        return "", 0, len(ratios)
    even = smooth(ratios, sigma)
    chosen = even >= weight * even.std() if np.ptp(ratios) else np.ones(len(ratios), bool)
    regions = int(chosen[0]) + int((chosen[1:] & ~chosen[:-1]).sum())
    return "\n".join(t for t, c in zip(parser.texts, chosen) if c and t), regions, len(ratios)


def extract_content(pages: DataFrame, sigma: float = SIGMA, weight: float = LAMBDA) -> DataFrame:
    """(page_id, text, n_chars, regions, lines) of every row."""
    storage.bound_batches(pages.sparkSession)

    def work(batches):
        for batch in batches:
            for first, block in kernels.slices(kernels.strings(batch.column(1)), 8 << 20):
                rows = [extract(x, sigma, weight) for x in block.to_pylist()]
                yield pa.record_batch(
                    [batch.column(0).slice(first, len(rows)), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
                    names=["page_id", "text", "n_chars", "regions", "lines"],
                )

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, n_chars long, regions int, lines int"
    return pages.select("page_id", "html").mapInArrow(work, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_content(spark.read.parquet(f"{sf_dir}/pages.parquet"))
