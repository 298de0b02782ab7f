"""License scan: ordered signature rules behind a keyword prefilter.

The text is put in lower case and runs of white space become one space. The rules' keywords are looked for first, in one pass over the
text with an automaton; only expressions whose keyword occurs are tried. Their matches are the detections, and overlaps are resolved so:
the detections are taken in order of priority (higher first), then length (longer first), then place, then order of the rules; one is
dropped if its interval is contained in that of a detection already taken, or contains that of one of a higher priority. What remains
is listed by place. Partly overlapping detections all remain. An SPDX line, the rule of highest priority, then stands for the licences
that its expression names: a detection for each, by the rules' name for it where they have one.

Defined results: a null or empty text has no detection; a text without any has an empty list; texts of any length are scanned whole;
repeated rows are scanned each for itself; an empty table gives an empty result; other columns are ignored. Places are those of
characters in the normalised text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from strata.llm import storage, text
from strata.llm.license_rules import RULES

_SCHEMA = "licenses array<string>, detections array<struct<license: string, rule: int, start: int, end: int>>, n_detections int"
_BLOCK = 4 << 20
SPDX = "SPDX-tag"
_IDENTIFIER = re.compile(r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?")
#: Names of the rules by their form in lower case, as SPDX lines have them.
_NAMES = {r[0].lower(): r[0] for r in RULES}


@cache
def _compiled():
    import ahocorasick

    a, by = ahocorasick.Automaton(), {}
    for i, (_, _, keyword, _) in enumerate(RULES):
        by.setdefault(keyword, []).append(i)
    for keyword, rules in by.items():
        a.add_word(keyword, rules)
    a.make_automaton()
    return a, [re.compile(r[3]) for r in RULES]


#: In every keyword there is one of these; a text that has none needs no automaton.
ROOTS = ("licen", "apache", "mit-", "mit no", "bsd", "gpl", "gnu", "gfdl", "mpl-", "mozilla", "epl-", "cddl", "cpal", "eupl", "cc ", "cc-", "cc0", "creative commons", "creativecommons", "attribution-", "odbl", "odc-by", "open data commons", "cdla", "unencumbered", "wtfpl", "do what the", "plainly marked", "bsl-", "busl", "sspl", "elastic-", "commons clause", "artistic", "same terms", "psf-", "python-", "cnri", "php-", "ofl-", "bitstream", "independent jpeg", "unicode", "w3c", "openssl", "ssleay", "qpl-", "osl-", "afl-", "ecl-", "realnetworks", "ms-pl", "ms-rl", "nposl", "nasa", "beer", "good, not evil", "lppl", "bzip2", "hpnd", "historical permission", "zpl-", "libpng", "zero clause", "cecill", "mulan", "upl-", "blueoak", "anti-996", "openrail", "bigscience", "public domain", "all rights", "proprietary", "unauthorized", "spdx", "copyright", "without warranty", "permission", "redistribution", "endorse", "advertising", "any later version", "asl 2", "classpath", "sleepycat", "polyform", "llama")


def normalise(t: str) -> str:
    return re.sub(r"\s+", " ", t.lower())


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(rule, start, end) of the detections that remain, by place.

    None that remains contains another, so that in order of their starts their ends rise too: of those that begin no later the last one
    ends last, and of those that begin no earlier the first one ends first.
    """
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for rule, start, end in sorted(set(found), key=lambda f: (-RULES[f[0]][1], f[1] - f[2], f[1], f[0])):
        after, at = bisect_right(starts, start), bisect_left(starts, start)
        if (after and kept[after - 1][2] >= end) or (at < len(kept) and kept[at][2] <= end):
            continue
        starts.insert(at, start)
        kept.insert(at, (rule, start, end))
    return kept


def scan_text(t: str | None) -> list[tuple[int, int, int]]:
    """(rule, start, end) of the detections in a text."""
    return _detect(normalise(t)) if t else []


def _detect(t: str) -> list[tuple[int, int, int]]:
    automaton, expressions = _compiled()
    rules: set[int] = set()
    for _, some in automaton.iter(t):
        rules.update(some)
    return resolve([(i, m.start(), m.end()) for i in rules for m in expressions[i].finditer(t)]) if rules else []


def detections(t: str | None) -> list[tuple[str, int, int, int]]:
    """(license, rule, start, end) of the detections in a text, with the licences of an SPDX line each for itself."""
    if not t:
        return []
    out, t = [], normalise(t)
    for i, s, e in _detect(t):
        name = RULES[i][0]
        if name != SPDX:
            out.append((name, i, s, e))
            continue
        at = t.index(":", s, e) + 1
        for m in _IDENTIFIER.finditer(t, at, e):
            if m[0] not in ("and", "or", "with"):
                out.append((_NAMES.get(m[0], m[0]), i, m.start(), m.end()))
    return out


def _gate() -> str:
    return "|".join(re.escape(r) for r in ROOTS)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, detections, n_detections) of every row; licenses are distinct, in order of place."""
    storage.bound_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("license", pa.string()), ("rule", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    loose = re.sub(r"(?<!\\) |\\ ", lambda _: r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", _gate())  # all that \s is in Python

    def work(batches):
        for batch in batches:
            for first, block in text.slices(text.strings(batch.column(1)), _BLOCK):
                likely = pc.fill_null(pc.match_substring_regex(pc.utf8_lower(block), loose), False).to_pylist()
                rows = [[{"license": n, "rule": i, "start": s, "end": e} for n, i, s, e in detections(block[k].as_py())] if x else [] for k, x in enumerate(likely)]
                names = [list(dict.fromkeys(d["license"] for d in r)) for r in rows]
                yield pa.record_batch([batch.column(0).slice(first, len(block)), pa.array(names, pa.list_(pa.string())), pa.array(rows, kind), pa.array([len(r) for r in rows], pa.int32())], names=["doc_id", "licenses", "detections", "n_detections"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
