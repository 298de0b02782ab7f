"""Byte-pair encoding by a trie of the distinct words, and decoding.

A text is cut into words by the tokenizer's pattern. The distinct words of a task's batch are put into a trie by their bytes, and the trie
is walked depth first. The state of a node is the last token of its prefix's encoding: among the tokens that end the prefix, the one
that may follow the last token of what is before it, where one token may follow another if encoding the two together leaves them apart.
Exactly one does, so a prefix that many words share is encoded once. The tokens that end a prefix are found in a trie of all tokens
backwards, so that the work grows with a word's length, however long. A word's encoding is read back along the last tokens.

Whether two tokens may stand beside each other is found by undoing merges: the later of the two tokens' merges is split until a pair
across the border would have been merged earlier, which forbids the two, or nothing is left to split.

Defined results: a null text gives null tokens, an empty one an empty list; texts of any length are encoded whole; bytes that the
vocabulary lacks can't occur in a byte-level vocabulary; special tokens are ordinary text; decode() of a list with an unknown id raises
KeyError; repeated rows are encoded each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from strata.llm import storage, text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLOCK = 4 << 20
#: Words that an encoder remembers; when there are more it forgets all of them and goes on.
REMEMBERED = 1 << 18
#: Pairs of tokens of which it is remembered whether they may stand together.
PAIRS = 1 << 20


class Vocabulary:
    """Ranks of byte strings, read from a file of base64 strings and ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks), default=0)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                pair = self._last_merge(token, rank)
                if pair:
                    self.halves[rank] = pair
                    self.merged[pair] = rank
        self.backwards: dict = {}  # byte to the node before it; under -1 the token that begins there
        for token, rank in self.ranks.items():
            node = self.backwards
            for x in reversed(token):
                node = node.setdefault(x, {})
            node[-1] = rank
        self.apart: dict[int, bool] = {}
        sizes = np.zeros(max(self.tokens, default=-1) + 2, np.int64)
        for rank, token in self.tokens.items():
            sizes[rank] = len(token)
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.frombuffer(b"".join(self.tokens[r] for r in sorted(self.tokens)), np.uint8)

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < rank and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a."""
        known = self.apart.get(a << 32 | b)
        if known is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            known = self.apart[a << 32 | b] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        limit = 1 << 62
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < limit:
                return False
            if a > b:
                limit = a
                if a not in self.halves:
                    return True
                a = self.halves[a][1]
                if a == limit:
                    return True
            else:
                limit = b + 1
                if b not in self.halves:
                    return True
                b = self.halves[b][0]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodings of words, found through a trie of those that come together."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}  # place of each word
        self.tokens, self.ends = array("i"), array("q", [0])

    def learn(self, words: list[str]):
        """Encode distinct words: sorted, neighbours share the path of their common prefix, so the walk visits each node of their trie once, depth first."""
        root, follows, known = self.v.backwards, self.v.follows, self.v.apart
        before = b""
        path: list[int] = []  # last token of each prefix of `before`, from one byte on
        begins: list[int] = []  # where those tokens begin
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            share, most = 0, min(len(raw), len(before))
            while share < most and raw[share] == before[share]:
                share += 1
            del path[share:], begins[share:]
            for end in range(share, len(raw)):
                node, begin = root, end
                while True:
                    node = node.get(raw[begin])
                    if node is None:
                        raise ValueError("a byte that the vocabulary lacks")
                    token = node.get(-1)
                    if token is not None:
                        if not begin:
                            break
                        last = path[begin - 1]
                        fits = known.get(last << 32 | token)
                        if fits or (fits is None and follows(last, token)):
                            break
                    if not begin:
                        raise ValueError("a byte that the vocabulary lacks")
                    begin -= 1
                path.append(token)
                begins.append(begin)
            before = raw
            out, at = [], len(raw)
            while at:
                out.append(path[at - 1])
                at = begins[at - 1]
            out.reverse()
            self.known[word] = len(self.ends) - 1
            self.tokens.extend(out)
            self.ends.append(len(self.tokens))

    def encode_words(self, words) -> None:
        new = set(words)
        total = new
        new = new.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED and self.known:
            self.forget()
            new = total
        if new:
            self.learn(list(new))

    def encode_texts(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts given as lists of words, and the n + 1 offsets of the texts."""
        self.encode_words(chain.from_iterable(split))
        at = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, at[-1])
        ends = np.array(self.ends)
        flat, off = gather(np.array(self.tokens, np.int32), ends[ids], ends[ids + 1] - ends[ids])
        return flat, off[at]


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of values that begin at starts, one after another, and their n + 1 offsets."""
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return values[np.arange(off[-1]) + np.repeat(starts - off[:-1], sizes)], off


@cache
def encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


@cache
def _pattern(pattern: str):
    return regex.compile(pattern)


def encode_texts(texts: list[str | None], path: str = VOCABULARY, pattern: str = PATTERN) -> list[list[int] | None]:
    """Tokens of each text."""
    return _encode(texts, path, pattern)[2].to_pylist()


def _encode(texts: list[str | None], path: str, pattern: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens of all texts, the n + 1 offsets of the texts, and both as lists."""
    find = _pattern(pattern).findall
    flat, off = encoder(path).encode_texts([find(t) if t is not None else [] for t in texts])
    none = pa.array([t is None for t in texts], pa.bool_())
    return flat, off, pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat), mask=none)


def _restores(flat: np.ndarray, off: np.ndarray, block: pa.Array, path: str) -> np.ndarray:
    """Whether each text's tokens decode to its bytes."""
    v = vocabulary(path)
    data, at = gather(v.bytes, v.starts[flat], v.sizes[flat])
    want, ends = text.raw_bytes(block)
    same = np.diff(at[off]) == np.diff(ends)
    if same.all():
        wrong = np.flatnonzero(data != want)
        same[np.searchsorted(ends, wrong, "right") - 1] = False
        return same
    return np.array([data[at[a] : at[b]].tobytes() == want[i:j].tobytes() for a, b, i, j in zip(off, off[1:], ends, ends[1:])])


def decode_tokens(tokens: list[int] | None, path: str = VOCABULARY) -> str | None:
    """The text of a list of tokens; bytes that aren't UTF-8 become the replacement character."""
    return None if tokens is None else b"".join(map(vocabulary(path).tokens.__getitem__, tokens)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens, n_tokens) of every row."""
    storage.bound_batches(docs.sparkSession)

    def work(batches):
        text.trim()
        for batch in batches:
            for first, block in text.slices(text.strings(batch.column(1)), _BLOCK):
                _, off, rows = _encode(block.to_pylist(), path, pattern)
                yield pa.record_batch([batch.column(0).slice(first, len(block)), rows, pa.array(np.diff(off), mask=rows.is_null().to_numpy(zero_copy_only=False))], names=["doc_id", "tokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens array<int>, n_tokens long")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows with doc_id and tokens."""
    storage.bound_batches(encoded.sparkSession)

    def work(batches):
        text.trim()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([decode_tokens(t, path) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "tokens").mapInArrow(work, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens, n_tokens, same): the tokens of every row and whether they decode to its text."""
    storage.bound_batches(docs.sparkSession)

    def work(batches):
        text.trim()
        for batch in batches:
            for first, block in text.slices(text.strings(batch.column(1)), _BLOCK):
                flat, off, rows = _encode(block.to_pylist(), path, pattern)
                none = rows.is_null().to_numpy(zero_copy_only=False)
                yield pa.record_batch([batch.column(0).slice(first, len(block)), rows, pa.array(np.diff(off), mask=none), pa.array(_restores(flat, off, block, path), mask=none)], names=["doc_id", "tokens", "n_tokens", "same"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens array<int>, n_tokens long, same boolean")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
