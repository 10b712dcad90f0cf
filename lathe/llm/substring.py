"""Substring dedup with compressed FM-indexes.

Each shard of candidate passages is indexed by the Burrows-Wheeler transform of its words in a wavelet matrix over bit-packed
levels. The documents' passages are streamed backwards through it; their matching statistics up to the window are read off the
intervals, and windows whose interval has been met at an earlier place are reported.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import batch_limits, rewritten, texts
from lathe.llm.regions import Windows, ranks, repeated, unite, with_rows


class FMIndex:
    """Over an array of symbols 1..; 0 is kept for the end. Kept are the transform's levels, bit-packed, and counts; the suffixes'
    order is not: intervals say how often a pattern occurs, and equal patterns have equal intervals."""

    def __init__(self, symbols: np.ndarray):
        s = np.append(symbols, 0).astype(np.int64)
        n = len(s)
        rows = np.argsort(s, kind="stable")
        rank = np.cumsum(np.concatenate(([0], np.diff(s[rows]) > 0)))
        inverse = np.empty(n, np.int64)
        inverse[rows] = rank
        step = 1
        while rank[-1] < n - 1:
            after = np.zeros(n, np.int64)
            after[:-step] = inverse[step:] + 1
            key = inverse * (n + 1) + after
            rows = np.argsort(key, kind="stable")
            rank = np.cumsum(np.concatenate(([0], np.diff(key[rows]) > 0)))
            inverse[rows] = rank
            step *= 2
        bwt = s[rows - 1]
        self.n, self.top = n, int(s.max())
        self.less = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=self.top + 1))))
        self.levels = max(1, self.top.bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(8 + -len(packed) % 8, np.uint8)).view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int32), dtype=np.int32)))[: len(packed)])
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate((bwt[~bit], bwt[bit]))
        self.begin = self._walk(np.arange(self.top + 1), np.zeros(self.top + 1, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where place i of the transform lands when the levels sort it along symbol c."""
        for k in range(self.levels):
            word = i >> 6
            ones = self.ones[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(c >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i

    def back(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c + pattern from those of pattern."""
        base = self.less[c] - self.begin[c]
        both = self._walk(np.concatenate((c, c)), np.concatenate((lo, hi)))
        return base + both[: len(c)], base + both[len(c) :]

    def matches(self, query: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics, at most size, of query[:e] for each end e, read backwards: length, and the interval it has."""
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        length = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for k in range(1, size + 1):
            live = live[ends[live] >= k]
            c = query[ends[live] - k]
            known = (c > 0) & (c <= self.top)
            live, c = live[known], c[known]
            a, b = self.back(c, lo[live], hi[live])
            found = a < b
            live = live[found]
            lo[live], hi[live], length[live] = a[found], b[found], k
            if not len(live):
                break
        return length, lo, hi


def repeats(pieces: list[bytes], starts: list[int], order: list[tuple[int, int, int]], size: int, block: int = 1 << 18) -> list[np.ndarray]:
    """For each piece (words apart by blanks), which of its first starts[i] windows equal one that is earlier by order, (document,
    first start, row). All pieces are in one index; then each is streamed through it."""
    ids: dict[bytes, int] = {}
    flat: list[int] = []
    ends = []
    for r, n in zip(pieces, starts, strict=True):
        ends.append(np.arange(n) + len(flat) + size)
        flat += [ids.setdefault(w, len(ids) + 1) for w in r.split()]
    symbols = np.array(flat, np.int64)
    index = FMIndex(symbols)
    ends, early = np.concatenate(ends), ranks(order, starts)
    begin = np.empty(len(ends), np.int64)
    several = np.empty(len(ends), bool)
    for at in range(0, len(ends), block):
        length, lo, hi = index.matches(symbols, ends[at : at + block], size)
        begin[at : at + block], several[at : at + block] = lo, (length >= size) & (hi - lo > 1)
    # Reported intervals: equal windows have the same, and all of them are streamed, so the least start seen is the first.
    hit = np.zeros(len(ends), bool)
    own = np.flatnonzero(several)
    _, group = np.unique(begin[own], return_inverse=True)
    least = np.full(len(own), np.iinfo(np.int64).max)
    np.minimum.at(least, group, early[own])
    hit[own] = early[own] > least[group]
    return np.split(hit, np.cumsum(starts)[:-1])


WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def outside(items: list, gone: list[tuple[int, int]]) -> list:
    if not gone:
        return items
    cut = [0, *(v for xy in gone for v in xy), len(items)]
    return [w for x, y in zip(cut[::2], cut[1::2], strict=True) for w in items[x:y]]


def without(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    """text less the words in gone and the white space after each; unchanged if nothing is."""
    return b"".join(outside(WORD.findall(text), gone)) if gone else text


def remove_repeats(docs: DataFrame, size: int = 20, gram: int = 4, text: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 and, with text, the text less what is removed, and the spans.

    Every word that a window of size words covers which also starts earlier (smaller doc_id, or same document and earlier start)
    is removed; windows are judged on the input. In kept_text, a text with nothing removed is unchanged, and else the words left
    keep the white space after them. Null and empty texts have no words; an empty table gives no rows; other columns are not read.
    Equal rows have equal results; rows that share a doc_id, or have none, with other texts are judged each by its own words: of
    two equal windows the one with the smaller start stays, at one start that of the smaller text hash. Very long texts are
    hashed in overlapping chunks; a text's spans are gathered with it.
    """
    batch_limits(docs.sparkSession)
    spans = repeated(docs, Windows(words=True, size=size, gram=gram), lambda pieces, starts, order: repeats(pieces, starts, order, size))
    keyed = with_rows(docs.select("doc_id", "text")).join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(texts(b.column("text")), b.column("spans").to_pylist(), strict=True):
                words = t.split()
                gone = unite(s, len(words))
                n = sum(y - x for x, y in gone)
                whole = without(t, gone) if text else b""
                words = outside(words, gone)
                out.append((n + len(words), n, hashlib.sha256(b" ".join(words)).hexdigest(), whole, gone))
            cols = [b.column("doc_id").cast(pa.int64()), *(pa.array([r[i] for r in out], k) for i, k in enumerate([pa.int64()] * 2 + [pa.string()]))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if text:
                cols += [pa.array([r[3] for r in out], pa.binary()).cast(pa.string()), pa.array([[{"a": x, "b": y} for x, y in r[4]] for r in out], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]
                names += ["kept_text", "removed"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return keyed.mapInArrow(run, schema + ", kept_text string, removed array<struct<a: long, b: long>>" * text)


def keep_first_passages(docs: DataFrame, size: int = 20, gram: int = 4) -> DataFrame:
    """docs with all its columns, texts less their repeated words; rows are judged as in remove_repeats. Null and empty texts, and
    texts without a repeat, stay as they are; n_chars follows the text; an empty table stays empty."""
    spans = repeated(docs, Windows(words=True, size=size, gram=gram), lambda pieces, starts, order: repeats(pieces, starts, order, size))

    def decide(raw: list[bytes], found: list) -> list[bytes | None]:
        return [without(t, unite(s, len(t.split()))) if s else t for t, s in zip(raw, found, strict=True)]

    return rewritten(docs, lambda: decide, spans)
