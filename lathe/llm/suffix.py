"""Suffix-array dedup: bytes that an equal string of fixed length covered earlier are removed.

The array is built by prefix doubling: suffixes get ranks by as many first signs as fit in a number, then by twice as many with each
round, from the rank of the suffix that begins where the known signs end. As only strings of a fixed size are compared, the rounds end
as soon as that many signs are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import batch_limits, mix, texts
from lathe.llm.regions import Hashes, Windows, ranks, repeated, unite, with_rows


#: A random number for each byte.
SIGNS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffix_array(text: bytes | list[int], upto: int | None = None) -> list[int] | np.ndarray:
    """Starts of all suffixes of text in ascending order; upto: as far as their first upto signs tell, others in any order."""
    n = len(text)
    if not n:
        return []
    signs = np.frombuffer(text, np.uint8).astype(np.int64) if isinstance(text, bytes) else np.unique(text, return_inverse=True)[1].astype(np.int64)
    base, width, key = int(signs.max()) + 2, 0, np.zeros(n, np.int64)
    while width == 0 or (width + 1 < n and base ** (width + 1) < 1 << 62):  # the first signs in one number; behind the end is 0
        key *= base
        key[: n - width] += signs[width:] + 1
        width += 1
    while True:
        order = np.argsort(key)
        key = key[order]
        step = np.append(0, np.cumsum(key[1:] != key[:-1]))
        if step[-1] == n - 1 or width >= (upto or n):
            return order if upto else order.tolist()
        rank = np.empty(n, np.int64)
        rank[order] = step
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        width *= 2


def repeats(pieces: list[bytes], starts: list[int], order: list[tuple[int, int, int]], size: int, block: int = 1 << 16) -> list[np.ndarray]:
    """For each piece, which of its first starts[i] strings of size bytes equal one that is earlier by order, (document, first start, row)."""
    flat = b"".join(pieces)
    lengths = np.array(list(map(len, pieces)))
    begin = np.cumsum(lengths) - lengths
    own = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(sum(starts))
    early = np.empty(len(flat), np.int64)
    early[own] = ranks(order, starts)
    # A string whose hash no other string of the shard has cannot repeat: only runs of the others, closer than their size, are
    # put into the array. What repeats is then decided on the bytes.
    hashes = Hashes(SIGNS[np.frombuffer(flat, np.uint8)]).grams(size)[own]
    _, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    valid = own[counts[at] > 1]
    hit = np.zeros(len(flat), bool)
    if len(valid):
        near = valid[1:] - valid[:-1] < size
        first, last = valid[np.concatenate(([True], ~near))], valid[np.concatenate((~near, [True]))]
        text = b"".join([flat[a : b + size] for a, b in zip(first.tolist(), last.tolist(), strict=True)])
        lengths = last - first + size
        shift = first - (np.cumsum(lengths) - lengths)  # from places in text to places in flat
        inside = np.zeros(len(text), bool)
        inside[valid - np.repeat(shift, np.diff(np.append(np.searchsorted(valid, first), len(valid))))] = True
        # Strings of size bytes that begin at valid places lie inside their run, so no separators are needed.
        array = suffix_array(text, size)
        array = array[inside[array]]
        array += shift[np.searchsorted(np.cumsum(lengths), array, side="right")]
        views = np.lib.stride_tricks.sliding_window_view(np.frombuffer(flat, np.uint8), size)
        same = np.zeros(len(array), bool)
        for i in range(1, len(array), block):
            j = min(len(array), i + block)
            same[i:j] = (views[array[i:j]] == views[array[i - 1 : j - 1]]).all(axis=1)
        least = np.minimum.reduceat(early[array], np.flatnonzero(~same))[np.cumsum(~same) - 1]
        hit[array] = early[array] > least
    return [hit[a : a + n] for a, n in zip(begin.tolist(), starts, strict=True)]


def remove_repeats(docs: DataFrame, size: int = 100, gram: int = 24, text: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with text, what is kept (bytes) and the spans.

    Every byte that a string of size bytes covers which also starts earlier (smaller doc_id, or same document and earlier start)
    is removed; strings are judged on the input. Null texts are empty; an empty table gives no rows; other columns are not read.
    Equal rows have equal results; rows that share a doc_id, or have none, with other texts are judged each by its own bytes: of
    two equal strings the one with the smaller start stays, at one start that of the smaller text hash. Very long texts are
    hashed in overlapping chunks; a text's spans are gathered with it.
    """
    batch_limits(docs.sparkSession)
    rules = Windows(words=False, size=size, gram=gram)
    spans = repeated(docs, rules, lambda pieces, starts, order: repeats(pieces, starts, order, size))
    keyed = with_rows(docs.select("doc_id", "text")).join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(texts(b.column("text")), b.column("spans").to_pylist(), strict=True):
                gone = unite(s, len(t))
                at, kept = 0, []
                for x, y in gone:
                    kept.append(t[at:x])
                    at = y
                kept = b"".join([*kept, t[at:]]) if gone else t
                out.append((len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, gone))
            cols = [b.column("doc_id").cast(pa.int64()), *(pa.array([r[i] for r in out], k) for i, k in enumerate([pa.int64()] * 3 + [pa.string()]))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if text:
                cols += [pa.array([r[4] for r in out], pa.binary()), pa.array([[{"a": x, "b": y} for x, y in r[5]] for r in out], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]
                names += ["kept", "removed"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return keyed.mapInArrow(run, schema + ", kept binary, removed array<struct<a: long, b: long>>" * text)
