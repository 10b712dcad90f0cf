"""Packing documents into windows by non-negative least squares.

Documents are cut into full windows and a rest. Combinations of few rests that fill a window are enumerated, and how often to use
each is solved against the histogram of lengths by non-negative least squares. The counts are rounded down, and what is left is
packed greedily. Only the histogram, at most window numbers, goes to the driver; the plan it makes is bounded too.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.bytebpe import ByteBPE
from lathe.llm.common import batch_limits, partitions, staged, texts

Recipe = tuple[int, list[tuple[int, int]]]


def combinations(lengths: list[int], window: int, depth: int = 3, columns: int = 6000) -> list[tuple[int, ...]]:
    """Combinations of at most depth lengths, longest first, that fill the window: all pairs, then triples in rounds, each round
    with another middle part for each longest part, until there are columns of them."""
    have = set(lengths)
    out = [(a, window - a) for a in sorted(have, reverse=True) if 2 * a >= window and window - a in have]
    if depth < 3:
        return out[:columns]
    longest = sorted((a for a in have if 3 * a >= window), reverse=True)
    middles = {a: [b for b in sorted(have) if b <= a and window - a - b in have and window - a - b <= b] for a in longest}
    turn = 0
    while len(out) < columns and any(middles.values()):
        for a in longest:
            if middles[a]:
                # alternately near the middle of the choice, and its ends: columns of unlike shape
                b = middles[a].pop((len(middles[a]) // 2, 0, -1)[turn % 3])
                out.append((a, b, window - a - b))
        turn += 1
    return out[:columns]


def non_negative_least_squares(columns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """x >= 0 with least |A x - histogram|; a column of A counts its lengths. Cyclic coordinate descent: each step solves one
    coordinate exactly and clips it at zero."""
    x = np.zeros(len(columns))
    left = histogram.astype(float).tolist()
    parts = [[(n, c.count(n)) for n in set(c)] for c in columns]
    norms = [sum(k * k for _, k in p) for p in parts]
    for _ in range(sweeps):
        moved = 0.0
        for j, p in enumerate(parts):
            step = max(-x[j], sum(k * left[n] for n, k in p) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, k in p:
                    left[n] -= k * step
        if moved < 0.25:
            break
    return x


def plan(histogram: dict[int, int], window: int) -> list[Recipe]:
    """Recipes (repeats, [(length, how many)]) that use each piece of the histogram {length: count} exactly once."""
    left = np.zeros(window + 1, np.int64)
    for n, count in histogram.items():
        left[n] += count
    out: list[Recipe] = []
    if left[window]:
        out.append((int(left[window]), [(window, 1)]))
        left[window] = 0
    columns = combinations([int(n) for n in np.flatnonzero(left)], window)
    for c, x in zip(columns, non_negative_least_squares(columns, left), strict=True):
        parts = [(n, c.count(n)) for n in sorted(set(c), reverse=True)]
        times = int(min([np.floor(x), *(left[n] // k for n, k in parts)]))
        if times > 0:
            out.append((times, parts))
            for n, k in parts:
                left[n] -= times * k
    # Greedy rest: the longest piece, then always the longest that fits. A recipe is repeated until one of its lengths runs out.
    lengths = [int(n) for n in np.flatnonzero(left)]
    while lengths:
        room, parts = window, {}
        while room > 0:
            at = bisect.bisect_right(lengths, room)
            while at and parts.get(lengths[at - 1], 0) >= left[lengths[at - 1]]:
                at -= 1
            if not at:
                break
            n = lengths[at - 1]
            k = min(room // n, int(left[n]) - parts.get(n, 0))
            parts[n] = parts.get(n, 0) + k
            room -= n * k
        times = min(int(left[n]) // k for n, k in parts.items())
        out.append((times, list(parts.items())))
        for n, k in parts.items():
            left[n] -= times * k
        lengths = [n for n in lengths if left[n]]
    return out


def pieces(docs: DataFrame, tokenizer: bytes, window: int = 2048, end: int = 1) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens): each document's ids and end, cut at full windows."""
    batch_limits(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    last = np.uint32(end).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(shared.value)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), bpe.ids_with_added([x.decode("utf-8", "replace") for x in texts(b.column("text"))]), strict=True):
                n = len(ids) // 4 + 1
                for at in range(0, n, window):
                    part = ids[4 * at : 4 * (at + window)]
                    if at + window >= n:
                        part += last
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack(docs: DataFrame, tokenizer: bytes, window: int = 2048, end: int = 1) -> DataFrame:
    """pieces() of docs with (sequence_id, offset): where each piece lies.

    Texts are tokenized once; ids are not shuffled. A null or empty text is the end id alone, a null id passes through, repeated
    rows are each packed, and an empty table gives no sequences. Pieces of one length are numbered over the whole table: within
    (length, salt), then by the salts' counts, so that a length that most pieces share is dealt over all tasks.
    """
    spark = docs.sparkSession
    salted = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(partitions(spark)))
    cut = staged(pieces(docs, tokenizer, window, end).withColumn("salt", salted), "pieces")
    counts = cut.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    recipes = plan(histogram, window)

    # For each length its pieces' numbers from first on go to sequences from base on, many to a sequence, from offset on.
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, parts in recipes:
        offset = 0
        for n, k in parts:
            rows.append((n, used.get(n, 0), base, k, offset))
            used[n] = used.get(n, 0) + times * k
            offset += n * k
        base += times
    rows.sort()
    spots = spark.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 5))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    numbered = cut.withColumn("number", within).join(counts.select("length", "salt", before.alias("before")), ["length", "salt"])
    numbered = numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("number") + F.col("before")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, base, many, offset = spots.value.T
        order = n * (1 << 48) + first
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            at = np.searchsorted(order, length * (1 << 48) + number, side="right") - 1
            k = number - first[at]
            cols = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            cols += [pa.array(base[at] + k // many[at]), pa.array(offset[at] + k % many[at] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*numbered_names, "sequence_id", "offset"])

    numbered_names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return numbered.mapInArrow(place, ", ".join(f"{n} long" for n in [*numbered_names, "sequence_id", "offset"]))
