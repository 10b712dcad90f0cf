"""Language-model scoring with Brown class-based n-grams.

Exchange clustering gives the most frequent words classes. All other words that were learned from more than once then join these
classes as in Brown's algorithm: in windows of falling frequency, each word goes to the class that makes the class bigrams
likeliest, by counts of the classes around it. Only unseen words and those seen once get a class by their shape. A text's
probability is the product, over its words and an end, of the class's probability after the class before and the word's
probability in its class.

The documents are tokenized once, into batches of bounded size with a dictionary each; all later phases work on the numbers. What a
phase needs to know of words (counts, classes) it learns by parts: each batch sends the words of each part, by hash, in one row; a task
takes a part, of a bounded number of words, from all batches, and answers each in one row. The answers come before their batch, in
order, so that a task holds one batch or one part at a time, however many there are. No task or driver holds the vocabulary, and a
row's results come from its own batch, never by a key made from its text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import batch_limits, dropped, partitions, record_batches, release, split_words, staged

#: Classes of words by shape: three marks and a length in 8 steps.
SHAPES = 64

#: For each byte: 4 a digit, 2 neither letter nor digit of ASCII, 1 beyond ASCII.
MARKS = np.array([4 * (48 <= c < 58) + 2 * (not bytes([c]).isalnum()) + (c > 127) for c in range(256)], np.uint8)


def shapes(words: pa.Array) -> np.ndarray:
    """Of each word (large_binary, from its first on, none empty): digits, other signs than letters, any beyond ASCII; and the length."""
    if not len(words):
        return np.empty(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    kind = np.bitwise_or.reduceat(MARKS[np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]]], offsets[:-1])
    return 8 * kind.astype(np.int64) + np.minimum(7, np.diff(offsets) // 2)


@dataclass(frozen=True)
class Rules:
    """frequent: words that are exchanged; floor: the least count of a word that joins their classes; growth: how many times the
    words before it a window of joining words holds; classes: their number; sweeps: of the exchange; smooth: added counts; hot: how
    many words of batches meet in a part, on the average, or fewer; batch: bytes of text in a batch."""

    frequent: int = 1000
    floor: int = 2
    growth: int = 64
    classes: int = 48
    sweeps: int = 8
    smooth: float = 0.5
    hot: int = 1 << 19
    batch: int = 1 << 22


def packed(x: np.ndarray) -> bytes:
    """x, of numbers from 0 up, in the narrowest type, which a first sign names; first all lowest bytes, then all next ones, so that
    high bytes, which are mostly zero, compress."""
    top = int(x.max()) if len(x) else 0
    kind = "B" if top < 1 << 8 else "H" if top < 1 << 16 else "I" if top < 1 << 32 else "Q"
    x = x.astype(np.dtype(kind).newbyteorder("<"))
    return kind.encode() + x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def narrow(x: bytes) -> np.ndarray:
    """What was packed, in its narrow type."""
    kind = np.dtype(x[:1].decode()).newbyteorder("<")
    planes = np.frombuffer(x, np.uint8, offset=1).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def unpacked(x: bytes) -> np.ndarray:
    return narrow(x).astype(np.int64)


def chained(rows: list[bytes]) -> np.ndarray:
    """All that was packed in rows, one after the other."""
    return np.concatenate([np.empty(0, np.uint8), *map(narrow, rows)])


#: Batches in a file of a staged table. Readers and writers hold a file's batches at once.
FILE = 8

CODED = "batch long, kinds int, ids binary, absent binary, learn binary, sizes binary, words binary, index binary"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def one_row(schema: str, row: tuple) -> pa.RecordBatch:
    """row, of numbers and bytes, as a batch."""
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([x], types[f.split()[1]]) for x, f in zip(row, schema.split(", "), strict=True)], names=names_of(schema))


def coded(docs: DataFrame, limit: int) -> DataFrame:
    """docs(doc_id, text, learn) -> a row for each batch: its documents' ids, which are null and which are learned from, their numbers
    of words, the batch's different words, and the number of each word in order. A text over limit bytes is a batch of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 33, 0
        held: list[pa.RecordBatch] = []
        room = limit

        def out() -> pa.RecordBatch:
            nonlocal number, room
            text, ids, learn = (pa.concat_arrays([x.column(c) for x in held]) for c in ("text", "doc_id", "learn"))
            held.clear()
            words, index, offsets = split_words(text, lower=True)
            absent = np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes()
            learn = np.packbits(learn.to_numpy(zero_copy_only=False)).tobytes()
            number, room = number + 1, limit
            return one_row(CODED, (part + number, len(words), pc.fill_null(ids.cast(pa.int64()), 0).to_numpy().tobytes(), absent, learn, packed(np.diff(offsets)), b" ".join(words), packed(index)))

        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.append(0, np.cumsum(size + 16))  # empty texts take room, too
            at = 0
            while at < b.num_rows:
                end = int(np.searchsorted(size, size[at] + room, side="right")) - 1
                if end <= at and held:
                    yield out()
                    continue
                end = max(end, at + 1)
                held.append(b.slice(at, end - at))
                room -= int(size[end] - size[at])
                at = end
                if room <= 0:
                    yield out()
        if held:
            yield out()

    return docs.select("doc_id", "text", "learn").mapInArrow(run, CODED)


def dealt(rows: DataFrame) -> DataFrame:
    """rows(part, batch, ...): each part in one task, its rows in a row."""
    return rows.repartitionById(partitions(rows.sparkSession), F.col("part")).sortWithinPartitions("part", "batch")


def part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """Each part of what dealt() returns, and the columns of its rows."""
    last, held = None, []
    table = lambda: pa.Table.from_batches(held).to_pydict()
    for b in batches:
        part = b.column("part").to_numpy()
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]).tolist()
        for at, end in zip(first, [*first[1:], len(part)], strict=True):
            if part[at] != last and held:
                yield last, table()
                held = []
            last = int(part[at])
            held.append(b.slice(at, end - at))
    if held:
        yield last, table()


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins, and the end."""
    return np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)]), len(x))


SENT = "part int, batch long, places binary, words binary, lengths binary, n binary"
MET = "part int, batch long, places binary, ids binary, n binary, shapes binary, word binary, id int, count long, shape int"


def met_words(batches: DataFrame, parts: int) -> DataFrame:
    """CODED -> for each batch and part the words' places in the batch, their numbers in the part, how often each was learned from, over
    all batches, and their shapes; and, where batch is null, (part, id, word, count, shape) of each word that was learned from."""

    def send(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for words, index, learn, sizes, batch in zip(*(b.column(c).to_pylist() for c in ("words", "index", "learn", "sizes", "batch")), strict=True):
                if not words:
                    continue
                words, index, sizes = words.split(b" "), unpacked(index), unpacked(sizes)
                learn = np.unpackbits(np.frombuffer(learn, np.uint8), count=len(sizes)).astype(bool)
                n = np.bincount(index[np.repeat(learn, sizes)], minlength=len(words))
                part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
                order = np.argsort(part, kind="stable")
                part, n = part[order], n[order]
                sorted_words = [words[i] for i in order.tolist()]
                length = np.fromiter(map(len, sorted_words), np.int64, len(words))
                cuts = runs(part).tolist()
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                columns = [[packed(order[i:j]) for i, j in spans], [b"".join(sorted_words[i:j]) for i, j in spans], [packed(length[i:j]) for i, j in spans], [packed(n[i:j]) for i, j in spans]]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int32()), pa.array([batch] * len(spans), pa.int64()), *(pa.array(x, pa.binary()) for x in columns)], names=names_of(SENT))

    def meet(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in part_rows(found):
            length, n = chained(rows["lengths"]).astype(np.int64), chained(rows["n"])
            offsets, data = np.append(0, np.cumsum(length)), b"".join(rows["words"])
            words = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).dictionary_encode()
            ids, words = words.indices.to_numpy(), words.dictionary
            total = np.bincount(ids, weights=n, minlength=len(words)).astype(np.int64)
            kind = shapes(words)
            at, out = 0, []
            for places in rows["places"]:
                own = ids[at : at + len(narrow(places))]
                at += len(own)
                out.append((packed(own), packed(total[own]), kind[own].astype(np.uint8).tobytes()))
            back = [pa.array([part] * len(out), pa.int32()), pa.array(rows["batch"], pa.int64()), pa.array(rows["places"], pa.binary()), *(pa.array([x[i] for x in out], pa.binary()) for i in range(3))]
            yield pa.RecordBatch.from_arrays([*back, pa.nulls(len(out), pa.binary()), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int32())], names=names_of(MET))
            seen = np.flatnonzero(total)
            none = [pa.nulls(len(seen), t) for t in (pa.int64(), *[pa.binary()] * 4)]
            known = [words.cast(pa.binary()).take(pa.array(seen)), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64()), pa.array(kind[seen], pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), part), pa.int32()), *none, *known], names=names_of(MET))

    return dealt(batches.select("batch", "sizes", "learn", "words", "index").mapInArrow(send, SENT)).mapInArrow(meet, MET)


def returned(batches: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """batches, each after the rows of answers(part, batch, ...) that belong to it."""
    out = batches.withColumn("part", F.lit(None).cast("int"))
    for x in answers:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.repartition(partitions(batches.sparkSession), "batch").sortWithinPartitions("batch", F.asc_nulls_last("part"))


def with_answers(found: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[dict, dict[str, list]]]:
    """Each batch of what returned() returns, and the columns of its answers."""
    held: dict[str, list] = {c: [] for c in columns}
    for b in found:
        for row in b.to_pylist():
            if row["part"] is None:
                yield row, held
                held = {c: [] for c in columns}
            else:
                for c in columns:
                    held[c].append(row[c])


COUNTED = "batch long, ids binary, absent binary, learn binary, sizes binary, index binary, parts binary, words binary, n binary, shapes binary, top binary"


def counted(batches: DataFrame, answers: DataFrame, top: list[int]) -> DataFrame:
    """CODED and its answers -> COUNTED: the words, in another order, by their part and number there, how often each was learned from, its
    shape, and its place among top (words as part << 32 | number), from 1 on; 0: not among them."""
    order = np.argsort(np.array(top, np.int64))
    shared = batches.sparkSession.sparkContext.broadcast((np.array(top, np.int64)[order], order))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for row, own in with_answers(found, ["part", "places", "ids", "n", "shapes"]):
            part = np.repeat(np.array(own["part"], np.int64), [len(x) for x in own["shapes"]])
            word, place = chained(own["ids"]).astype(np.int64), chained(own["places"])
            order = np.lexsort((word, part))
            part, word = part[order], word[order]
            new = np.empty(len(order), np.int64)
            new[place[order]] = np.arange(len(order))
            top = np.zeros(len(order), np.int64)
            if len(known):
                code = part << 32 | word
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                top = np.where(known[at] == code, rank[at] + 1, 0)
            shape = np.frombuffer(b"".join(own["shapes"]), np.uint8)[order].tobytes()
            yield one_row(COUNTED, (*(row[c] for c in ("batch", "ids", "absent", "learn", "sizes")), packed(new[unpacked(row["index"])]), packed(part), packed(word), packed(chained(own["n"])[order]), shape, packed(top)))

    return returned(batches.drop("words"), [answers.where("batch is not null").select("part", "batch", "places", "ids", "n", "shapes")]).mapInArrow(run, COUNTED)


class Batch:
    """A row of COUNTED and the answers to it, (places, classes). learn: by document; doc: the document of each token."""

    def __init__(self, row: dict, answers: dict[str, list] | None = None):
        self.raw, self.answers = row, answers
        self.index, self.sizes, self.n, self.top, self.parts, self.words = (unpacked(row[c]) for c in ("index", "sizes", "n", "top", "parts", "words"))
        self.shapes = np.frombuffer(row["shapes"], np.uint8).astype(np.int64)
        self.learn = np.unpackbits(np.frombuffer(row["learn"], np.uint8), count=len(self.sizes)).astype(bool)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def classes(self, top: np.ndarray) -> np.ndarray:
        """The class of each word, by those of the top words and by answers; -1: none yet."""
        cls = np.append(-1, top)[self.top]
        cls[chained(self.answers["places"])] = chained(self.answers["classes"])
        return cls

    def flat(self, numbers: np.ndarray, end: int, learn: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Of each text (learn: of those learned from) the end, its words' numbers and the end, in one row; and where each begins."""
        sizes, tokens = self.sizes, numbers[self.index]
        if learn:
            tokens, sizes = tokens[self.learn[self.doc]], sizes[self.learn]
        out = np.full(len(tokens) + 2 * len(sizes), end, np.int64)
        out[np.arange(len(tokens)) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1] = tokens
        return out, np.append(0, np.cumsum(sizes + 2))


def followed(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All neighbours within a text."""
    inside = np.ones(max(0, len(flat) - 1), bool)
    inside[starts[1:-1] - 1] = False
    return flat[:-1][inside], flat[1:][inside]


def gathered(counts: DataFrame, size: int) -> np.ndarray:
    """counts(code, n) -> the sums as a square of side size."""
    got = counts.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[got.column("code").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


def pair_counts(batches: DataFrame, words: int) -> np.ndarray:
    """How often each symbol follows each; at most (words + shapes + 1) squared numbers reach the driver. words: top words."""
    size = words + 1 + SHAPES

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size**2, np.int64)
        for rows in found:
            for b in map(Batch, rows.to_pylist()):
                x, y = followed(*b.flat(np.where(b.top > 0, b.top - 1, words + 1 + b.shapes), words))
                total += np.bincount(x * size + y, minlength=size**2)
        at = np.flatnonzero(total)
        yield from record_batches({"code": (at, pa.int64()), "n": (total[at], pa.int64())})

    return gathered(batches.mapInArrow(run, "code long, n long"), size)


def inserted(counts: np.ndarray, shapes: np.ndarray, grid: np.ndarray, classes: int) -> np.ndarray:
    """The class, of the first `classes`, that each word joins to make the class bigrams grid likeliest, were it the only one to move.
    counts: a row for each word with how often each class follows it, how often it follows each, and how often itself. shapes: the
    class that it leaves."""
    total = len(grid)
    row, col, own = counts[:, :total], counts[:, total : 2 * total], counts[:, 2 * total :]
    left, right = grid.sum(axis=1)[:classes], grid.sum(axis=0)[:classes]
    out_n, in_n = row.sum(axis=1)[:, None] + own, col.sum(axis=1)[:, None] + own
    gain = xlogx(left) - xlogx(left + out_n) + xlogx(right) - xlogx(right + in_n)
    for side, other, cells in ((row, col, grid[:classes].T), (col, row, grid[:, :classes])):
        w, c = np.nonzero(side)
        if not len(w):
            continue
        before = cells[c]
        home = c == shapes[w]
        before[home] -= other[w[home], :classes]  # the word itself is still counted in the class that it leaves
        part = xlogx(before + side[w, c][:, None]) - xlogx(before)
        first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        gain[w[first]] += np.add.reduceat(part, first)
    same = grid[np.arange(classes), np.arange(classes)]
    r, c = row[:, :classes], col[:, :classes]
    gain += xlogx(same + r + c + own) - xlogx(same + r) - xlogx(same + c) + xlogx(same)
    return gain.argmax(axis=1)


AROUND = "part int, batch long, places binary, words binary, shapes binary, sizes binary, codes binary, times binary, code long, n long"
JOINED = "part int, batch long, places binary, classes binary, shape int, class int, n long, v long"


def joined(batches: DataFrame, answers: list[DataFrame], top: np.ndarray, low: int, high: int, classes: int) -> DataFrame:
    """COUNTED and its answers -> the answers (part, batch, places, classes) for words without a class whose count is from low to high:
    each joins the class that its neighbours' classes make likeliest; and, where batch is null, (shape, class, n, v), the tokens and
    kinds of these words. A task counts 256 words at a time."""
    spark = batches.sparkSession
    total = classes + 1 + SHAPES
    width = 2 * total + 1
    shared = spark.sparkContext.broadcast(top)
    names = names_of(AROUND)

    def around(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros(total**2, np.int64)
        for b in (Batch(*x) for x in with_answers(found, ["places", "classes"])):
            cls = b.classes(shared.value)
            new = (cls < 0) & (b.n >= low) & (b.n <= high)
            cls = np.where(cls < 0, classes + 1 + b.shapes, cls)
            # Numbers from total on are new words, whose class is still that of their shape.
            x, y = followed(*b.flat(np.where(new, total + np.arange(len(new)), cls), classes))
            class_of = np.append(np.arange(total), cls)
            cx, cy = class_of[x], class_of[y]
            grid += np.bincount(cx * total + cy, minlength=total**2)
            new_x, new_y = x >= total, y >= total
            itself = new_x & (x == y)
            held = [(x[new_x] - total) * width + np.where(itself, 2 * total, cy)[new_x]]
            new_y &= ~itself
            held.append((y[new_y] - total) * width + total + cx[new_y])
            code, times = np.unique(np.concatenate(held), return_counts=True)
            word = code // width
            code -= word * width
            own = np.flatnonzero(new)  # also those that stand only in texts that are not learned from
            if not len(own):
                continue
            size = np.bincount(word, minlength=len(new))[own]
            ends = np.append(0, np.cumsum(size))
            cuts = runs(b.parts[own])
            out = [[], [], [], [], [], []]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                here, k = own[i:j], slice(ends[i], ends[j])
                for column, v in zip(out, (packed(here), packed(b.words[here]), b.shapes[here].astype(np.uint8).tobytes(), packed(size[i:j]), packed(code[k]), packed(times[k])), strict=True):
                    column.append(v)
            count = len(cuts) - 1
            yield pa.RecordBatch.from_arrays([pa.array(b.parts[own[cuts[:-1]]], pa.int32()), pa.array([b.raw["batch"]] * count, pa.int64()), *(pa.array(x, pa.binary()) for x in out), pa.nulls(count, pa.int64()), pa.nulls(count, pa.int64())], names=names)
        at = np.flatnonzero(grid)
        none = [pa.nulls(len(at), t) for t in (pa.int32(), pa.int64(), *[pa.binary()] * 6)]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at, pa.int64()), pa.array(grid[at], pa.int64())], names=names)

    met = staged(returned(batches, answers).mapInArrow(around, AROUND), "word-classes")
    grid = gathered(met.where("part is null").select("code", "n"), total)

    def join(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in part_rows(found):
            kinds, row = np.unique(chained(rows["words"]), return_inverse=True)
            size, codes, times = (chained(rows[c]) for c in ("sizes", "codes", "times"))
            size = size.astype(np.int64)
            start = np.cumsum(size) - size
            leaves, cls, n = np.empty(len(kinds), np.int64), np.empty(len(kinds), np.int64), np.empty(len(kinds), np.int64)
            leaves[row] = np.frombuffer(b"".join(rows["shapes"]), np.uint8)
            order = np.argsort(row, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(kinds))))
            for at in range(0, len(kinds), 256):
                end = min(at + 256, len(kinds))
                counts = np.zeros((end - at) * width)
                for k in range(ends[at], ends[end], 2048):
                    some = order[k : min(k + 2048, ends[end])]
                    m = size[some]
                    entry = np.arange(m.sum()) + np.repeat(start[some] - (np.cumsum(m) - m), m)
                    counts += np.bincount(np.repeat(row[some] - at, m) * width + codes[entry], weights=times[entry], minlength=len(counts))
                counts = counts.reshape(-1, width)
                cls[at:end] = inserted(counts, classes + 1 + leaves[at:end], grid, classes)
                n[at:end] = counts[:, total:].sum(axis=1)
            out, at = [], 0
            for x in rows["shapes"]:
                out.append(packed(cls[row[at : at + len(x)]]))
                at += len(x)
            none = [pa.nulls(len(out), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int32()), pa.array(rows["batch"], pa.int64()), pa.array(rows["places"], pa.binary()), pa.array(out, pa.binary()), *none], names=names_of(JOINED))
            code, at = np.unique(leaves * classes + cls, return_inverse=True)
            sums = (code // classes, code % classes, np.bincount(at, weights=n), np.bincount(at))
            none = [pa.nulls(len(code), t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, *(pa.array(x.astype(np.int64)).cast(t) for x, t in zip(sums, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True))], names=names_of(JOINED))

    found = staged(dealt(met.where("part is not null").drop("code", "n")).mapInArrow(join, JOINED), "joined-words")
    dropped(met)
    release(spark)
    return found


def windows(counts: list[tuple[int, int]], have: int, growth: int) -> list[tuple[int, int]]:
    """counts: (count, how many words), falling. Ranges of counts (least, greatest), each with about growth times the words before."""
    out, size, top = [], 0, None
    for n, words in counts:
        top = n if top is None else top
        size += words
        if size >= growth * have:
            out.append((n, top))
            have, size, top = have + size, 0, None
    return out + ([(counts[-1][0], top)] if size else [])


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, words: int, classes: int, sweeps: int) -> np.ndarray:
    """Classes of symbols. The first `words` symbols move, one at a time, to the class that makes the class bigrams likeliest, until
    a sweep moves none; all other symbols keep a class of their own, from `classes` on."""
    n = len(pairs)
    total = classes + n - words
    cls = np.concatenate((np.arange(words) % classes, classes + np.arange(n - words)))
    one = np.zeros((n, total))
    one[np.arange(n), cls] = 1
    after, before = pairs @ one, (one.T @ pairs).T  # symbol x class: what follows it, what it follows
    grid = one.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a = cls[w]
            self_count = pairs[w, w]
            row, col = after[w].copy(), before[w].copy()
            row[a] -= self_count
            col[a] -= self_count
            grid[a] -= row
            grid[:, a] -= col
            grid[a, a] -= self_count
            out_w, in_w = row.sum() + self_count, col.sum() + self_count
            # Wherever w goes, what precedes it counts for the classes before, and what follows for those after.
            left, right = grid.sum(axis=1)[:classes] + col[:classes], grid.sum(axis=0)[:classes] + row[:classes]
            rows, cols = grid[:classes], grid[:, :classes].T
            gain = (xlogx(rows + row) - xlogx(rows)).sum(axis=1) + (xlogx(cols + col) - xlogx(cols)).sum(axis=1)
            d = np.arange(classes)
            own = grid[d, d]
            gain += xlogx(own + row[:classes] + col[:classes] + self_count) - xlogx(own)
            gain -= xlogx(own + row[:classes]) - xlogx(own) + xlogx(own + col[:classes]) - xlogx(own)
            gain -= xlogx(left + out_w) - xlogx(left) + xlogx(right + in_w) - xlogx(right)
            b = int(gain.argmax())
            b = b if gain[b] > gain[a] + 1e-9 else a
            grid[b] += row
            grid[:, b] += col
            grid[b, b] += self_count
            if b != a:
                moved += 1
                cls[w] = b
                for side, counts in ((after, pairs[:, w]), (before, pairs[w])):
                    side[:, a] -= counts
                    side[:, b] += counts
        if not moved:
            break
    return cls


WALKED = "ids binary, absent binary, learn binary, sizes binary, classes binary, logs binary, known binary"


def walked(batches: DataFrame, answers: list[DataFrame], top: np.ndarray, classes: int, smooth: float) -> DataFrame:
    """COUNTED and its answers -> a row each: its documents' classes (of end, words and end, a byte each), and of each document the sum of
    its words' log10(count + smooth) and its known words."""
    shared = batches.sparkSession.sparkContext.broadcast(top)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (Batch(*x) for x in with_answers(found, ["places", "classes"])):
            n, cls = b.n, b.classes(shared.value)
            cls = np.where(cls < 0, classes + 1 + b.shapes, cls)
            flat, _ = b.flat(cls, classes, learn=False)
            size = len(b.sizes)
            logs = np.bincount(b.doc, weights=np.log10(n + smooth)[b.index], minlength=size)
            has = np.bincount(b.doc, weights=(n > 0)[b.index], minlength=size).astype(np.int64)
            yield one_row(WALKED, (*(b.raw[c] for c in ("ids", "absent", "learn", "sizes")), flat.astype(np.uint8).tobytes(), logs.tobytes(), packed(has)))

    return returned(batches, answers).mapInArrow(run, WALKED)


def class_pairs(rows: DataFrame, size: int) -> np.ndarray:
    """How often each class follows each in the documents of WALKED that are learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size**2, np.int64)
        for b in batches:
            for learn, sizes, classes in zip(*(b.column(c).to_pylist() for c in ("learn", "sizes", "classes")), strict=True):
                sizes = unpacked(sizes) + 2
                learn = np.unpackbits(np.frombuffer(learn, np.uint8), count=len(sizes)).astype(bool)
                c = np.frombuffer(classes, np.uint8)[np.repeat(learn, sizes)].astype(np.int64)
                x, y = followed(c, np.append(0, np.cumsum(sizes[learn])))
                total += np.bincount(x * size + y, minlength=size**2)
        at = np.flatnonzero(total)
        yield from record_batches({"code": (at, pa.int64()), "n": (total[at], pa.int64())})

    return gathered(rows.select("learn", "sizes", "classes").mapInArrow(run, "code long, n long"), size)


def score(docs: DataFrame, learn: Column, rules: Rules = Rules()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score; learns from rows where learn holds.

    base_score is the smoothed unigram sum of the contract. Null and empty texts are an end alone; null ids pass through; repeated
    rows, and rows that share an id, are each scored by their own text (and each count where they are learned from). Of words of
    equal counts the greater bytes come first. A very long text is a batch of its own. If nothing is learned from, all words are
    unknown; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    batch_limits(spark)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    smooth = rules.smooth
    texts = staged(coded(marked, rules.batch), "coded-texts", FILE)
    sent = texts.agg(F.sum("kinds")).first()[0] or 0
    parts = max(partitions(spark), -(-sent // rules.hot))
    met = staged(met_words(texts, parts), "met-words")
    release(spark)
    vocabulary = met.where("batch is null")
    by_count = vocabulary.groupBy("shape", "count").agg(F.count(F.lit(1)).alias("v")).collect()
    top = vocabulary.orderBy(F.desc("count"), F.desc("word")).limit(rules.frequent).select("part", "id", "count", "shape").collect()
    coded_rows, texts = texts, staged(counted(texts, met, [r.part << 32 | r.id for r in top]), "counted-texts", FILE)
    dropped(coded_rows)
    dropped(met)
    release(spark)
    words = len(top)
    pairs = pair_counts(texts, words)
    classes = min(rules.classes, max(1, words))
    cls = exchange(pairs, words, classes, rules.sweeps)[:words]
    ends = int(pairs[words].sum())
    moves = [(r["shape"], c, r["count"], 1) for r, c in zip(top, cls.tolist(), strict=True)]
    rest = Counter()
    for r in by_count:
        rest[r["count"]] += r.v
    rest.subtract(r["count"] for r in top)
    found: list[DataFrame] = []

    def answers() -> list[DataFrame]:
        return [x.where("batch is not null").select("part", "batch", "places", "classes") for x in found] or [spark.createDataFrame([], "part int, batch long, places binary, classes binary")]

    for low, high in windows(sorted(((n, v) for n, v in rest.items() if n >= rules.floor and v), reverse=True), words, rules.growth):
        found.append(joined(texts, answers(), cls, low, high, classes))
        moves += [tuple(r) for r in found[-1].where("batch is null").groupBy("shape", "class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()]

    total = classes + 1 + SHAPES
    rows = staged(walked(texts, answers(), cls, classes, smooth), "class-rows", FILE)
    dropped(texts)
    grid = class_pairs(rows, total)
    uni = (grid.sum(axis=0) + smooth) / (grid.sum() + smooth * total)
    step = np.log10((grid + smooth * total * uni) / (grid.sum(axis=1, keepdims=True) + smooth * total))
    # Tokens and kinds of each class; words of the vocabulary leave their shape's class.
    tokens, kinds = np.zeros(total), np.zeros(total)
    for r in by_count:
        tokens[classes + 1 + r["shape"]] += r["count"] * r.v
        kinds[classes + 1 + r["shape"]] += r.v
    for s, c, n, v in moves:
        tokens[c] += n
        kinds[c] += v
        tokens[classes + 1 + s] -= n
        kinds[classes + 1 + s] -= v
    within = np.log10(tokens + smooth * (kinds + 1))
    within[classes] = 0.0  # the end is alone in its class
    within[:classes] = np.log10(np.maximum(tokens[:classes] + smooth * kinds[:classes], smooth))  # no unknown word is there
    step -= within[None, :]
    n_all = int(sum(r["count"] * r.v for r in by_count) + ends)
    v_all = int(sum(r.v for r in by_count) + (ends > 0))
    base, end_log, end_known = math.log10(n_all + 0.5 * (v_all + 1)), math.log10(ends + 0.5), int(ends > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = unpacked(r["sizes"])
                if not len(sizes):
                    continue
                c = np.frombuffer(r["classes"], np.uint8).astype(np.int64)
                starts = np.cumsum(sizes + 2) - (sizes + 2)
                gain = np.append(step[c[:-1], c[1:]], 0.0)
                gain[starts[1:] - 1] = 0.0  # from one document's end to the next's
                walk = np.add.reduceat(gain, starts)
                logs = np.frombuffer(r["logs"], np.float64) + end_log
                absent = np.unpackbits(np.frombuffer(r["absent"], np.uint8), count=len(sizes)).astype(bool)
                columns = {"doc_id": pa.array(np.frombuffer(r["ids"], np.int64), mask=absent), "n_tokens": pa.array(sizes + 1), "n_known": pa.array(unpacked(r["known"]) + end_known)}
                columns |= {"train_tokens": pa.array(np.full(len(sizes), n_all)), "base_score": pa.array(logs - (sizes + 1) * base), "score": pa.array(logs + walk)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
