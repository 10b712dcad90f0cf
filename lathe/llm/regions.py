"""Where passages repeat: finds every symbol covered by a window of fixed length that also starts earlier.

Symbols are words or bytes. Windows are dealt out by an anchor, the smallest hash of the k-grams inside (a function of the
window's own symbols), so equal windows always meet. Windows in a row with one anchor form a region. Regions whose anchor occurs
again are cut out of the texts and go, with their symbols, to indexes (FM-indexes or suffix arrays). Hashes only choose where
symbols are compared: equal pieces are collapsed after comparing them symbol by symbol, all else the index decides.

An anchor is shuffled as 32 bytes, once for each task that holds it; the pieces in question are shuffled with their symbols, equal
ones once for each task; and the texts are joined twice by row. Each phase ends in a table in the shared folder.

A row is known by its doc_id and the 64-bit hash of its text, so rows that share a doc_id (or have none) stay apart, and equal rows
have one result. A window is earlier if its doc_id is smaller (a null is the smallest), or the doc_id is the same and it starts
earlier; of rows that share a doc_id, at one start the smaller hash comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathe.llm.common import NULL_ID, batch_limits, dropped, mix, partitions, record_batches, release, split_words, staged, texts

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
PLACE = 24
#: Bits of an anchor's row for how far before it its region's first window begins, and the last one.
BEFORE = 10
#: Windows starts handled at once; also where very long texts are divided (with an overlap).
CHUNK = 1 << 22
#: Anchors combined inside a task before the shuffle.
COMBINE = 1 << 20

#: decide(pieces, starts, order): which of each piece's first starts[i] windows equal an earlier one; order has each piece's
#: (document, first start, row), and the start goes up with each window.
Decide = Callable[[list[bytes], list[int], list[tuple[int, int, int]]], list[np.ndarray]]


@dataclass(frozen=True)
class Windows:
    """words: whether symbols are words, else bytes. size: symbols of a window. gram: of an anchor."""

    words: bool
    size: int
    gram: int

    def __post_init__(self):
        if not self.gram <= self.size < self.gram + 2**BEFORE:
            raise ValueError(f"windows of {self.size} symbols with anchors of {self.gram}")

    def split(self, text: bytes):
        return text.split() if self.words else text

    def join(self, symbols) -> bytes:
        return b" ".join(symbols) if self.words else symbols


class Hashes:
    """Polynomial hashes of a flat array of symbols."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(Hashes.powers) <= n:
            for name, b in (("powers", BASE), ("inverse", INVERSE)):
                p = np.full(n + 1, b, np.uint64)
                p[0] = 1
                setattr(Hashes, name, np.multiply.accumulate(p))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.powers[:n], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        h = self.sums[k:] - self.sums[:-k]
        h *= self.inverse[: len(h)]
        return quick_mix(h)


def quick_mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def regions(values: np.ndarray, bounds: np.ndarray, rules: Windows) -> tuple[np.ndarray, ...]:
    """values: symbols' hashes, texts end to end; bounds: where each text begins, and the end. Returns for each region its
    anchor's hash, the text's number, first and last window start, and anchor, these three within the text."""
    n, size, k = len(values), rules.size, rules.gram
    if n < size:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 4
    hashes = Hashes(values)
    gram = hashes.grams(k)
    low = np.uint64((1 << PLACE) - 1)
    least = (gram & ~low) | (low - np.arange(len(gram), dtype=np.uint64))  # ties: the rightmost
    span, w = 1, size - k + 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: n - size + 1], least[w - span : w - span + n - size + 1])
    anchor = (low - (least & low)).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int8)
    first, last = bounds[:-1], bounds[1:] - size + 1
    some = last > first
    valid[first[some]] += 1
    np.subtract.at(valid, last[some], 1)
    valid = np.cumsum(valid[:-1]) > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    fresh = np.zeros(len(new), bool)
    fresh[first[some]] = True
    new |= fresh & valid
    lo = np.flatnonzero(new)
    stop = np.append(lo[1:], len(valid))
    ends = np.append(np.flatnonzero(valid[:-1] & ~valid[1:]) + 1, len(valid) if valid[-1] else [])
    hi = np.minimum(stop, ends[np.searchsorted(ends, lo, side="right")] if len(lo) else stop) - 1
    p = anchor[lo]
    text = np.searchsorted(bounds, lo, side="right") - 1
    start = bounds[text]
    return gram[p], text, lo - start, hi - start, p - start


def merged(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans [a, b) of each doc, united where they touch."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    group = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    wide = int(b.max()) + 1  # ends rise within a doc and from doc to doc
    far = np.maximum.accumulate(b + group * wide) - group * wide
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (a[1:] > far[:-1])))
    at = np.flatnonzero(new)
    return doc[at], a[at], far[np.append(at[1:], len(doc)) - 1]


ANCHORS = "deal long, h long, n long, doc long, row long, place long"


def find_anchors(docs: DataFrame, rules: Windows) -> DataFrame:
    """docs(doc, row, text) -> ANCHORS. Of each anchor hash one row of a task is dealt by it, with how often the task has it; the
    others, n = 0, are known to recur and are dealt evenly."""
    signs = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        ids: list[tuple[int, int]] = []
        flats: list[np.ndarray] = []
        pieces: list[int] = []

        def flush() -> None:
            if flats:
                h, text, lo, hi, p = regions(np.concatenate(flats), np.concatenate(([0], np.cumsum([len(x) for x in flats]))), rules)
                at = np.array(pieces, np.int64)[text]
                doc, row = np.array(ids, np.int64).T
                parts.append((h, doc[text], row[text], (p + at << 2 * BEFORE) | (p - lo << BEFORE) | (p - hi)))
                ids.clear(), flats.clear(), pieces.clear()

        def combined() -> Iterator[pa.RecordBatch]:
            if not parts:
                return
            h, doc, row, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.argsort(h, kind="stable")
            h, doc, row, place = h[order].view(np.int64), doc[order], row[order], place[order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            n = np.zeros(len(h), np.int64)
            n[at] = np.diff(np.append(at, len(h)))
            deal = np.where(n > 0, h, mix((row ^ place).view(np.uint64)).view(np.int64))
            yield from record_batches({k: (v, pa.int64()) for k, v in zip("deal h n doc row place".split(), (deal, h, n, doc, row, place), strict=True)})

        held = 0
        for batch in batches:
            if rules.words:
                words, index, offsets = split_words(batch.column("text"))
                own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[index]
                symbols = [own[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            else:
                symbols = [signs[np.frombuffer(t, np.uint8)] for t in texts(batch.column("text"))]
            for doc, row, values in zip(batch.column("doc").to_pylist(), batch.column("row").to_pylist(), symbols, strict=True):
                for at in range(0, max(1, len(values) - rules.size + 1), CHUNK):
                    part = values[at : at + CHUNK + rules.size - 1]
                    if len(part) >= rules.size:
                        if held + len(part) > CHUNK + rules.size:
                            flush()
                            held = 0
                        ids.append((doc, row)), flats.append(part), pieces.append(at)
                        held += len(part)
            if sum(len(x[0]) for x in parts) > COMBINE:
                yield from combined()
        flush()
        yield from combined()

    return docs.select("doc", "row", "text").mapInArrow(run, ANCHORS)


def ranks(order: list[tuple[int, int, int]], starts: list[int]) -> np.ndarray:
    """The place of each window of each piece in the order of (document, start, row)."""
    doc, first, row = (np.repeat(np.array(x, np.int64), starts) for x in zip(*order, strict=True))
    begin = np.repeat(np.cumsum(starts) - starts, starts)
    first += np.arange(len(first)) - begin
    out = np.empty(len(first), np.int64)
    out[np.lexsort((row, first, doc))] = np.arange(len(first))
    return out


PIECES = "key long, doc long, row long, lo long, n long, symbols binary"
#: Symbols' bytes gathered for one index; the most different pieces of one key; bytes of pieces compared in a task before the shuffle.
SHARD = 1 << 19
GROUP = 4096
HELD = 1 << 25


class Pieces:
    """Rows of PIECES in the making: equal ones met in a task become spans, all but the earliest. Spans have a null key, and n is
    their end."""

    def __init__(self, size: int):
        self.size, self.first, self.weight = size, {}, 0
        self.spans: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def add(self, symbols: bytes, doc: int, lo: int, row: int, n: int, p: int = 0) -> None:
        new, old = (doc, lo, row, n, p), self.first.get(symbols)
        if old is None:
            self.first[symbols] = new
            self.weight += len(symbols) + 200
        elif old != new:
            if new < old:
                self.first[symbols], new = new, old
            self.spans.setdefault((new[0], new[2]), []).append((new[1], new[1] + new[3] - 1 + self.size))
            self.weight += 100

    def full(self) -> bool:
        return self.weight > HELD

    def out(self, cut: Callable[[bytes, tuple], list[tuple]]) -> Iterator[pa.RecordBatch]:
        """All rows; cut makes those of a piece from its symbols and (doc, lo, row, n, p)."""
        rows = [(None, doc, row, a, b, None) for (doc, row), found in self.spans.items() for a, b in united(found)]
        items = list(self.first.items())
        self.spans, self.first, self.weight = {}, {}, 0
        for at in range(0, len(items), 10_000):
            for symbols, x in items[at : at + 10_000]:
                rows += cut(symbols, x)
            yield piece_batch(rows)
            rows = []
        if rows:
            yield piece_batch(rows)


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], names=[x.split()[0] for x in PIECES.split(", ")])


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, united where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def digest(symbols: bytes) -> int:
    return xxhash.xxh3_64_intdigest(symbols) - 2**63


def cut_pieces(asked: DataFrame, rules: Windows) -> DataFrame:
    """Rows (doc, row, text, places) -> PIECES. A region is divided at the windows that begin half a window before the anchor: all
    windows of a half share half a window next to the anchor, which is the key."""
    size, half, k = rules.size, rules.size // 2, rules.gram

    def cut(symbols: bytes, x: tuple) -> list[tuple]:
        doc, lo, row, n, p = x
        s = rules.split(symbols)
        middle, last, out = p - half, n - 1, []  # places within the region
        if last >= middle:
            a = max(0, middle)
            piece = rules.join(s[a:])
            out.append((digest(rules.join(s[p : p + half])), doc, row, lo + a, n - a, piece))
        if middle > 0:
            e = min(last, middle - 1)
            piece = rules.join(s[: e + size])
            out.append((~digest(rules.join(s[middle - 1 : p + k])), doc, row, lo, e + 1, piece))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, mask = Pieces(size), 2**BEFORE - 1
        for b in batches:
            for doc, row, text, places in zip(b.column("doc").to_pylist(), b.column("row").to_pylist(), texts(b.column("text")), b.column("places").to_pylist(), strict=True):
                s = rules.split(text)
                for x in places:
                    p = x >> 2 * BEFORE
                    lo, hi = p - (x >> BEFORE & mask), p - (x & mask)
                    pieces.add(rules.join(s[lo : hi + size]), doc, lo, row, hi - lo + 1, p - lo)
                if pieces.full():
                    yield from pieces.out(cut)
        yield from pieces.out(cut)

    return asked.select("doc", "row", "text", "places").mapInArrow(run, PIECES)


def single_windows(pieces: DataFrame, rules: Windows) -> DataFrame:
    """PIECES -> each of their windows as a piece, keyed by all its symbols."""
    size = rules.size

    def cut(symbols: bytes, x: tuple) -> list[tuple]:
        return [(digest(symbols), x[0], x[2], x[1], 1, symbols)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Pieces(size)
        for b in batches:
            for doc, row, lo, n, symbols in zip(*(b.column(c).to_pylist() for c in ("doc", "row", "lo", "n", "symbols")), strict=True):
                s = rules.split(symbols)
                for i in range(n):
                    found.add(rules.join(s[i : i + size]), doc, lo + i, row, 1)
                if found.full():
                    yield from found.out(cut)
        yield from found.out(cut)

    return pieces.mapInArrow(run, PIECES)


SPANS = "doc long, row long, a long, b long"


def decided(batches: Iterator[pa.RecordBatch], rules: Windows, decide: Decide) -> Iterator[pa.RecordBatch]:
    """Takes PIECES sorted by key, doc, lo, row. Yields SPANS. Of a key, equal pieces are collapsed to the first; the different ones,
    where there are several, go to an index together with those of other keys."""
    size = rules.size
    spans: list[tuple] = []
    shard: list[tuple] = []
    group: dict[bytes, tuple] = {}
    held, key = 0, None

    def index() -> None:
        for part, hit in zip(shard, decide([x[4] for x in shard], [x[3] for x in shard], [x[:3] for x in shard]), strict=True):
            at = np.flatnonzero(hit)
            if len(at):
                _, a, b = merged(np.zeros(len(at), np.int64), at, at + size)
                spans.extend((part[0], part[2], part[1] + int(x), part[1] + int(y)) for x, y in zip(a, b, strict=True))
        shard.clear()

    def out() -> pa.RecordBatch:
        cols = list(zip(*spans, strict=True))
        spans.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "row", "a", "b"])

    for b in batches:
        for k, doc, row, lo, n, symbols in zip(*(b.column(c).to_pylist() for c in ("key", "doc", "row", "lo", "n", "symbols")), strict=True):
            if k != key:
                if len(group) > 1:
                    shard.extend((*x, s) for s, x in group.items())
                    held += sum(map(len, group))
                    if held >= SHARD:
                        index()
                        held = 0
                key, group = k, {}
            first = group.setdefault(symbols, (doc, lo, row, n))
            if first != (doc, lo, row, n):
                spans.append((doc, row, lo, lo + n - 1 + size))
            if len(spans) >= 50_000:
                yield out()
    if len(group) > 1:
        shard.extend((*x, s) for s, x in group.items())
    if shard:
        index()
    if spans:
        yield out()


def with_rows(docs: DataFrame) -> DataFrame:
    """docs with doc and row, by which repeated() knows rows."""
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "row": F.xxhash64("text")})


def repeated(docs: DataFrame, rules: Windows, decide: Decide) -> DataFrame:
    """docs(doc_id, text) -> (doc, row, spans: [(a, b)], not united) for each row with a repeat."""
    spark = docs.sparkSession
    batch_limits(spark)
    n = partitions(spark)
    keyed = with_rows(docs.select("doc_id", "text")).select("doc", "row", "text")
    found = find_anchors(keyed, rules).repartition(n, "deal")
    often = F.sum(F.greatest("n", F.when(F.col("n") == 0, 2).otherwise(0))).over(Window.partitionBy("deal"))
    found = staged(found.withColumn("often", often).where("often > 1").select("doc", "row", "place"), "anchors")
    release(spark)
    # A row's places are no more than its text has, however often the row itself repeats.
    asked = found.groupBy("doc", "row").agg(F.collect_set("place").alias("places"))
    pieces = staged(cut_pieces(keyed.join(asked, ["doc", "row"]), rules), "pieces")
    dropped(found)
    release(spark)
    # Keys with more different pieces than one index holds: their windows are dealt by all their symbols instead.
    dealt = pieces.where("key is not null")
    spans_of = lambda x: x.where("key is null").select("doc", "row", F.col("lo").alias("a"), F.col("n").alias("b"))
    spans = spans_of(pieces)
    hot = staged(dealt.groupBy("key").count().where(F.col("count") > GROUP).select("key"), "frequent-keys")
    if not hot.isEmpty():
        several = dealt.join(hot, "key").select("key", F.xxhash64("symbols").alias("r")).distinct()
        hot = staged(several.groupBy("key").count().where(F.col("count") > GROUP).select("key"), "hot-keys")
    if not hot.isEmpty():
        wide = staged(single_windows(dealt.join(hot, "key"), rules), "windows")
        spans = spans.unionByName(spans_of(wide))
        dealt = dealt.join(hot, "key", "left_anti").unionByName(wide.where("key is not null"))
    dealt = dealt.repartition(n, "key").sortWithinPartitions("key", "doc", "lo", "row")
    more = staged(dealt.mapInArrow(lambda b: decided(b, rules, decide), SPANS), "decided")
    release(spark)
    return spans.unionByName(more).groupBy("doc", "row").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def unite(spans: list[dict] | None, limit: int) -> list[tuple[int, int]]:
    """Spans in order, united where they touch and cut off at limit."""
    return united([(x["a"], min(x["b"], limit)) for x in spans or () if x["a"] < limit])
