"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines); each paragraph is hashed to a wide vector of signs, and a fingerprint is their sum
modulo a power of two, lane by lane. Order does not count, and paragraphs are added or taken away by adding or subtracting their
vectors: insert_delete() does so to a table of fingerprints without the texts. Long paragraphs add the vectors of their parts, so
that an edit inside one is a small change. As lanes hold signs, the mean square of the lanes of a difference estimates how many
units it consists of, which gives the likeness of two fingerprints.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import batch_limits, partitions, texts

#: Lanes of a vector, and the type that sums are kept in: sums are modulo 2**32, more than one text can repeat a paragraph.
LANES = 128
LANE = np.uint32
#: Long paragraphs are divided after a word whose hash says so, at about every so many words: a place that depends on the words
#: alone, so that an edit changes the parts it touches and no others.
PART_WORDS = 8


def paragraphs(text: bytes) -> list[bytes]:
    """The paragraphs of text: its lines, without their ends; empty ones do not count."""
    return [x for x in text.splitlines() if x]


def units(paragraph: bytes) -> list[bytes]:
    """What a paragraph adds vectors of: itself and, if it is long, its parts."""
    words = paragraph.split(b" ")
    if len(words) <= PART_WORDS:
        return [paragraph]
    out, start = [b"\n" + paragraph], 0  # a line end tells a whole paragraph from a part
    for i, w in enumerate(words):
        # The sum of a word's end bytes is hash enough to choose a place.
        if (w[-1] * 31 + len(w) * 17 + w[0] * 7 if w else 0) % PART_WORDS == 0:
            out.append(b" ".join(words[start : i + 1]))
            start = i + 1
    if start < len(words):
        out.append(b" ".join(words[start:]))
    return out


class Fingerprint:
    """The sum of paragraphs' vectors. Supports + and -, so parts can be inserted and deleted."""

    __slots__ = ("lanes",)

    def __init__(self, lanes: np.ndarray | None = None):
        self.lanes = np.zeros(LANES, LANE) if lanes is None else lanes

    @classmethod
    def of(cls, parts: Iterable[bytes]) -> Fingerprint:
        raw = [xxhash.xxh3_128_digest(u) for p in parts for u in units(p)]
        if not raw:
            return cls()
        bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, LANES // 8), axis=1)
        ones = bits.sum(axis=0, dtype=np.int64)
        return cls((2 * ones - len(raw)).astype(LANE))  # a set bit counts 1, another -1

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes - other.lanes)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.lanes == other.lanes).all())

    __hash__ = None

    def size(self) -> float:
        """Mean square of the lanes: an estimate of the sum of squared counts of the units."""
        x = self.lanes.view(np.int32).astype(np.float64)
        return float(x @ x) / LANES

    def hex(self) -> str:
        return self.lanes.astype(">u4").tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> Fingerprint:
        return cls(np.frombuffer(bytes.fromhex(text), ">u4").astype(LANE))

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, about 0 for multisets that share nothing: the shared part of both sizes."""
        both = self.size() + other.size()
        return 1.0 if not both else min(1.0, max(0.0, 1 - (self - other).size() / both))


def edited(text: str, after: str) -> str:
    """text with its last third replaced by as much of the beginning of after."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> rows ready for consecutive reading: bucket, ghost, doc_id, text, a bucket to a task, sorted by descending
    doc_id and text hash.

    Buckets are ranges of (doc_id, hash of the text), cut at quantiles of doc_id; a doc_id that several quantiles fall on is cut by
    the hash. Each bucket also gets, as a ghost, the row that follows its last one, so that no row needs another bucket; the ghosts
    are found from the ids and hashes alone. Texts are shuffled once.
    """
    n = partitions(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("h"))
    found = keyed.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20_000)).first()[0] or [] if n > 1 else []
    # A cut (c, t): rows with an id below c, or c and a hash of t or more, are behind it.
    cuts = [(c, -(2**63) + k * (2**64 // m)) for c, m in sorted(Counter(found).items(), reverse=True) for k in range(m)]

    def search(first: int, last: int):
        """The number of cuts before a row, by halves."""
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        c, t = (F.lit(x).cast("long") for x in cuts[middle])
        return F.when((F.col("id") < c) | ((F.col("id") == c) & (F.col("h") >= t)), search(middle + 1, last)).otherwise(search(first, middle))

    bucket = search(0, len(cuts))
    # The first row of each bucket in order: one row per bucket, at most n.
    heads = keyed.select(bucket.alias("bucket"), F.struct(F.bitwise_not("id").alias("down"), "h").alias("at")).groupBy("bucket").agg(F.min("at").alias("at")).orderBy("bucket").collect()
    # A bucket's last row is followed by the first row of the next bucket that has any; after the last bucket comes the first.
    first = {h.bucket: (~h["at"]["down"], h["at"]["h"], heads[i - 1].bucket) for i, h in enumerate(heads)}
    known = [first.get(i, (None, None, None)) for i in range(len(cuts) + 1)]
    head = lambda k, kind: F.element_at(F.array(*[F.lit(x[k]).cast(kind) for x in known]), F.col("bucket") + 1)
    ghost = F.when((F.col("id") == head(0, "long")) & (F.col("h") == head(1, "long")), head(2, "int"))
    both = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost")), F.struct(ghost.alias("bucket"), F.lit(True).alias("ghost")))
    placed = keyed.withColumn("bucket", bucket).withColumn("at", F.explode(F.filter(both, lambda x: x["bucket"].isNotNull())))
    placed = placed.select("at.bucket", "at.ghost", "id", "h", "doc_id", "text")
    return placed.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.desc("id"), "h", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller doc_id; after the last comes the first. Null and empty texts are empty; a null
    id is the smallest; rows that share a doc_id are in order of their texts' hashes, then of the texts. A single document is its own
    next; an empty table gives no rows; other columns are not read. Fingerprints are 32-bit lanes in hex.
    """
    batch_limits(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # bucket, doc_id, text, fingerprint of the row that waits for its next
        ghosted = None
        for b in batches:
            out = []
            for bucket, ghost, doc, raw in zip(b.column("bucket").to_pylist(), b.column("ghost").to_pylist(), b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True):
                if ghost and ghosted == bucket:
                    continue  # rows that share the ghost's doc_id: only the first follows
                text = raw.decode("utf-8", "replace")
                own = Fingerprint.of(paragraphs(raw))
                if before and before[0] == bucket:
                    _, d, t, f = before
                    e = edited(t, text)
                    data = e.encode()
                    g = Fingerprint.of(paragraphs(data))
                    out.append((d, len(t), hashlib.sha256(data).hexdigest(), f.hex(), g.hex(), f.likeness(g), f.likeness(own)))
                ghosted = bucket if ghost else None
                before = None if ghost else (bucket, doc, text, own)
            cols = zip(*out, strict=True) if out else [[] for _ in names]
            kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return with_next(docs).select("bucket", "ghost", "doc_id", "text").mapInArrow(run, schema)


def insert_delete(prints: DataFrame, changes: DataFrame) -> DataFrame:
    """prints(doc_id, fingerprint) after changes(doc_id, paragraph, times): times copies of the paragraph added, or taken off if it is
    negative. Nothing of the texts is read. doc_id must be unique in prints; documents that only changes names start empty. Null or empty
    paragraphs and null times change nothing; line ends inside a paragraph divide it. Changes are summed in each task, then by document."""
    spark = prints.sparkSession
    batch_limits(spark)
    schema = "doc_id long, lanes binary"

    def merged(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, lanes) in order of doc_id: one for each."""
        now, total, out = None, None, []
        for doc, lanes in rows:
            if total is None or doc != now:
                if total is not None:
                    out.append((now, total.tobytes()))
                now, total = doc, np.zeros(LANES, LANE)
            total += lanes
            if len(out) == 4096:
                yield batch(out)
                out = []
        if total is not None:
            out.append((now, total.tobytes()))
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["doc_id", "lanes"])

    def of_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[int | None, np.ndarray] = {}
            for doc, text, times in zip(b.column("doc_id").to_pylist(), texts(b.column("paragraph")), b.column("times").to_pylist(), strict=True):
                lanes = Fingerprint.of(paragraphs(text)).lanes * LANE((times or 0) % 2**32)
                own[doc] = own[doc] + lanes if doc in own else lanes
            yield batch([(d, x.tobytes()) for d, x in own.items()])

    def of_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch([(d, Fingerprint.from_hex(x).lanes.tobytes()) for d, x in zip(b.column("doc_id").to_pylist(), b.column("fingerprint").to_pylist(), strict=True)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merged((d, np.frombuffer(x, LANE)) for b in batches for d, x in zip(b.column("doc_id").to_pylist(), b.column("lanes").to_pylist(), strict=True))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([Fingerprint(np.frombuffer(x, LANE)).hex() for x in b.column("lanes").to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    parts = prints.select(F.col("doc_id").cast("long"), "fingerprint").mapInArrow(of_prints, schema)
    parts = parts.unionByName(changes.select(F.col("doc_id").cast("long"), "paragraph", F.col("times").cast("long").alias("times")).mapInArrow(of_changes, schema))
    whole = parts.repartition(partitions(spark), "doc_id").sortWithinPartitions("doc_id").mapInArrow(summed, schema)
    return whole.mapInArrow(shown, "doc_id long, fingerprint string")
