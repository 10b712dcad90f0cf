"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints at most 3 bits apart, one half differs in at most one bit, so
with one bit of that half taken out for each of its 32 places, the two share at least one such variant. Variants are joined by
equality and the pairs verified by their distance.

For texts that are alike by their sets of shingles one plain fingerprint is too coarse: at a similarity of 0.8 some 10 of its 64 bits
differ. There, several fingerprints are taken of each text, in each of which a shingle weighs u ** -slope, u being a number from 0 to 1
that its hash and the fingerprint's seed give. A few shingles, other ones in each, then decide most bits, and a fingerprint of two like
texts is mostly either within three bits or far off. Its deletion variants find the former; the exact similarity of the texts decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import NULL_ID, batch_limits, dropped, mix, partitions, record_batches, release, split_words, staged, texts
from lathe.llm.graph import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class SimHashRules:
    """shingle: words of a shingle; seed: of XXH64; direct: the most fingerprints with one variant that are compared directly.
    Larger groups are split again by variants with three bits taken out, whose members all link."""

    shingle: int = 3
    seed: int = 42
    direct: int = 8192


@dataclass(frozen=True)
class LikenessRules:
    """shingle: words of a shingle; similarity: the least share of all different shingles of two texts that both have; families:
    weighted fingerprints of each text; slope: of the weights; seed: of all hashes; direct: as in SimHashRules. Of pairs at a similarity
    of 0.8 one family finds 0.70 (simulated, 300 shingles), six find over 0.99; a pair in a group is found over others as well."""

    shingle: int = 5
    similarity: float = 0.8
    families: int = 6
    slope: float = 2.0
    seed: int = 42
    direct: int = 8192


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    elif shingle == 3:
        grams = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    else:
        grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, rules: SimHashRules = SimHashRules(), keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(keys, text) -> (keys, fp long). One pass, no shuffle."""
    batch_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(x, rules.shingle, rules.seed) for x in texts(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(k).cast(pa.int64()) for k in keys), pa.array(fp.view(np.int64))], names=[*keys, "fp"])

    return docs.select(*keys, "text").mapInArrow(run, "".join(f"{k} long, " for k in keys) + "fp long")


def variants(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint its 64 variants: key (half, place taken out, the half's other bits) and the fingerprint again."""
    fp = fp.view(np.uint64)
    place = np.arange(64, dtype=np.uint64)
    half = np.where(place[None, :] < 32, fp[:, None] & np.uint64(0xFFFFFFFF), fp[:, None] >> np.uint64(32))
    half &= ~(np.uint64(1) << (place % np.uint64(32)))[None, :]
    return (half | (place << np.uint64(32))[None, :]).ravel().view(np.int64), np.repeat(fp, 64).view(np.int64)


def spanning(fp: np.ndarray, bits: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of fp (distinct, sorted) that are connected by steps of at most bits bits: at most len(fp) - 1."""
    u = fp.view(np.uint64)
    root = np.arange(len(u))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = [], []
    for i in range(0, len(u), block):
        for j in range(i, len(u), block):
            x, y = np.nonzero(np.bitwise_count(u[i : i + block, None] ^ u[None, j : j + block]) <= bits)
            x, y = x + i, y + j
            new = (x < y) & (root[x] != root[y])
            for s, t in zip(x[new].tolist(), y[new].tolist(), strict=True):
                r, q = find(s), find(t)
                if r != q:
                    root[max(r, q)] = min(r, q)
                    a.append(s), b.append(t)
            if new.any():
                root = np.array([find(k) for k in range(len(u))]) if len(u) <= block else root
    return fp[a], fp[b]


def links(fps: DataFrame, rules: SimHashRules = SimHashRules()) -> DataFrame:
    """fps(fp), distinct -> links (a, b) that connect all fingerprints at most 3 bits apart."""
    spark = fps.sparkSession
    n = partitions(spark)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp = variants(b.column("fp").to_numpy())
            yield from record_batches({"key": (key, pa.int64()), "fp": (fp, pa.int64())})

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. A group up to the limit is linked here; the rows of a larger one pass on as they come."""
        held_key, held, passed = None, [], False

        def close() -> Iterator[tuple]:
            fp = np.concatenate(held) if held else np.zeros(0, np.int64)
            if passed:
                yield np.full(len(fp), held_key, np.int64), fp, np.ones(len(fp), bool)
            elif len(fp) > 1:
                a, b = spanning(fp, 3)
                yield a, b, np.zeros(len(a), bool)

        for batch in batches:
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(edges, len(key)))
            out = []
            last = len(edges) - 1
            for g in np.unique(np.concatenate(([0], np.flatnonzero(sizes > 1), [last]))).tolist():
                k, part = int(key[edges[g]]), fp[edges[g] : edges[g] + sizes[g]]
                if k != held_key:
                    out += close()
                    held_key, held, passed = k, [], False
                held.append(part)
                if sum(map(len, held)) > rules.direct or passed:
                    passed = True
                    out += close()
                    held = []
            for a, b, more in out:
                yield from record_batches({"a": (a, pa.int64()), "b": (b, pa.int64()), "more": (more, pa.bool_())})
        for a, b, more in close():
            yield from record_batches({"a": (a, pa.int64()), "b": (b, pa.int64()), "more": (more, pa.bool_())})

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All ways to take 3 of the group's 33 free bits out: those equal in the rest are all at most 3 apart."""
        free: dict[int, np.ndarray] = {}
        for b in batches:
            for key, fp in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                place = key >> 32
                if place not in free:
                    loose = [place, *(range(32, 64) if place < 32 else range(32))]
                    masks = [(1 << x) | (1 << y) | (1 << z) for i, x in enumerate(loose) for j, y in enumerate(loose[:i]) for z in loose[:j]]
                    free[place] = np.array(masks, np.uint64)
                mask = free[place]
                rest = np.uint64(fp & (2**64 - 1)) & ~mask
                yield from record_batches({"mask": (mask.view(np.int64), pa.int64()), "rest": (rest.view(np.int64), pa.int64()), "fp": (np.full(len(mask), fp), pa.int64())})

    # The table of fingerprints is small, but each gives 64 rows: it is dealt over all tasks first.
    keyed = fps.select("fp").repartition(n).mapInArrow(index, "key long, fp long").repartition(n, "key").sortWithinPartitions("key", "fp")
    found = staged(keyed.mapInArrow(group, "a long, b long, more boolean"), "simhash-groups")
    large = found.where("more").repartition(n).mapInArrow(deeper, "mask long, rest long, fp long")
    least = large.groupBy("mask", "rest").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = large.join(least, ["mask", "rest"]).select(F.col("fp").alias("a"), "b")
    return found.where("not more").select("a", "b").distinct().unionByName(star.where("a <> b").distinct()).distinct()


def roots_of(nodes: DataFrame, rules: SimHashRules) -> DataFrame:
    """nodes(fp, ...), a row for each fingerprint -> with root: the fingerprint that names its component."""
    found = staged(components(links(nodes, rules)), "simhash-roots")
    return nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, rules: SimHashRules = SimHashRules()) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint as 16 hex digits, component_id: the smallest doc_id that links reach).

    Null and empty texts have fingerprint zero and link like others. Equal fingerprints are one node of the link graph, so
    copies make no pairs. Null ids keep their row; a component of null ids alone has component_id null. Repeated rows, and rows that
    share an id, each have a row of their own fingerprint. An empty table gives no rows; other columns are not read.
    """
    fps = staged(fingerprints(docs, rules), "simhash-fps")
    named = roots_of(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), rules)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("fp", "component_id")
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def placed(docs: DataFrame) -> DataFrame:
    """docs with its columns called c0, c1, ... and doc, row: the doc_id and the hash of the text that a row is known by."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return inner.withColumns({"doc": F.col(f"c{names.index('doc_id')}").cast("long"), "row": F.xxhash64(f"c{names.index('text')}")})


def first_row() -> Column:
    """Of rows of one component the first: one with a doc_id, the smallest, and the smallest hash of a text."""
    return F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row")).alias("first")


def only(inner: DataFrame, first: DataFrame, names: list[str]) -> DataFrame:
    """The rows of inner (of placed()) that first(first) names, one each, under their own names."""
    chosen = first.select(F.coalesce("first.doc", F.lit(NULL_ID)).alias("doc"), F.col("first.row").alias("row"))
    kept = inner.withColumn("doc", F.coalesce("doc", F.lit(NULL_ID))).join(chosen, ["doc", "row"], "left_semi")
    return kept.dropDuplicates(["doc", "row"]).drop("doc", "row").toDF(*names)


def keep_first(docs: DataFrame, rules: SimHashRules = SimHashRules()) -> DataFrame:
    """docs with all its columns: of each component one row, that with the smallest doc_id, and of several such the one whose text has
    the smallest hash; of rows equal in both, any one. A row without doc_id stays only where its component has no other. Null and
    empty texts are one component. Columns may have any names; an empty table stays empty."""
    inner, text = placed(docs), F.col(f"c{docs.columns.index('text')}").alias("text")
    fps = staged(fingerprints(inner.select("doc", "row", text), rules, ("doc", "row")), "simhash-fps")
    chosen = roots_of(fps.groupBy("fp").agg(first_row()), rules).groupBy("root").agg(F.min("first").alias("first"))
    return only(inner, chosen, docs.columns)


def shingle_hashes(words: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of the different shingles of a text from its words' hashes, sorted; of fewer words, the whole sequence is the one shingle."""
    if not len(words):
        return words
    size = min(shingle, len(words))
    count = len(words) - size + 1
    h = mix(words[:count])
    for i in range(1, size):
        h = mix(h * np.uint64(31) + words[i : i + count])
    return np.unique(h)


def weighted(grams: np.ndarray, seeds: np.ndarray, slope: float, block: int = 1 << 15) -> np.ndarray:
    """The fingerprint of each seed; zero where there are no shingles. Equal sets give equal fingerprints."""
    votes = np.zeros((64, len(seeds)))
    for at in range(0, len(grams), block):
        h = grams[at : at + block]
        signs = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") * 2.0 - 1.0
        share = (mix(h[:, None] ^ seeds[None, :]) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
        votes += signs.T @ share**-slope
    return np.ascontiguousarray(np.packbits(votes > 0, axis=0, bitorder="little").T).view(np.uint64).ravel()


def family_fingerprints(docs: DataFrame, rules: LikenessRules) -> DataFrame:
    """docs(doc, row, text) -> (doc, row, check, fp0, fp1, ...). check: length and checksum, by which copies are known with row."""
    batch_limits(docs.sparkSession)
    seeds = mix(np.arange(rules.families, dtype=np.uint64) + np.uint64(rules.seed))
    names = [f"fp{k}" for k in range(rules.families)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            different, codes, offsets = split_words(b.column("text"), lower=True)
            words = np.array([xxhash.xxh64_intdigest(w, rules.seed) for w in different], np.uint64)[codes] if different else np.zeros(0, np.uint64)
            fps = np.zeros((b.num_rows, rules.families), np.uint64)
            for i in range(b.num_rows):
                fps[i] = weighted(shingle_hashes(words[offsets[i] : offsets[i + 1]], rules.shingle), seeds, rules.slope)
            columns = [pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(rules.families)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("row"), b.column("check"), *columns], names=["doc", "row", "check", *names])

    check = (F.coalesce(F.length("text"), F.lit(0)).cast("long") * F.lit(1 << 32) + F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).alias("check")
    return docs.select("doc", "row", check, "text").mapInArrow(run, "doc long, row long, check long, " + ", ".join(f"{k} long" for k in names))


def neighbours(nodes: DataFrame, fp: str, then: str) -> DataFrame:
    """nodes(id, fp, then) -> (a, b): each node and the next one in the order of fp, then, id, if their fp is the same. The order is dealt by
    ranges, so many equal fingerprints are no hot task; over the end of a range, the star of the fingerprint links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_fp, last_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            fps = np.concatenate((last_fp, b.column(fp).to_numpy()))
            ids = np.concatenate((last_id, b.column("id").to_numpy()))
            same = fps[1:] == fps[:-1]
            yield from record_batches({"a": (ids[1:][same], pa.int64()), "b": (ids[:-1][same], pa.int64())})
            last_fp, last_id = fps[-1:], ids[-1:]

    order = [fp, then, "id"]
    return nodes.select(*dict.fromkeys(order)).repartitionByRange(partitions(nodes.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def candidates(nodes: DataFrame, rules: LikenessRules) -> DataFrame:
    """nodes(id, fp0, fp1, ...) -> pairs (a, b), a > b, that may be alike; their number is in proportion to the nodes, whatever the
    groups. In each family: a node and the first one of its fingerprint, a node and its neighbour among equal fingerprints by the
    order of the next family, and the first ones of linked fingerprints."""
    spark, found = nodes.sparkSession, None
    for k in range(rules.families):
        fp = f"fp{k}"
        first = staged(nodes.groupBy(F.col(fp).alias("fp")).agg(F.min("id").alias("least")), "near-first")
        star = nodes.select("id", F.col(fp).alias("fp")).join(first, "fp").select(F.col("id").alias("a"), F.col("least").alias("b"))
        near = links(first, SimHashRules(direct=rules.direct))
        for side in ("a", "b"):
            near = near.join(first.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_id")), side)
        pairs = star.unionByName(near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
        pairs = pairs.unionByName(neighbours(nodes, fp, f"fp{(k + 1) % rules.families}")).where("a <> b")
        pairs = staged(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-pairs")
        dropped(first)
        release(spark)
        found = pairs if found is None else found.unionByName(pairs)
    return staged(found.distinct(), "near-candidates")


def shingles_of(text: bytes, shingle: int) -> set:
    words = text.translate(LOWER).split()
    return set(zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else {tuple(words)}


def alike(pairs: DataFrame, rules: LikenessRules) -> DataFrame:
    """pairs(a, b, text_a, text_b) -> (a, b) of those whose texts reach the similarity. Texts without words are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set] = {}

        def of(node: int, text: bytes) -> set:
            if node not in held:
                if len(held) >= 16:
                    held.pop(next(iter(held)))
                held[node] = shingles_of(text, rules.shingle)
            return held[node]

        for p in batches:
            keep = []
            for a, b, s, t in zip(p.column("a").to_pylist(), p.column("b").to_pylist(), texts(p.column("text_a")), texts(p.column("text_b")), strict=True):
                x, y = of(a, s), of(b, t)
                both = len(x & y) if min(len(x), len(y)) >= rules.similarity * max(len(x), len(y)) else 0
                keep.append(both >= rules.similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def keep_first_like(docs: DataFrame, rules: LikenessRules = LikenessRules()) -> DataFrame:
    """keep_first() for texts that are alike by their sets of shingles (words with A-Z lower-cased): of each group that links of at least
    the similarity join, one row stays. Links come from weighted fingerprints and are checked on the texts, so texts that nothing is
    like stay. Nulls, empty texts, ties, repeated rows, column names and empty tables are as in keep_first()."""
    inner, text = placed(docs), F.col(f"c{docs.columns.index('text')}").alias("text")
    marks = staged(family_fingerprints(inner.select("doc", "row", text), rules), "near-marks")
    fps = [f"fp{k}" for k in range(rules.families)]
    copies = marks.groupBy("row", "check", *fps).agg(first_row())
    nodes = staged(copies.select(F.monotonically_increasing_id().alias("id"), "first", *fps), "near-nodes")
    pairs = candidates(nodes, rules)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = wanted.join(nodes, "id").select("id", F.coalesce("first.doc", F.lit(NULL_ID)).alias("doc"), F.col("first.row").alias("row"))
    found = inner.select(F.coalesce("doc", F.lit(NULL_ID)).alias("doc"), "row", text).join(wanted, ["doc", "row"]).dropDuplicates(["id"])
    found = staged(found.select("id", "text"), "near-texts")
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")), side)
    links_found = staged(alike(pairs, rules), "near-links")
    dropped(found)
    release(docs.sparkSession)
    roots = staged(components(links_found).withColumnRenamed("node", "id"), "near-roots")
    chosen = nodes.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    return only(inner, chosen, docs.columns)
