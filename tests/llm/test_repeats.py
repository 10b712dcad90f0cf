from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from cases import ROWS, documents, empty
from lathe.llm import regions, substring, suffix
from lathe.llm.queries import op1_substring_dedup, op8_suffix_dedup


def brute(rows, words: bool, size: int) -> dict:
    cut = lambda t: t.split() if words else t
    join = lambda x: b" ".join(x) if words else bytes(x)
    rank = lambda d: -(2**63) if d is None else d
    first: dict = {}
    for d, t in sorted(rows, key=lambda x: rank(x[0])):
        s = cut(t)
        for i in range(len(s) - size + 1):
            first.setdefault(join(s[i : i + size]), (rank(d), i))
    out = {}
    for d, t in rows:
        s = cut(t)
        edge = np.zeros(len(s) + 1, int)
        for i in range(len(s) - size + 1):
            if first[join(s[i : i + size])] < (rank(d), i):
                edge[i] += 1
                edge[i + size] -= 1
        gone = np.cumsum(edge)[: len(s)] > 0
        kept = [x for x, g in zip(s, gone) if not g]
        out[d] = int(gone.sum()), hashlib.sha256(join(kept)).hexdigest()
    return out


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(400):
        s = bytes(rng.choice(b"abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 50)))
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("seed", range(40))
def test_indexes_decide_like_sets(seed):
    rng = random.Random(seed)
    size = rng.randint(1, 6)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(size, 25))) for _ in range(rng.randint(1, 6))]
    starts = [rng.randint(1, len(p) - size + 1) for p in parts]
    seen, want = set(), []
    for p, n in zip(parts, starts):
        own = []
        for i in range(n):
            own.append(p[i : i + size] in seen)
            seen.add(p[i : i + size])
        want.append(own)
    order = [(i, 5 * i, -i) for i in range(len(parts))]
    assert [x.tolist() for x in suffix.repeats(parts, starts, order, size)] == want
    spaced = [b" ".join(bytes([c]) for c in p) for p in parts]
    assert [x.tolist() for x in substring.repeats(spaced, starts, order, size)] == want


def test_fm_index_matching_statistics():
    index = substring.FMIndex(np.array([1, 2, 1, 2, 3]))
    length, lo, hi = index.matches(np.array([1, 2, 3, 9]), np.array([1, 2, 3, 4]), 4)
    assert length.tolist() == [1, 2, 3, 0]
    assert (hi - lo).tolist()[:3] == [2, 2, 1]


CUT = [(d, (t or "").encode()) for d, t, *_ in ROWS]


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_edge_rows(spark, kind):
    words = kind == "words"
    run, size = (substring.remove_repeats, 20) if words else (suffix.remove_repeats, 100)
    want = brute(CUT, words, size)
    rows = run(documents(spark), size=size).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert run(empty(spark), size=size).collect() == []


def test_hot_groups_take_the_expanded_way(spark, monkeypatch):
    """Keys with too many different pieces for one index are dealt by single windows."""
    monkeypatch.setattr(regions, "GROUP", 4)
    rng = random.Random(3)
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, f"{rng.random()} x{rng.randint(0, 3)} {common} y{rng.randint(0, 3)} {rng.random()}") for i in range(60)]
    want = brute([(d, t.encode()) for d, t in rows], True, 20)
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), size=20).collect()
    assert all((r.n_removed, r.kept_sha256) == want[r.doc_id] for r in out)


def brute_rows(rows, words: bool, size: int) -> dict:
    """As brute(), where rows share ids: by (doc_id, start), each text by its own windows."""
    out = {}
    windows = {}
    for d, t in set(rows):
        s = t.split() if words else t
        windows[d, t] = [(b" ".join(s[i : i + size]) if words else s[i : i + size]) for i in range(len(s) - size + 1)]
    rank = lambda d: -(2**63) if d is None else d
    first: dict = {}
    for (d, _), own in windows.items():
        for i, w in enumerate(own):
            first[w] = min(first.get(w, (rank(d), i)), (rank(d), i))
    for (d, t), own in windows.items():
        edge = np.zeros(len(own) + size, int)
        for i, w in enumerate(own):
            if first[w] < (rank(d), i):
                edge[i] += 1
                edge[i + size] -= 1
        out[d, t] = int((np.cumsum(edge) > 0).sum())
    return out


@pytest.mark.parametrize("words", [True, False])
def test_rows_that_share_an_id_keep_their_own_words(spark, words):
    passage = " ".join(f"p{i}" for i in range(40))
    own = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(5, f"{own('r')} other"), (5, f"x {passage}"), (5, f"x y {passage} z"), (1, f"begin {passage}"), (5, own("q")), (None, f"{own('n')} {passage}"),
            (None, own("m")), (None, f"{own('m')} {own('k')}"), (7, passage), (7, passage), (None, None), (None, ""), (6, f"{own('q')} tail")]
    size = 20 if words else 100
    want = brute_rows([(d, (t or "").encode()) for d, t in rows], words, size)
    frame = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row int")
    out = (substring if words else suffix).remove_repeats(frame, size=size)
    got = sorted((str(r.doc_id), r.n_removed) for r in out.collect())
    # Of the two rows with id None that begin alike, at one start, one stays whole.
    tied = {(None, rows[6][1].encode()), (None, rows[7][1].encode())}
    extra = 30 if words else len(own("m"))
    assert sum(n for _, n in got) == sum(want[d, (t or "").encode()] for d, t in rows) + extra
    assert [x for x in got if x[0] != "None"] == sorted((str(d), want[d, (t or "").encode()]) for d, t in rows if d is not None)
    assert tied <= want.keys()


def test_stage_edits_rows_by_row(spark):
    """Null texts stay null next to changed rows; column names do not clash; rows that share an id keep their own words."""
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, passage, "a"), (2, f"x {passage} y", "b"), (3, None, "c"), (3, "", "d"), (2, "other words", "e"), (None, None, "f"), (None, f"{passage} n", "g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    frame = frame.selectExpr("doc_id", "spans", "text", "1 AS doc", "2 AS row", "'k' AS `__doc`", "0 AS `__spans`", "length(text) AS n_chars", "3 AS c0").coalesce(1)
    out = substring.keep_first_passages(frame)
    assert out.columns == frame.columns
    got = {r.spans: r for r in out.collect()}
    assert {k: r.text for k, r in got.items()} == {"a": "", "b": "x y", "c": None, "d": "", "e": "other words", "f": None, "g": f"{passage} n"}
    assert [got[k].n_chars for k in "abce"] == [0, 3, None, 11] and all((r.doc, r.row, r["__doc"], r["__spans"], r.c0) == (1, 2, "k", 0, 3) for r in got.values())


def test_stage_keeps_columns(spark):
    df = documents(spark)
    out = substring.keep_first_passages(df)
    assert out.columns == df.columns and out.count() == len(ROWS)
    assert {r.doc_id: r.text for r in out.collect()}[12] == dict((d, t) for d, t, *_ in ROWS)[12]


@pytest.mark.parametrize("query, words, size", [(op1_substring_dedup, True, 20), (op8_suffix_dedup, False, 100)])
def test_queries_against_brute_force(spark, small, query, words, size):
    docs = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute(docs, words, size)
    rows = query(spark, small).collect()
    assert len(rows) == len(docs)
    assert all((r.n_removed, r.kept_sha256) == want[r.doc_id] for r in rows)


def test_words_of_slices():
    """Words of any part of a column are those of its texts."""
    import pyarrow as pa

    from lathe.llm.common import split_words

    rng = random.Random(4)
    texts = [rng.choice([None, "", " \t", "É A\x85b\xa0 c"]) if rng.random() < 0.2 else " ".join(f"W{rng.randrange(50)}" for _ in range(rng.randrange(30))) + "\n" * rng.randrange(2) for _ in range(400)]
    column = pa.array(texts)
    for _ in range(100):
        at, n = rng.randrange(399), rng.randrange(1, 40)
        words, index, offsets = split_words(column.slice(at, n), lower=True)
        want = [(t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split() for t in texts[at : at + n]]
        assert [[words[i] for i in index[a:b]] for a, b in zip(offsets[:-1], offsets[1:])] == want


def test_suffix_array_as_far_as_signs_tell():
    """Strings of a fixed size are put in order by rounds that end with that size, also where whole suffixes are alike for long."""
    rng = np.random.default_rng(8)
    texts = [rng.integers(97, 99, 3000).astype(np.uint8).tobytes(), b"ab" * 2000, b"x" * 500, bytes(range(256)) * 9, b"q"]
    for s in texts:
        for upto in (1, 7, 8, 100):
            order = suffix.suffix_array(s, upto)
            assert sorted(order.tolist()) == list(range(len(s)))
            cut = [s[i : i + upto] for i in order.tolist()]
            assert cut == sorted(cut)
