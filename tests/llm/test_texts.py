from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from cases import LONG, ROWS, by_id, documents, empty

from lathe.llm import classlm, fingerprint, packing, piece, quality, simhash, toxicity
from lathe.llm.bytebpe import ByteBPE
from lathe.llm.queries import op3_toxicity, op4_quality_rules, op5_packing, op6_fingerprints, op7_sentencepiece, op9_simhash, op10_lm_scoring, tokenizer

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "aaaa aaa", "\n\n x", "tab\tq", "é ü 日本語 🙂", "▁x ▁", "a▁b", "▁ ia", "a ▁▁ b", " ▁", "▁", "<s> </s> <unk>", "<|endoftext|> it's", "\x00a", "ﬁ ① Å", "\xa0x", "....... -----", "1²½ ٣", "x\x1cy"]


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


# Quality rules


def base_counts(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = [False] * len(words)
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    failed = len(words) < 10 or 100 * sum(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(hit), failed


def test_quality_query(spark, small, docs):
    rows = by_id(op4_quality_rules(spark, small).collect())
    for d, t in docs.items():
        r = rows[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t)
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good = [rows[d] for d, q in labels.items() if q == 1 and not rows[d].base_failed]
    bad = [rows[d] for d, q in labels.items() if q == 0]
    assert all(r.kept for r in good) and sum(r.kept for r in bad) <= 0.1 * len(bad) + 1


def test_quality_edges(spark):
    rows = quality.quality_rules(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    assert all((r.n_words, r.base_failed) == (base_counts(t or "")[0], base_counts(t or "")[5]) for r, (_, t, *_) in zip(rows, ROWS))
    assert quality.quality_rules(empty(spark)).collect() == []
    kept = quality.keep_good(documents(spark))
    assert kept.columns == documents(spark).columns and {r.doc_id for r in kept.collect()} >= {5, 6, 12}


def test_lines_are_removed():
    body = "\n".join("word " * 3 + f"number {i} ends here." for i in range(4))
    *_, kept, why, clean = quality.judged(f"Home | About | Contact | Help\n{body}\nAll rights reserved.".encode(), quality.QualityRules(max_repeat_percent=100))
    assert kept and clean.decode() == body and why == {"navigation": 1, "boilerplate": 1}


# Toxicity


@pytest.mark.parametrize("noisy", ["1d10t", "1D10T!", "i d i o t", "idiooot", "i.d.i.o.t", "i-d-i-0-t", "id*iot"])
def test_noisy_words_are_restored(noisy):
    grams: Counter = Counter()
    for w in ("idiot", "the", "word", "quite", "tidy"):
        toxicity.char_grams(w, 5.0, grams)
    scorer = toxicity.Scorer(toxicity.ToxicityModel({"idiot": 5.0}, dict(grams)))
    assert scorer.score(f"some {noisy} here")[2] == ["idiot"]
    assert scorer.score("some idea of a tidy riot here")[1] == 0


def test_every_sign_is_decoded():
    """A word written with a sign for any of its letters has the skeleton of the word, and is restored."""
    for sign, letters in toxicity.LEET.items():
        for x in letters:
            word = f"kn{x}rp"
            grams: Counter = Counter()
            for w in (word, "the", "word"):
                toxicity.char_grams(w, 50.0, grams)
            assert toxicity.skeleton(f"kn{sign}rp") == toxicity.skeleton(word)
            assert toxicity.Scorer(toxicity.ToxicityModel({word: 5.0}, dict(grams))).score(f"some kn{sign}rp here")[2] == [word]


@pytest.mark.parametrize("noisy", ["1d10tic", "idiooootic", "i-d-i-o-t-i-c", "id*iotic", "i d i o t i c"])
def test_noisy_forms_of_stems_are_restored(noisy):
    grams: Counter = Counter()
    for w in ("idiotic", "idiots", "the", "word", "quite", "tidy"):
        toxicity.char_grams(w, 5.0, grams)
    scorer = toxicity.Scorer(toxicity.ToxicityModel({"^idiot": 5.0}, dict(grams)))
    assert scorer.score(f"some {noisy} here")[1] == 1
    assert scorer.score("some 1d34 of a t1dy r10t here")[1] == 0


@pytest.mark.parametrize("noisy", ["i, d, i, o, t", "I. D. I. O. T.", "1. d; 1: 0, t!", "(i) (d) (i) (o) (t)", "i d i o t"])
def test_spelled_words_with_punctuation_are_restored(noisy):
    grams: Counter = Counter()
    for w in ("idiot", "the", "word", "quite", "tidy"):
        toxicity.char_grams(w, 5.0, grams)
    scorer = toxicity.Scorer(toxicity.ToxicityModel({"idiot": 5.0}, dict(grams)))
    assert scorer.score(f"some {noisy} here")[2] == ["idiot"] and scorer.score(noisy)[2] == ["idiot"]


def test_texts_are_restored(spark):
    """Every noisy token is decoded, not only those that the lexicon knows."""
    grams: Counter = Counter()
    for w in ("people", "secret", "the", "this", "house", "message"):
        toxicity.char_grams(w, 20.0, grams)
    model = toxicity.ToxicityModel({"secret": 5.0}, dict(grams))
    rows = [(1, "(th1s) s3cr3t me$$age,\n the h0u5e 2024 people"), (2, None), (3, "")]
    out = toxicity.restored_texts(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert [r.restored for r in out] == ["(this) secret message,\n the house 2024 people", None, ""]


def test_toxicity_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = by_id(op3_toxicity(spark, sf).collect())
    assert len(rows) == 1000
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for d, r in rows.items())
    held = [(rows[d].score, x) for d, x in labels.items() if rows[d].held_out and x is not None]
    bad, good = [s for s, x in held if x], [s for s, x in held if not x]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.9
    assert np.mean([s >= 0.7 for s in bad]) > 0.75 and np.mean([s >= 0.7 for s in good]) < 0.02


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, None), (None, 1), (12, 0), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(documents(spark), labels)
    assert toxicity.score(documents(spark), model).count() == len(ROWS)
    nothing = toxicity.fit(empty(spark), labels)
    assert toxicity.score(empty(spark), nothing).collect() == []
    assert toxicity.keep_clean(documents(spark), nothing).count() == len(ROWS)


def test_toxicity_learns_from_all_labels(spark):
    """Also from those that a bounded sample by the hash of the doc_id would leave out."""
    from pyspark.sql import functions as F

    ids = [r.id for r in spark.range(33_000).orderBy(F.xxhash64("id"), "id").collect()]
    late = spark.createDataFrame([(i, 1) for i in ids[-300:]], "id long, late int")
    frame = spark.range(33_000).join(late, "id", "left").withColumn("toxic", F.coalesce("late", F.lit(0)))
    own = F.translate(F.col("id").cast("string"), "0123456789", "qwzxvkjyuh")  # no common words
    docs = frame.select(F.col("id").alias("doc_id"), F.when(F.col("toxic") > 0, F.concat(F.lit("you blorghet "), own)).otherwise(F.concat(F.lit("plain words "), own)).alias("text"))
    model = toxicity.fit(docs, frame.select(F.col("id").alias("doc_id"), "toxic"))
    assert "blorghet" in model.lexicon and "plain" not in model.lexicon
    grams, words = Counter(), {"you": 300.0, "blorghet": 300.0, "plain": 32_700.0, "words": 32_700.0}
    for w, n in words.items():
        toxicity.char_grams(w, n, grams)
    assert model.chars["pla"] == grams["pla"] and toxicity.shorter_grams({g: n for g, n in grams.items() if len(g) == 3 and g[0] != "2"}) == grams


# Packing


@pytest.fixture(scope="module")
def bpe() -> bytes:
    with open(tokenizer("byte_bpe_50k.json"), "rb") as f:
        return f.read()


def reference_ids(bpe: bytes, texts: list[str]) -> list[list[int]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(bpe.decode())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_byte_bpe_is_exact(bpe, docs):
    texts = [*ODD, *docs.values()]
    assert [np.frombuffer(x, "<u4").tolist() for x in ByteBPE(bpe).ids(texts)] == reference_ids(bpe, texts)


def test_added_tokens_are_one_id(spark, bpe):
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    quoted = [f"a {end} b", end, f"{end}{end}", f"x{end}y z\n{end}\n", f" {end}  tail ", "<|endoftext| >", f"<|{end}|>", f"é\t{end}\x85", "plain", ""]
    want = [e.ids for e in Tokenizer.from_str(bpe.decode()).encode_batch([*ODD, *quoted], add_special_tokens=False)]
    assert want[len(ODD)].count(50256) == 1
    assert [np.frombuffer(x, "<u4").tolist() for x in ByteBPE(bpe).ids_with_added([*ODD, *quoted])] == want
    rows = packing.pack(spark.createDataFrame(list(enumerate(quoted)), "doc_id long, text string"), bpe).collect()
    check_packed(rows, {i: [*x, 1] for i, x in enumerate(want[len(ODD) :])}, 2048)
    assert len(rows) == len(quoted)


def check_packed(rows, ids: dict[int, list[int]], window: int) -> None:
    seqs: dict = {}
    got: dict = {}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= window
    return seqs, got


def test_packing_query(spark, small, docs, bpe):
    ids = {d: [*x, 1] for d, x in zip(docs, reference_ids(bpe, list(docs.values())))}
    rows = op5_packing(spark, small).collect()
    seqs, got = check_packed(rows, ids, 2048)
    for d, parts in got.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[d])
    total = sum(map(len, ids.values()))
    assert set(got) == set(ids) and len(seqs) * 2048 - total < 0.03 * total + 2048


def test_packing_edges(spark, bpe):
    rows = packing.pack(documents(spark), bpe, window=64).collect()
    assert {(r.doc_id, r.start) for r in rows} >= {(1, 0), (2, 0), (None, 0)} and sum(r.doc_tokens for r in rows if r.start == 0) == sum(r.length for r in rows)
    assert packing.pack(empty(spark), bpe).collect() == []


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(5)
    for _ in range(5):
        histogram = Counter(rng.integers(1, 101, 700).tolist())
        used: Counter = Counter()
        for times, parts in packing.plan(histogram, 100):
            assert sum(n * k for n, k in parts) <= 100
            for n, k in parts:
                used[n] += times * k
        assert used == histogram


# Fingerprints


def test_fingerprint_query(spark, small, docs):
    order = sorted(docs, reverse=True)
    rows = by_id(op6_fingerprints(spark, small).collect())
    for d, e in zip(order, [*order[1:], order[0]]):
        text = fingerprint.edited(docs[d], docs[e])
        assert (rows[d].n_chars, rows[d].edited_sha256) == (len(docs[d]), hashlib.sha256(text.encode()).hexdigest())
        assert rows[d].fingerprint == fingerprint.Fingerprint.of(fingerprint.paragraphs(docs[d].encode())).hex()
    long = [rows[d] for d in order if len(docs[d]) > 200]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


def test_fingerprints_are_homomorphic():
    parts = [b"one", b"two", b"three", b"two"]
    whole = fingerprint.Fingerprint.of(parts)
    assert whole == fingerprint.Fingerprint.of(reversed(parts))
    assert whole - fingerprint.Fingerprint.of([b"two"]) == fingerprint.Fingerprint.of([b"one", b"two", b"three"])
    assert whole.likeness(whole) == 1.0
    assert b" ".join(fingerprint.units(LONG.encode())[1:]) == LONG.encode()
    a, b = "first line\nsecond, a longer line of more than eight words in all\n\nthird", "third\nfirst line\r\nsecond, a longer line of more than eight words in all\n"
    of = lambda t: fingerprint.Fingerprint.of(fingerprint.paragraphs(t.encode()))
    assert of(a) == of(b) and of("a\nb") == of("b\na") != of("a\nc")
    assert of("one two three four five six seven eight nine ten") != of("ten one two three four five six seven eight nine")


def test_fingerprints_of_a_table_take_changes(spark):
    """Insertions and deletions by table give the fingerprints of the changed texts."""
    of = lambda *t: fingerprint.Fingerprint.of(fingerprint.paragraphs("\n".join(t).encode())).hex()
    long = "a paragraph with more than eight words that is cut in parts somewhere in between"
    prints = spark.createDataFrame([(1, of("a", "b", "b")), (2, of(long)), (None, of("n")), (3, of("same"))], "doc_id long, fingerprint string")
    changes = [(1, "b", -1), (1, "c\nd", 2), (2, long, -1), (2, "new", 1), (4, "only", 1), (None, "m", 1), (3, None, 1), (3, "", 5), (3, "x", None)]
    out = fingerprint.insert_delete(prints, spark.createDataFrame(changes, "doc_id long, paragraph string, times int")).collect()
    want = {1: of("a", "b", "c", "c", "d", "d"), 2: of("new"), None: of("n", "m"), 3: of("same"), 4: of("only")}
    assert {r.doc_id: r.fingerprint for r in out} == want and len(out) == len(want)


def test_many_equal_paragraphs_are_told_apart():
    line = fingerprint.Fingerprint.of([b"x\n"])
    for n in (32_768, 65_536, 100_000):
        many = fingerprint.Fingerprint.of([b"x\n"] * n)
        assert many != fingerprint.Fingerprint() and many.size() == float(n) ** 2
        assert many.likeness(fingerprint.Fingerprint()) == 0.0 and many - line == fingerprint.Fingerprint.of([b"x\n"] * (n - 1))


def test_fingerprint_edges(spark):
    rows = fingerprint.fingerprints(documents(spark)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, *_ in ROWS)
    assert fingerprint.fingerprints(empty(spark)).collect() == []
    heavy = [(7, f"text {i}") for i in range(40)] + [(None, f"null {i}") for i in range(40)] + [(i, f"x{i}") for i in range(10)]
    rows = fingerprint.fingerprints(spark.createDataFrame(heavy, "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(heavy) and sorted(r.fingerprint for r in rows) == sorted(fingerprint.Fingerprint.of(fingerprint.paragraphs(t.encode())).hex() for _, t in heavy)
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


# SentencePiece


@pytest.fixture(scope="module")
def model() -> bytes:
    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_pieces_are_exact(model, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    own = piece.PieceModel(model)
    for t in [*ODD, *list(docs.values())[:60]]:
        ids = sp.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == sp.decode(ids)


def test_piece_query(spark, small, docs, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = by_id(op7_sentencepiece(spark, small).collect())
    for d, t in docs.items():
        ids = sp.encode(t)
        assert (rows[d].n_tokens, rows[d].ids_sha256, rows[d].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert piece.encode_documents(documents(spark), model).count() == len(ROWS)
    assert piece.encode_documents(empty(spark), model).collect() == []


# SimHash


def simhash_of(text: str) -> int:
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def joined(items: list[tuple]) -> dict:
    root = {i: i for i in range(len(items))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(items):
        for j, (_, b) in enumerate(items[:i]):
            if (a ^ b).bit_count() <= 3:
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(items):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(items)}


def test_simhash_query(spark, small, docs):
    items = [(d, simhash_of(t)) for d, t in docs.items()]
    want = joined(items)
    for r in op9_simhash(spark, small).collect():
        assert r.component_id == want[r.doc_id] and r.fingerprint == f"{dict(items)[r.doc_id]:016x}"


@pytest.mark.parametrize("direct", [8192, 4])
def test_links_connect_what_is_near(spark, direct):
    """Also where groups are over the limit and take the way by three bits."""
    rng = np.random.default_rng(7)
    base = int(rng.integers(0, 2**63))
    fps = {base}
    while len(fps) < 60:
        x = sorted(fps)[int(rng.integers(0, len(fps)))]
        for b in rng.choice(32 if direct == 4 else 64, 2, replace=False).tolist():
            x ^= 1 << b
        fps.add(x)
    fps |= {int(rng.integers(0, 2**63)) for _ in range(40)}
    items = [(i, x) for i, x in enumerate(sorted(fps))]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for _, x in items], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, simhash.SimHashRules(direct=direct)).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    root = {x: x for _, x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = joined(items)
    groups: dict = {}
    for i, x in items:
        groups.setdefault(find(x), set()).add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_simhash_edges(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    found = {r.doc_id: r.component_id for r in rows}
    assert found[1] == found[2] == found[3] == 1 and found[13] == 12 and found[15] == 14 and found[8] == 7
    assert simhash.near_duplicates(empty(spark)).collect() == []
    for keep, stay, go in ((simhash.keep_first, {1, 7, 10, 12, 14}, {2, 8, 13, 15}), (simhash.keep_first_like, {1, 5, 7, 12, 14}, {2, 6, 8, 10, 13, 15, None})):
        kept = keep(documents(spark))
        assert kept.columns == documents(spark).columns
        ids = [r.doc_id for r in kept.collect()]
        assert len(ids) == len(set(ids)) and stay <= set(ids) and not go & set(ids)
        assert keep(empty(spark)).collect() == []


def test_one_row_of_each_component_stays(spark):
    """Rows that share an id, or have none, are kept and dropped by their own texts, and other columns come along."""
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(5, a, 1), (5, b, 2), (None, c, 3), (None, d, 4), (None, a, 5), (7, b, 6), (9, e, 7), (9, e, 8), (None, None, 9), (2, "", 10), (3, "  ", 11)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumnsRenamed({"fp": "row"})
    for keep in (simhash.keep_first, simhash.keep_first_like):
        assert sorted(r.row for r in keep(frame).collect()) in ([1, 2, 3, 4, 7, 10], [1, 2, 3, 4, 8, 10])


def like_groups(docs: dict, shingle: int = 5, least: float = 0.8) -> dict:
    """For each document the smallest one that links of at least this similarity reach; all pairs are compared."""
    sets = {}
    for d, t in docs.items():
        words = t.translate(LOWER).split()
        sets[d] = {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(sorted(docs)):
        for b in sorted(docs)[:i]:
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in docs}


def test_like_texts_against_all_pairs(spark, docs):
    """Documents of the table, with versions at and about the limit, a large group of versions and rows without words."""
    rng = np.random.default_rng(3)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    items = {d: t.encode() for d, t in docs.items()}
    base = text(400)
    for i in range(300):
        words = list(base)
        words[int(rng.integers(0, 400))] = f"v{i}"
        items[10**6 + i] = " ".join(words).encode()
    for i in range(60):
        words = text(200)
        items[2 * 10**6 + 2 * i] = " ".join(words).encode()
        for at in rng.choice(200, int(rng.integers(1, 8)), replace=False).tolist():
            words[at] = "other"
        items[2 * 10**6 + 2 * i + 1] = " ".join(words).upper().encode()
    items |= {3 * 10**6: b"", 3 * 10**6 + 1: b" \n", 3 * 10**6 + 2: b"a b", 3 * 10**6 + 3: b"A  b"}
    want = like_groups(items)
    frame = spark.createDataFrame([(d, t.decode()) for d, t in items.items()], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_first_like(frame).collect()}
    firsts = {d for d, x in want.items() if d == x}
    gone = len(items) - len(firsts)
    assert firsts <= kept and gone > 300 and len(kept - firsts) <= 0.02 * gone


# Language model


def test_lm_query(spark, small, docs):
    tokens = {d: [*t.encode().translate(LOWER).split(), b""] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = by_id(op10_lm_scoring(spark, small).collect())
    for d, ws in tokens.items():
        r = rows[d]
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    out = [r for d, r in rows.items() if held[d]]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_exchange_groups_words_of_like_use():
    pairs = np.zeros((9, 9))  # 0 to 2 are followed by 3 to 5, and the other way round
    for a in range(3):
        for b in range(3, 6):
            pairs[a, b] = pairs[b, a] = 50 + a + b
    cls = classlm.exchange(pairs, 6, 2, 10)
    assert len(set(cls[:3])) == len(set(cls[3:6])) == 1 and cls[0] != cls[3]


def test_lm_edges(spark):
    from pyspark.sql import functions as F

    rows = classlm.score(documents(spark), F.col("doc_id") != 4).collect()
    assert len(rows) == len(ROWS) and all(r.n_tokens >= 1 and np.isfinite(r.score) for r in rows)
    assert classlm.score(empty(spark), F.lit(True)).collect() == []
    assert classlm.score(documents(spark), F.lit(False)).count() == len(ROWS)


def test_rare_words_join_classes_by_their_use(spark):
    """Words below the exchanged ones are told apart by what stands around them, not by their shape."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    nouns, verbs = [f"n{a}x" for a in "bcdfghjk"], [f"v{a}x" for a in "bcdfghjk"]
    rare = [(f"qa{a}{b}", f"qe{a}{b}") for a in "bcdfg" for b in "bcdfg"]  # used as nouns, as verbs: equal shapes
    rows = []
    for i in range(600):
        words = [w for _ in range(10) for w in (nouns[rng.integers(8)], verbs[rng.integers(8)])]
        a, b = rare[i % 25]
        words[2 * int(rng.integers(1, 9))] = a
        words[2 * int(rng.integers(1, 9)) + 1] = b
        rows.append((i, " ".join(words)))
    right, wrong = "nbx qecc nbx vbx", "nbx qacc nbx vbx"
    rows += [(1000, right), (1001, wrong)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = classlm.Rules(frequent=16, classes=2, growth=1)
    out = by_id(classlm.score(docs, F.col("doc_id") < 1000, rules).collect())
    assert abs(out[1000].base_score - out[1001].base_score) < 1e-6 and out[1000].score > out[1001].score + 1


def test_a_word_joins_the_likeliest_class():
    """By the likelihood of the whole grid, also for words that follow themselves."""
    rng = np.random.default_rng(11)
    n, classes = 12, 3
    pairs = rng.integers(0, 9, (n, n)).astype(float)
    cls = np.array([*(np.arange(10) % 5), 3, 4])
    total = 5
    square = lambda c: np.array([[pairs[np.ix_(c == a, c == b)].sum() for b in range(total)] for a in range(total)])
    like = lambda g: classlm.xlogx(g).sum() - classlm.xlogx(g.sum(axis=0)).sum() - classlm.xlogx(g.sum(axis=1)).sum()
    for w in range(n):
        if cls[w] < classes:
            continue
        one = np.eye(total)[cls]
        row, col = pairs[w] @ one, pairs[:, w] @ one
        row[cls[w]] -= pairs[w, w]
        col[cls[w]] -= pairs[w, w]
        got = classlm.inserted(np.concatenate((row, col, [pairs[w, w]]))[None], np.array([cls[w]]), square(cls), classes)[0]
        assert got == max(range(classes), key=lambda k: like(square(np.where(np.arange(n) == w, k, cls))))


def test_small_batches_and_joined_words_score_alike(spark, small, docs):
    """Counts and classes that come by joins, over many batches, are those that all tasks are sent; tokens are counted whole."""
    from pyspark.sql import functions as F

    frame = spark.read.parquet(f"{small}/documents.parquet")
    rows = [by_id(classlm.score(frame, F.col("doc_id") % 3 > 0, classlm.Rules(frequent=40, growth=3, hot=hot, batch=batch)).collect()) for hot, batch in ((1 << 17, 1 << 22), (60, 1 << 13))]
    for d, t in docs.items():
        a, b = rows[0][d], rows[1][d]
        assert a.n_tokens == b.n_tokens == len(t.encode().split()) + 1 and a.n_known == b.n_known
        assert abs(a.score - b.score) < 1e-6 * abs(a.score) and abs(a.base_score - b.base_score) < 1e-6 * abs(a.base_score)


def test_lm_memory_does_not_grow_with_a_task(spark, small, monkeypatch):
    """However many batches one task makes, no file of batches holds more than a few of them, as readers and writers hold a file's rows
    at once; and batches meet in parts, a row for each part and batch, not for each word."""
    from pyspark.sql import functions as F

    seen = {}
    real = classlm.staged

    def staged(df, name, *rest):
        out = real(df, name, *rest)
        seen[name] = (out.count(), out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0])
        if name == "met-words":
            seen["answers"] = (out.where("batch is not null").count(), out.select("batch", "part").where("batch is not null").distinct().count())
        return out

    monkeypatch.setattr(classlm, "staged", staged)
    frame = spark.read.parquet(f"{small}/documents.parquet").coalesce(1)
    assert classlm.score(frame, F.lit(True), classlm.Rules(frequent=40, growth=3, batch=1 << 12)).count() == 200
    for name in ("coded-texts", "counted-texts", "class-rows"):
        assert seen[name][0] > 40 and seen[name][1] <= 8
    assert seen["answers"][0] == seen["answers"][1] <= 4 * seen["coded-texts"][0]


def test_a_full_cache_of_pieces_keeps_words_in_use(monkeypatch):
    model = piece.piece_model(open(tokenizer("piece_bpe_32k.model"), "rb").read())
    monkeypatch.setattr(model, "LIMIT", 2)
    model.learn({"▁house", "▁tree", "▁river"})
    known, merged, real = dict(model.cache), [], model.word_ids
    monkeypatch.setattr(model, "word_ids", lambda words: merged.extend(words) or real(words))
    model.learn({"▁tree", "▁cloud"})
    assert merged == ["▁cloud"] and set(model.cache) == {"▁tree", "▁cloud"} and model.cache["▁tree"] == known["▁tree"]
    assert piece.piece_model(open(tokenizer("piece_bpe_32k.model"), "rb").read()) is model
