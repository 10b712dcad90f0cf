"""Toxicity by a noisy channel.

Obfuscated words (leetspeak, spaced or dotted letters, repeated letters) are seen as noisy forms of clean words. A Viterbi search
over the lattice of what each character may stand for, under a character language model, restores the likeliest word; the
restored text is scored with a lexicon learned from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import batch_limits, release, rewritten, staged, texts

#: What a sign may stand for, besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "à": "a", "á": "a", "â": "a", "ä": "a",
    "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ò": "o", "ó": "o", "ô": "o", "ö": "o",
    "ù": "u", "ú": "u", "û": "u", "ü": "u",
}


def sign_classes() -> dict[str, str]:
    """For each sign and letter its class: all letters that one sign may stand for are in one, and the sign with them."""
    above: dict[str, str] = {}

    def top(x: str) -> str:
        while x in above:
            x = above[x]
        return x

    for letters in LEET.values():
        for x in letters[1:]:
            if top(x) != top(letters[0]):
                above[top(x)] = top(letters[0])
    return {x: top(x) for x in above} | {sign: top(letters[0]) for sign, letters in LEET.items()}


CLASS = str.maketrans(sign_classes())
RUN = re.compile(r"(.)\1+", re.S)
NOISE = re.compile(r"[\W_]+")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—¿¡|"
START, END = "^", "$"


def skeleton(token: str) -> str:
    """What all noisy forms of a word share: signs by class, runs cut to one, all else that is no letter dropped."""
    return RUN.sub(r"\1", NOISE.sub("", token.translate(CLASS)))


@dataclass
class CharModel:
    """Interpolated character trigrams with START and END."""

    counts: dict[str, float]
    logs: dict[str, float] = field(default_factory=dict)

    def log(self, gram: str) -> float:
        """log P(gram[2] | gram[:2])."""
        if gram not in self.logs:
            c = self.counts.get
            uni = (c(gram[2], 0) + 1) / (c("", 0) + 64)
            bi = (c(gram[1:], 0) + 4 * uni) / (c("1" + gram[1], 0) + 4)
            self.logs[gram] = math.log((c(gram, 0) + 4 * bi) / (c("2" + gram[:2], 0) + 4))
        return self.logs[gram]


def char_grams(word: str, weight: float, into: Counter) -> None:
    s = START + START + word + END
    for k in range(2, len(s)):
        into[s[k]] += weight
        into[""] += weight
        into[s[k - 1 : k + 1]] += weight
        into["1" + s[k - 1]] += weight
        into[s[k - 2 : k + 1]] += weight
        into["2" + s[k - 2 : k]] += weight


def viterbi(token: str, model: CharModel, substitute: float = -1.0, drop: float = -1.0) -> str:
    """The likeliest word behind token. Each sign stands for itself or a letter of LEET; a sign that is no letter may be noise
    between letters; each of a run of equal signs after the first may be a repetition that is dropped."""
    states: dict[tuple[str, str], tuple[float, str]] = {(START + START, ""): (0.0, "")}
    for at, sign in enumerate(token):
        again = at > 0 and token[at - 1] == sign
        cost_off = drop if again or sign not in LEET else 3 * drop
        options = [(x, substitute) for x in LEET.get(sign, "")]
        if sign.isalpha():
            options.append((sign, 0.0))
        new: dict[tuple[str, str], tuple[float, str]] = {}
        for (last, _), (score, out) in states.items():
            moves = [(last[1] + x, out + x, score + cost + model.log(last + x)) for x, cost in options]
            if again or not sign.isalpha():
                moves.append((last, out, score + cost_off))
            for key, word, value in moves:
                if (key, "") not in new or value > new[key, ""][0]:
                    new[key, ""] = (value, word)
        states = new or states
    return max(((s + model.log(last + END), out) for (last, _), (s, out) in states.items()), default=(0.0, ""))[1]


@dataclass(frozen=True)
class ToxicityModel:
    """lexicon: weight (log of how much more frequent it is in toxic texts) of words, and of stems, which begin with START.
    chars: counts of the character model. curve: weights of the logistic curve over what evidence() returns."""

    lexicon: dict[str, float]
    chars: dict[str, float]
    curve: tuple[float, ...] = (-2.0, 1.0, 0.5)


def features(word: str, stems: range) -> list[str]:
    """The word, and its stems."""
    return [word, *(START + word[:k] for k in stems if k < len(word))]


#: Lengths of stems. Stems let a word be known by its beginning where endings vary.
STEMS = range(3, 8)


class Scorer:
    """Restores and scores texts; each distinct token is decoded once.

    A score counts the words of the restored text that the lexicon has. A token can be restored to such a word only if their skeletons
    agree (or it begins with a stem's), so for scores only those are decoded, which changes none. restore() decodes every noisy token.
    """

    LIMIT = 1 << 19

    def __init__(self, model: ToxicityModel):
        self.w, self.chars, self.curve = model.lexicon, CharModel(model.chars), model.curve
        self.words = {w for w in self.w if not w.startswith(START)}
        self.begins = {w.removeprefix(START)[: STEMS[0]] for w in self.w}
        self.shapes = {skeleton(w) for w in self.words}
        self.stems = {skeleton(w.removeprefix(START)) for w in self.w if w.startswith(START)}
        self.sizes = sorted({len(x) for x in self.stems})
        self.longest = 2 * max((len(w) for w in self.words), default=0) + 8
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, float]] = {}
        self.decoded: dict[str, str] = {}

    def weight(self, word: str) -> float:
        """The largest of the word and its stems."""
        return max((self.w.get(f, 0.0) for f in features(word, STEMS)), default=0.0)

    def may_hold(self, token: str) -> bool:
        """Whether token has the skeleton of a word, or begins with that of a stem."""
        shape = skeleton(token)
        return shape in self.shapes or any(shape[:k] in self.stems for k in self.sizes)

    def hit(self, token: str) -> tuple[str, float]:
        """The restored word that token is a form of, and its weight; 0 if the lexicon has neither it nor its stem."""
        plain = token.strip(PUNCTUATION)
        word, found = plain, 0.0
        if plain[: STEMS[0]] in self.begins:
            found = self.weight(plain)
        # Plain ASCII letters without a run of equal ones are their own restored form.
        if plain not in self.words and not (plain.isascii() and plain.isalpha() and len(token) == len(plain) and not RUN.search(plain)):
            # Signs at the edge may be letters or mere punctuation: both readings are decoded.
            for x in (token, plain) if token != plain and (token[0] in LEET or token[-1] in LEET) else (plain,):
                if self.may_hold(x) and (new := self.weight(w := viterbi(x, self.chars))):
                    if w in self.words:
                        return w, max(found, new)
                    if new > found:
                        word, found = w, new
        return word, found

    def restored(self, text: str) -> tuple[list[tuple[str, float]], int]:
        """The words of text with a weight, also those spelled with spaces between letters; the number of words."""
        tokens = text.lower().split()
        kinds = set(tokens)
        if new := kinds - self.seen:
            if len(self.seen) > self.LIMIT:
                self.seen.clear(), self.hits.clear()
                new = kinds
            self.seen |= new
            self.hits.update((t, x) for t in new if (x := self.hit(t))[1])
        found = []
        if known := kinds & self.hits.keys():
            times = Counter(tokens)
            found = [self.hits[t] for t in sorted(known) for _ in range(times[t])]
        single = {t for t in kinds if len(t) < 4 and len(t.strip(PUNCTUATION) or t) == 1}
        if single and "   " in "".join([" " if t in single else "x" for t in tokens]):
            run: list[str] = []
            for t in [*tokens, "    "]:
                if t in single:
                    run.append(t)
                    continue
                if len(run) >= 3:
                    found += self.spaced(run) or self.spaced([t.strip(PUNCTUATION) or t for t in run])
                run = []
        return found, len(tokens)

    def restore(self, text: str) -> str:
        """text with each noisy token, one that is not plain letters, as the likeliest word behind it; white space stays."""
        out = []
        for x in re.split(r"(\s+)", text):
            plain = x.strip(PUNCTUATION).lower()
            noisy = plain and not plain.isnumeric() and any(c.isalpha() for c in plain) and not (plain.isalpha() and not RUN.search(plain) and not any(c in LEET for c in plain))
            if noisy and plain not in self.words:
                if plain not in self.decoded:
                    if len(self.decoded) > self.LIMIT:
                        self.decoded.clear()
                    self.decoded[plain] = viterbi(plain, self.chars)
                x = x[: len(x) - len(x.lstrip(PUNCTUATION))] + self.decoded[plain] + x[len(x.rstrip(PUNCTUATION)) :]
            out.append(x)
        return "".join(out)

    def spaced(self, run: list[str]) -> list[tuple[str, float]]:
        """Lexicon words in a row of single letters: each start, longest first, left to right; where none starts, the shortest
        beginning that a stem knows."""
        found, at = [], 0
        while at < len(run):
            for n in range(min(self.longest, len(run) - at), 2, -1):
                x = "".join(run[at : at + n])
                if skeleton(x) in self.shapes and self.hit(x)[0] in self.words:
                    found.append(self.hit(x))
                    at += n - 1
                    break
            else:
                for n in range(STEMS[0] + 1, min(STEMS[-1] + 1, len(run) - at) + 1):
                    x = "".join(run[at : at + n])
                    if self.may_hold(x) and self.hit(x)[1]:
                        found.append(self.hit(x))
                        at += n - 1
                        break
            at += 1
        return found

    @staticmethod
    def evidence(found: list[tuple[str, float]], n: int) -> tuple[float, float, float]:
        total = sum(w for _, w in found)
        return 1.0, math.log1p(total), math.log1p(100 * total / max(1, n))

    def score(self, text: str) -> tuple[float, int, list[str]]:
        found, n = self.restored(text)
        x = sum(map(mul, self.curve, self.evidence(found, n)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), len(found), sorted({w for w, _ in found})


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> tuple[float, ...]:
    """Newton's method; each row counts times. Only slopes of 0 or more are allowed, as more evidence may not lower a score."""
    w = np.zeros(x.shape[1])
    keep = np.ones(x.shape[1], bool)
    while True:
        for _ in range(rounds):
            z = x[:, keep]
            p = 1 / (1 + np.exp(-np.clip(z @ w[keep], -30, 30)))
            h = (z * (times * p * (1 - p))[:, None]).T @ z + ridge * np.eye(keep.sum())
            w[keep] += np.linalg.solve(h, z.T @ (times * (y - p)) - ridge * w[keep])
        bad = (w[1:] < 0) & keep[1:]
        if not bad.any():
            return tuple(float(v) for v in w)
        keep[1:] &= ~bad
        w[:] = 0


COUNTS = "key string, toxic int, texts long, n double"


class TextCounts:
    """Of each word and stem, by label: how many texts hold it, and how often. Texts are counted some at a time, as numbers."""

    TOKENS = 1 << 17

    def __init__(self):
        self.tokens: dict[str, int] = {}
        self.keys: dict[str, int] = {}
        self.of: list[list[int]] = []  # the keys of each token
        self.texts, self.n = np.zeros((0, 2), np.int64), np.zeros((0, 2))
        self.totals: dict[int, tuple[int, int]] = {}
        self.held: list[tuple[np.ndarray, int]] = []
        self.room = self.TOKENS

    def token(self, t: str) -> int:
        found = self.tokens.get(t)
        if found is None:
            found = self.tokens[t] = len(self.of)
            plain = t.strip(PUNCTUATION)
            self.of.append([self.keys.setdefault(f, len(self.keys)) for f in features(plain, STEMS)] if len(plain) > 2 and plain.isalpha() else [])
        return found

    def add(self, text: str, toxic: int) -> None:
        tokens = text.lower().split()
        self.held.append((np.fromiter(map(self.token, tokens), np.int64, len(tokens)), toxic))
        a, m = self.totals.get(toxic, (0, 0))
        self.totals[toxic] = a + 1, m + len(tokens)
        self.room -= len(tokens)
        if self.room <= 0:
            self.count()

    def count(self) -> None:
        """Adds the texts held."""
        size = np.array([len(x) for x, _ in self.held], np.int64)
        toxic = np.array([x for _, x in self.held], np.int64)
        token = np.concatenate([np.empty(0, np.int64), *(x for x, _ in self.held)])
        self.held, self.room = [], self.TOKENS
        used, token = np.unique(token, return_inverse=True)
        code, n = np.unique(np.repeat(np.arange(len(size)), size) * max(1, len(used)) + token, return_counts=True)
        doc, token = code // max(1, len(used)), code % max(1, len(used))
        own = [self.of[i] for i in used.tolist()]
        many = np.array([len(x) for x in own], np.int64)
        flat, start = np.array([k for x in own for k in x], np.int64), np.cumsum(many) - many
        many = many[token]
        key = flat[np.repeat(start[token] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        code, at = np.unique(np.repeat(doc, many) * max(1, len(self.keys)) + key, return_inverse=True)
        n = np.bincount(at, weights=np.repeat(n, many), minlength=len(code))
        cell = code % max(1, len(self.keys)) * 2 + toxic[code // max(1, len(self.keys))]
        more = len(self.keys) - len(self.texts)
        self.texts, self.n = np.vstack((self.texts, np.zeros((more, 2), np.int64))), np.vstack((self.n, np.zeros((more, 2))))
        self.texts += np.bincount(cell, minlength=2 * len(self.texts)).reshape(-1, 2)
        self.n += np.bincount(cell, weights=n, minlength=2 * len(self.n)).reshape(-1, 2)

    def rows(self) -> pa.RecordBatch:
        """COUNTS of all that was added; a null key has the number of texts and of their words."""
        self.count()
        at, toxic = np.nonzero(self.texts)
        keys = pa.array(list(self.keys), pa.string()).take(pa.array(at))
        all_texts = [(x, *v) for x, v in self.totals.items()]
        columns = [pa.concat_arrays([keys, pa.nulls(len(all_texts), pa.string())])]
        for i, (have, kind) in enumerate(((toxic, np.int32), (self.texts[at, toxic], np.int64), (self.n[at, toxic], np.float64))):
            columns.append(pa.array(np.append(have, [x[i] for x in all_texts]).astype(kind)))
        return pa.RecordBatch.from_arrays(columns, names=["key", "toxic", "texts", "n"])


def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n) of words -> (gram, n): three signs in a row, START twice before a word and END after it, n for each word."""
    for b in batches:
        words = [START + START + w + END for w in b.column("key").to_pylist()]
        if not words:
            continue
        signs = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words])
        inside = np.ones(len(signs), bool)
        first = np.cumsum(size) - size
        inside[first] = inside[first + 1] = False
        at = np.flatnonzero(inside)
        code, row = np.unique(signs[at - 2] << 42 | signs[at - 1] << 21 | signs[at], return_inverse=True)
        n = np.bincount(row, weights=np.repeat(b.column("n").to_numpy(), size - 2))
        low = (1 << 21) - 1
        grams = [chr(c >> 42) + chr(c >> 21 & low) + chr(c & low) for c in code.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n, pa.float64())], names=["gram", "n"])


def shorter_grams(grams: dict[str, float]) -> Counter:
    """What char_grams() counts, from the trigrams alone."""
    out: Counter = Counter()
    for g, n in grams.items():
        for key in (g[2], "", g[1:], "1" + g[1], g, "2" + g[:2]):
            out[key] += n
    return out


def fit(docs: DataFrame, labels: DataFrame, min_texts: int = 3, odds: float = 3.0, z: float = 1.64, size: int = 2000) -> ToxicityModel:
    """Learns from all rows of docs(doc_id, text) that labels(doc_id, toxic) marks; callers leave out what is held out.

    A word or stem joins the lexicon if at least min_texts different toxic texts hold it and the lower end of the interval of z
    standard errors of its odds ratio is over odds. Equal texts count once. size bounds the lexicon to the most telling; what
    goes to the driver is bounded by it, by the trigrams of the alphabet and by the curve's steps. Rows whose label or text is null
    teach nothing; of several labels the largest counts. Labels and texts meet in a
    sorted join; neither is bounded.
    """
    spark = docs.sparkSession
    batch_limits(spark)
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(marked.hint("merge"), "doc_id")
    marked = marked.select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), F.xxhash64("text").alias("h"))
    marked = staged(marked.dropDuplicates(["h", "toxic"]), "toxicity-marked")
    release(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TextCounts()
        for b in batches:
            for t, x in zip(texts(b.column("text")), b.column("toxic").to_pylist(), strict=True):
                counts.add(t.decode("utf-8", "replace"), x)
                if len(counts.keys) > 1_000_000:
                    yield counts.rows()
                    counts = TextCounts()
        yield counts.rows()

    if_toxic = lambda c, x: F.sum(F.when(F.col("toxic") == x, F.col(c)).otherwise(0))
    counts = marked.select("text", "toxic").mapInArrow(run, COUNTS)
    counts = counts.groupBy("key").agg(if_toxic("texts", 1).alias("a"), if_toxic("texts", 0).alias("b"), if_toxic("n", 1).alias("na"), if_toxic("n", 0).alias("nb"))
    stem = F.col("key").startswith(START)
    counts = staged(counts.where(F.col("key").isNull() | ~stem | (F.col("a") > 0)), "toxicity-counts")
    all_texts = next(((r.a, r.b, r.na, r.nb) for r in counts.where("key is null").collect()), (0, 0, 0.0, 0.0))
    bad, good, words_bad, words_good = all_texts
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    low = F.log(a * (good + 1 - b) / ((bad + 1 - a) * b)) - z * F.sqrt(1 / a + 1 / b + 1 / (bad + 1 - a) + 1 / (good + 1 - b))
    best = counts.where(f"key is not null and a >= {min_texts}").withColumn("low", low).where(F.col("low") > math.log(odds)).orderBy(F.desc("low"), "key").limit(size).collect()
    lexicon = {r.key: max(0.1, math.log((r.na + 0.5) / (words_bad + 1)) - math.log((r.nb + 0.5) / (words_good + 1))) for r in best}
    grams = counts.where(~stem).select("key", (F.col("a") + F.col("b")).cast("double").alias("n")).mapInArrow(trigrams, "gram string, n double")
    grams = shorter_grams({r.gram: r.n for r in grams.groupBy("gram").agg(F.sum("n").alias("n")).collect()})
    whole = [r for r in best if not r.key.startswith(START)]
    for r in whole:  # the words that obfuscation aims at weigh as much as all others together
        char_grams(r.key, r.na * max(1.0, grams[""] / (8.0 * sum(x.na for x in whole))), grams)
    model = ToxicityModel(lexicon, dict(grams))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            rows = [scorer.evidence(*scorer.restored(x.decode("utf-8", "replace"))) for x in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())], names=["toxic", "x1", "x2"])

    # The curve needs only how many texts have each evidence, in steps of a hundredth.
    rows = marked.select("text", "toxic").mapInArrow(weigh, "toxic int, x1 double, x2 double")
    rows = rows.groupBy("toxic", F.round("x1", 2).alias("x1"), F.round("x2", 2).alias("x2")).count().collect()
    if not rows:
        return model
    rows = np.array(sorted((r.toxic, r.x1, r.x2, r["count"]) for r in rows))
    xy = np.column_stack((np.ones(len(rows)), rows[:, 1:3]))
    return ToxicityModel(lexicon, dict(grams), logistic(xy, rows[:, 0], rows[:, 3]))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, predicted, n_hits, hits (restored words, sorted).

    Null and empty texts score as texts without evidence; null ids pass through; repeated rows, and rows that share an id, are each
    scored by their own text, equal texts alike. Very long texts are scored whole. Other columns are not read; an empty table gives no
    rows. No shuffle. The model is bounded (see fit), so each task carries it.
    """
    batch_limits(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            rows = [scorer.score(x.decode("utf-8", "replace")) for x in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.float64()), pa.array([int(r[0] >= threshold) for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string()))],
                names=["doc_id", "score", "predicted", "n_hits", "hits"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, n_hits long, hits array<string>")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """docs with all its columns, whatever their names, less rows whose score reaches threshold. Null and empty texts have no evidence:
    they stay unless the curve alone is over threshold. Each row is judged by its own text; an empty table stays empty."""
    batch_limits(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda raw: [None if scorer.score(x.decode("utf-8", "replace"))[0] >= threshold else x for x in raw]

    return rewritten(docs, make)


def restored_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs(doc_id, text) -> doc_id, restored: the text with every noisy token decoded. Nulls stay null."""
    batch_limits(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            out = [None if x is None else scorer.restore(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(out, pa.string())], names=["doc_id", "restored"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, restored string")
