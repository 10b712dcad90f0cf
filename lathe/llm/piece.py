"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Distinct words of a batch lie end to end in flat numpy arrays of symbols. In each round the smallest pair rank of every word is
found by a segmented minimum, all its leftmost non-overlapping pairs of that rank are merged at once, and the arrays are
compacted, until no word has a pair left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from lathe.llm.common import batch_limits, texts

SPACE = "▁"
#: A word is a run of blanks with what follows up to the next blank: merges cross no other place. A SPACE in a text is a blank too.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NONE = np.int64(2**62)


class PieceModel:
    """Pieces and scores of a SentencePiece BPE model with byte fallback, identity normalisation and a blank put in front."""

    LIMIT = 1 << 18

    def __init__(self, definition: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=definition)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.unknown = sp.unk_id()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.byte = np.full(256, self.unknown, np.int64)
        self.raw = [b""] * n
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.raw[i] = bytes([int(p[3:5], 16)])
            elif not sp.is_control(i):
                self.raw[i] = p.replace(SPACE, " ").encode()
        self.raw[self.unknown] = " ⁇ ".encode()
        # Symbols: pieces by id; signs that are no piece get numbers from n on, as they are met.
        pairs: dict[int, tuple[int, int]] = {}
        order = np.lexsort((np.arange(n), -self.score))
        rank = np.empty(n, np.int64)
        # Equal scores are one rank: then the leftmost pair comes first, as in the library.
        values = self.score[order]
        rank[order] = np.cumsum(np.concatenate(([0], np.diff(values) != 0)))
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = (int(rank[i]), i)
        keys = np.array(sorted(pairs), np.int64)
        self.keys = keys
        self.ranks = np.array([pairs[k][0] for k in keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in keys.tolist()], np.int64)
        self.n = n
        self.signs: dict[str, int] = {}
        self.cache: dict[str, tuple[bytes, int, bytes]] = {}

    def words(self, text: str) -> list[str]:
        return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def sign(self, c: str) -> int:
        """The symbol of a sign: its piece, or a number of its own from n on."""
        found = self.ids.get(c)
        if found is None:
            found = self.signs.setdefault(c, self.n + len(self.signs))
        return found

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after all merges, end to end, and the number of each symbol's word."""
        flat = "".join(words)
        table = {c: self.sign(c) for c in set(flat)}
        sym = np.fromiter(map(table.__getitem__, flat), np.int64, len(flat))
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            # Rank of the pair that begins at each symbol.
            key = np.full(len(sym), -1, np.int64)
            pair = (word[:-1] == word[1:]) & (sym[:-1] < self.n) & (sym[1:] < self.n)
            key[:-1][pair] = sym[:-1][pair] * self.n + sym[1:][pair]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == key
            rank = np.where(known, self.ranks[at], NONE)
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(sym)))
            over = np.repeat(least == NONE, sizes)
            if over.any():
                done.append((sym[over], word[over]))
                keep = ~over
                sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
                sizes, least = sizes[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, sizes)
            # Of hits in a row (as in aaa) every other one, from the left, is merged. Pairs of one rank are of one piece.
            near = hit.copy()
            near[1:] &= hit[:-1]
            near[0] = False
            near[1:] &= word[1:] == word[:-1]
            if near.any():
                index = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~near, index, 0))
                hit &= (index - begin) % 2 == 0
            where = np.flatnonzero(hit)
            sym[where] = self.made[at[where]]
            keep = np.ones(len(sym), bool)
            keep[where + 1] = False
            sym, word = sym[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; signs without a piece become their UTF-8 bytes."""
        sym, word = self.merged(words)
        names = {i: c for c, i in self.signs.items()}
        cuts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        strange = (sym >= self.n).any()
        ids = sym.tolist()
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = ids[a:b]
            if strange and max(own, default=0) >= self.n:
                own = [j for i in own for j in (self.byte[list(names[i].encode())].tolist() if i >= self.n else [i])]
            out.append(own)
        return out

    def learn(self, words: set[str]) -> None:
        """Puts new words into the cache: ids as decimal text, their number, and the bytes they decode to. A full cache keeps what is
        known of words."""
        if len(self.cache) > self.LIMIT:
            self.cache = {w: self.cache[w] for w in words & self.cache.keys()}
            self.signs.clear()
        new = list(words - self.cache.keys())
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            for w, ids in zip(part, self.word_ids(part), strict=True):
                self.cache[w] = b",".join([b"%d" % i for i in ids]), len(ids), b"".join([self.raw[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.word_ids(self.words(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """As the library: pieces' bytes, broken UTF-8 by replacement signs, and without the blank put in front."""
        return decoded(b"".join([self.raw[i] for i in ids]))


@lru_cache(maxsize=1)
def piece_model(definition: bytes) -> PieceModel:
    """The model, and the words it knows by now, for all tasks of a worker."""
    return PieceModel(definition)


def decoded(raw: bytes) -> str:
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256 (ids as decimals apart by commas), decoded_sha256.

    Null and empty texts have no ids; null ids pass through; repeated rows are each encoded. No shuffle: the model (bounded by
    its file) goes to each task, and each distinct word is merged once, as long as the bounded cache
    of a worker has it.
    """
    batch_limits(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(shared.value)
        for b in batches:
            cut = [pieces.words(t.decode("utf-8", "replace")) for t in texts(b.column("text"))]
            held: set[str] = set()
            held.update(*cut) if cut else None
            pieces.learn(held)
            out = []
            for words in cut:
                found = list(map(pieces.cache.__getitem__, words))
                ids = b",".join([x[0] for x in found])
                raw = decoded(b"".join([x[2] for x in found]))
                out.append((sum([x[1] for x in found]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw.encode()).hexdigest()))
            cols = [b.column("doc_id").cast(pa.int64()), *(pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
