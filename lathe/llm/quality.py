"""Line-first quality rules.

Each line with a word is judged by rules for punctuation, navigation and boilerplate. Failing lines are removed; a document
that loses too much of its text, or that breaks a base rule on its whole text, is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lathe.llm.common import batch_limits, rewritten, texts

SYMBOLS = b"#*$%&|<>"
#: Phrases of licence, cookie, copyright and site lines, in lower case: fixed values, in English, French, German and Spanish.
BOILERPLATE = (
    "licensed under", "all rights reserved", "copyright", "cookie", "privacy policy", "terms of service", "terms of use",
    "click here", "subscribe", "sign up", "log in", "read more", "enable javascript", "permission is hereby granted",
    "as is\" basis", "without warrant", "share this", "powered by",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "lire la suite", "cliquez ici",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "weiterlesen", "hier klicken",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "condiciones de uso", "seguir leyendo", "haga clic",
)
#: Bytes that continue a character in UTF-8.
CONTINUED = bytes(range(0x80, 0xC0))


def characters(x: bytes) -> int:
    """Characters of x that are no white space."""
    return len(x.translate(None, CONTINUED + b" \t\n\r\x0b\x0c"))


@dataclass(frozen=True)
class QualityRules:
    """max_symbols: share of SYMBOLS in a line's word characters; a line of ASCII signs alone fails too. min_segments, max_segment_words: a navigation line has so many
    parts between bars of so few words on average. max_stutter: share of a line's words that only say the word before them
    again. max_lost: share of word characters that removed lines may hold."""

    max_symbols: float = 0.1
    min_segments: int = 3
    max_segment_words: float = 3.0
    max_stutter: float = 0.35
    stutter_words: int = 6
    max_lost: float = 0.5
    min_words: int = 10
    max_repeat_percent: int = 20

    def line_fails(self, line: bytes) -> str:
        """The name of the first rule that the line breaks, or an empty text."""
        chars = characters(line)
        if not chars:
            return ""
        bars = line.count(b"|") + line.count("»".encode()) + line.count("›".encode())
        if bars + 1 >= self.min_segments and len(line.split()) - bars <= self.max_segment_words * (bars + 1):
            return "navigation"
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        if symbols > self.max_symbols * chars or (line.isascii() and not ALNUM.search(line)):
            return "punctuation"
        if BOILER.search(line.lower()):
            return "boilerplate"
        words = line.split()
        if len(words) >= self.stutter_words and sum(map(eq, words, words[1:])) > self.max_stutter * len(words):
            return "stutter"
        return ""


ALNUM = re.compile(rb"[0-9A-Za-z]")
BOILER = re.compile("|".join(re.escape(x) for x in BOILERPLATE).encode())


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words inside n-word windows whose words occur twice or more in the list."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    key, kinds = flat, len(ids)
    size = 1
    while size < n:  # exact: a window's key is the rank of (shorter window, next word)
        key = key[:-1] * len(ids) + flat[size:]
        size += 1
        if size < n and kinds * len(ids) * len(ids) >= 2**62:
            uniq, key = np.unique(key, return_inverse=True)
            kinds = len(uniq)
        else:
            kinds *= len(ids)
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = counts[at] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(hit)] += hit
    edge[n : n + len(hit)] -= hit
    return int((np.cumsum(edge) > 0).sum())


def judged(text: bytes, rules: QualityRules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines removed, cleaned text."""
    words = text.split()
    stripped = b"".join(words)
    chars = len(stripped.decode("utf-8", "replace"))
    symbols = len(stripped) - len(stripped.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    dup = len(full) - len(set(full))
    repeat = repeated_words(words)
    failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
    verdicts = {x: rules.line_fails(x) for x in set(full)}
    bad = [x for x in full if verdicts[x]]
    lost = sum(map(characters, bad))
    kept = not failed and lost <= rules.max_lost * max(1, chars)
    clean = b"\n".join(x for x in lines if not verdicts.get(x)) if bad else text
    return len(words), chars, symbols, dup, repeat, failed, kept, Counter(verdicts[x] for x in bad), clean


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), text: bool = True) -> DataFrame:
    """docs(doc_id, text) -> a row each: counts, base_failed, kept, lines removed by each rule and, with text, the cleaned text.

    A null or empty text has no words, so it fails a base rule; a null doc_id passes through. Repeated rows, and rows that share an id,
    are each judged by their own text; very long texts are judged whole. An empty table gives an empty result; other columns of docs are
    not read. One pass, no shuffle.
    """
    batch_limits(docs.sparkSession)
    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "kept boolean, n_navigation long, n_punctuation long, n_boilerplate long, n_stutter long" + ", clean_text string" * text
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 4
        for b in batches:
            rows = [judged(x, rules) for x in texts(b.column("text"))]
            cols = [b.column("doc_id"), *([r[i] for r in rows] for i in range(7))]
            cols += [[r[7][k] for r in rows] for k in ("navigation", "punctuation", "boilerplate", "stutter")]
            out = [pa.array(c, t) if isinstance(c, list) else c.cast(t) for c, t in zip(cols, kinds, strict=True)]
            names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_navigation n_punctuation n_boilerplate n_stutter".split()
            if text:
                out.append(pa.array([r[8] for r in rows], pa.binary()).cast(pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """docs with all its columns, whatever their names: rejected rows go, failing lines are taken out of the others, and n_chars follows.
    Null and empty texts fail a base rule, so they go; each row is judged by its own text; an empty table stays empty."""
    batch_limits(docs.sparkSession)

    def decide(raw: list[bytes]) -> list[bytes | None]:
        out = []
        for x in raw:
            *_, kept, _, clean = judged(x, rules)
            out.append(clean if kept else None)
        return out

    return rewritten(docs, lambda: decide)
