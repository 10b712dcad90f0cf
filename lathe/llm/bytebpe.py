"""Byte-level BPE ids from a tokenizer file, with each distinct chunk of text encoded once per task."""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

#: GPT-2's public pattern for what merges never cross.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space other than single blanks before a word and single line ends: such texts are encoded whole.
ODD = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]|[ \n][ \n]| $|^ $")
CHUNK = re.compile(r" ?[^ \n]+|\n")


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in the vocabulary: printable ones for themselves, others from 256 up, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in own}
    signs |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return signs


class ByteBPE:
    """ids() as the tokenizers library gives them, with special tokens' strings as ordinary text; ids_with_added() with each of the
    file's added tokens inside a text as its one id."""

    LIMIT = 1 << 19

    def __init__(self, definition: bytes):
        model = json.loads(definition)
        special = {x["content"] for x in model.get("added_tokens", ()) if x.get("special")}
        self.added = {x["content"]: np.uint32(x["id"]).tobytes() for x in model.get("added_tokens", ())}
        odd = [x["content"] for x in model.get("added_tokens", ()) if x.get("lstrip") or x.get("rstrip") or x.get("single_word")]
        if odd:
            raise ValueError(f"added tokens that take in or look at their surroundings are not supported: {odd}")
        # Where several begin at one place, the longest counts.
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        signs = byte_signs()
        ranks = {bytes(signs[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.encode = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.line_end = ranks[b"\n"]
        self.cache: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Encodes chunks in one call, apart by line ends."""
        ids = np.array(self.encode("\n".join(new)), np.uint32)
        cuts = np.flatnonzero(ids == self.line_end)
        starts, ends = np.append(0, cuts + 1) * 4, np.append(cuts, len(ids)) * 4
        raw = ids.tobytes()
        self.cache.update((w, raw[a:b]) for w, a, b in zip(new, starts.tolist(), ends.tolist(), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.cache) > self.LIMIT:
            self.cache.clear()
        cut = [None if ODD.search(t) else CHUNK.findall(t) for t in texts]
        new: set[str] = set()
        for chunks in cut:
            if chunks:
                new.update(chunks)
        new -= self.cache.keys()
        if "\n" in new:
            self.cache["\n"] = np.uint32(self.line_end).tobytes()
            new.discard("\n")
        if new:
            self._learn(list(new))
        get = self.cache.__getitem__
        return [np.array(self.encode(t), np.uint32).tobytes() if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]

    def ids_with_added(self, texts: list[str]) -> list[bytes]:
        """As ids(), but an added token is its own id, and what lies before and after it is encoded apart."""
        if self.cut is None or not any(a in t for a in self.added for t in texts):
            return self.ids(texts)
        parts = [self.cut.split(t) for t in texts]
        plain = iter(self.ids([x for p in parts for x in p[::2]]))
        return [b"".join(self.added[x] if i % 2 else next(plain) for i, x in enumerate(p)) for p in parts]
