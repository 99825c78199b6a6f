"""Vectorised text kernel: whole batches of texts as one array of code points.

A batch of texts is laid end to end as ``uint32`` code points. Character
classes come from one table lookup, piece boundaries from comparisons of
neighbouring classes, and piece hashes from sums of mixed (character, place)
values, so no Python loop runs per character or per word.
"""

from __future__ import annotations

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LANES = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)
_state: dict = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def classes() -> np.ndarray:
    """Class of each code point, as the split pattern of byte-level BPE sees it."""
    if "classes" not in _state:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                table[a : b + 1] = np.where(np.arange(a, b + 1) // 0x800 == 0x1B, OTHER, kind)
        _as_tiktoken(table)
        _state["classes"] = table
    return _state["classes"]


def _as_tiktoken(table: np.ndarray) -> None:
    """Code points that only the newer of the two Unicode versions assigns: as the tokenizer's own pattern sees them."""
    import unicodedata

    import public_tokenizers
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"'s": 256}
    own = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for cp in np.flatnonzero(table != OTHER).tolist():
        if unicodedata.category(c := chr(cp)) == "Cn" and own.encode_ordinary(c + "'s")[-1] != 256:
            table[cp] = OTHER


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, and the place where each begins (one more entry: the end)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, np.concatenate([[0], np.cumsum(lengths)])


def span_hash(cps: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of the code points in each [start, end), which are not empty, sorted and apart. Never 0.

    The sum over the span of a mixed value of (character, place in the span). Hashes of
    two lanes are independent. Equal contents have equal hashes wherever they stand; for
    different contents see ``Encoder.pieces``, which compares, or take two lanes.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    lengths = end - start
    offsets = np.cumsum(lengths) - lengths
    total = int(offsets[-1] + lengths[-1])
    whole = total == end[-1] - start[0]
    at = np.arange(total) - np.repeat(offsets, lengths)
    chars = cps[start[0] : end[-1]] if whole else cps[np.repeat(start, lengths) + at]
    with np.errstate(over="ignore"):
        x = (at.astype(np.uint64) << np.uint64(21) | chars) * _ODD + _LANES[lane]
        return _mixed(np.add.reduceat(_mixed(x), offsets) + lengths.astype(np.uint64) * _ODD) | np.uint64(1)


def bpe_pieces(cps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Starts of the pieces into which the byte-level BPE pattern splits each text."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    cls = classes()[cps]
    first = np.zeros(n, bool)
    first[begins[:-1][begins[:-1] < n]] = True
    start = first.copy()
    start[1:] |= cls[1:] != cls[:-1]
    # The last white space before a word opens a piece; a blank also joins the word.
    i = np.flatnonzero((cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~first[1:]) + 1
    start[i - 1] = True
    start[i] = cps[i - 1] != 32
    # 's 't 'm 'd 're 've 'll, where a piece begins with the apostrophe
    q = np.flatnonzero((cps == 39) & start)
    if len(q):
        at = lambda k: np.where(q + k < n, cps[np.minimum(q + k, n - 1)], 0)
        free = lambda k: (q + k < n) & ~first[np.minimum(q + k, n - 1)]
        c1, c2 = at(1), at(2)
        short = free(1) & np.isin(c1, [ord(c) for c in "stmd"])
        long = free(1) & free(2) & (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l")))
        for hit, k in ((short, 2), (long & ~short, 3)):
            p = q[hit]
            start[p + 1] = False
            start[(p + k)[p + k < n]] = True
    return np.flatnonzero(start)


class HashTable:
    """uint64 keys to 0, 1, 2, ... in order of arrival; vectorised open addressing."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._room(bits)

    def _room(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it isn't known."""
        out = np.full(len(h), -1, np.int32)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            got = self.keys[slot]
            want = h[todo]
            hit = got == want
            out[todo[hit]] = self.at[slot[hit]]
            on = ~hit & (got != 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray) -> None:
        """Keys that are distinct and new."""
        while (self.n + len(h)) * 2 > len(self.keys):
            keys, at = self.keys[self.keys != 0], self.at[self.keys != 0]
            self._room(self.bits + 2)
            self._put(keys, at)
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, at: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = self.keys[slot] == 0
            t, s = todo[free], slot[free]
            self.keys[s] = h[t]  # of several keys for one slot the last stays
            self.at[s] = at[t]
            on = self.keys[slot] != h[todo]
            todo, slot = todo[on], (slot[on] + 1) & self.mask


def expand(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a flat array of the rows ``which`` of a ragged array, and the lengths of these rows."""
    counts = offsets[which + 1] - offsets[which]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(offsets[which] - (ends - counts), counts) + np.arange(total), counts
