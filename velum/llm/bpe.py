"""Byte-level BPE: corpus-level merge replay over an inverted index (operator 4's core)."""

from __future__ import annotations

import base64
import heapq

import numpy as np

from velum.llm import textkernel as tk

#: No rank.
NONE = np.iinfo(np.int32).max
#: Distinct pieces that a worker remembers before it begins anew.
MAX_PIECES = 600_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeTable:
    """Token bytes, and for pairs of tokens the rank of what they merge to."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        parts = [b""] * size
        for token, rank in ranks.items():
            parts[rank] = token
        self.token_bytes = parts
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.array(sorted(pairs), np.int64)
        self.keys, self.ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], NONE)


def replay(words: list[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Encode distinct words together: (flat ids, offsets).

    An inverted index holds, for every rank that some adjacent pair has, the
    places of these pairs. The lowest rank present is taken again and again
    and merged at the leftmost such place of each word; only the pairs with
    the two neighbours are ranked anew and filed. A word's other places of
    that rank are filed back, so each word sees its merges in exactly the
    order that a word-by-word encoder applies: lowest rank, then leftmost.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    tok = table.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    n = len(tok)
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    bounds = np.cumsum(lengths)
    nxt[bounds[lengths > 0] - 1] = -1
    prv[(bounds - lengths)[lengths > 0]] = -1
    alive = np.ones(n, bool)
    rank = np.full(n, NONE, np.int32)
    if n > 1:
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = table.rank(tok[inner], tok[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    places = np.flatnonzero(rank != NONE)
    places = places[np.argsort(rank[places], kind="stable")]
    if len(places):
        r = rank[places]
        cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
        for part in np.split(places, cuts):
            index[int(rank[part[0]])] = [part]
    heap = list(index)
    heapq.heapify(heap)

    def file(at: np.ndarray) -> None:
        at = at[rank[at] != NONE]
        if not len(at):
            return
        r = rank[at]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            k = int(r[a])
            if k in index:
                index[k].append(at[a:b])
            else:
                index[k] = [at[a:b]]
                heapq.heappush(heap, k)

    while heap:
        k = heapq.heappop(heap)
        filed = index.pop(k)
        at = filed[0] if len(filed) == 1 else np.concatenate(filed)
        at = at[rank[at] == k]
        if not len(at):
            continue
        if len(at) > 1:
            if len(filed) > 1:
                at = np.unique(at)
            own = word[at]
            lead = np.ones(len(at), bool)
            lead[1:] = own[1:] != own[:-1]
            if not lead.all():
                index[k] = [at[~lead]]
                heapq.heappush(heap, k)
                at = at[lead]
        gone = nxt[at]
        after = nxt[gone]
        tok[at], nxt[at], alive[gone], rank[gone] = k, after, False, NONE
        right = after >= 0
        prv[after[right]] = at[right]
        rank[at] = NONE
        a = at[right]
        if len(a):
            rank[a] = table.rank(tok[a], tok[after[right]])
        before = prv[at]
        left = before >= 0
        b = before[left]
        if len(b):
            rank[b] = table.rank(tok[b], tok[at[left]])
        file(np.concatenate([a, b]))
    ids = tok[alive]
    per_word = np.bincount(word[alive], minlength=len(words)) if n else np.zeros(len(words), np.int64)
    return ids, np.concatenate([[0], np.cumsum(per_word)]).astype(np.int64)


class Encoder:
    """Texts to ids by pieces: each distinct piece is encoded once and remembered with its characters.

    Pieces are looked up by hash and then compared character by character, so a
    piece never gets the ids of another one that shares its hash.
    """

    def __init__(self, encode_words):
        """encode_words: distinct pieces as bytes to (flat ids, offsets)."""
        self.encode_words = encode_words
        self._clear()

    def _clear(self) -> None:
        self.known = tk.HashTable()
        self.ids, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.chars, self.char_offsets = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Rows for these pieces, in their order."""
        spans = [cps[s:e] for s, e in zip(start.tolist(), end.tolist())]
        ids, offsets = self.encode_words([x.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace") for x in spans])
        self.ids = np.concatenate([self.ids, ids])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        self.chars = np.concatenate([self.chars, *spans])
        self.char_offsets = np.concatenate([self.char_offsets, self.char_offsets[-1] + np.cumsum(end - start)])

    def _strange(self, cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Pieces whose characters are not those of their row."""
        lengths = ends - starts
        same = self.char_offsets[row + 1] - self.char_offsets[row] == lengths
        fit = np.flatnonzero(same)
        where, counts = tk.expand(self.char_offsets, row[fit])
        own = cps if len(fit) == len(row) else cps[np.repeat(starts[fit] - (np.cumsum(counts) - counts), counts) + np.arange(len(where))]
        if len(where):
            same[fit] = np.logical_and.reduceat(self.chars[where] == own, np.cumsum(counts) - counts)
        return np.flatnonzero(~same)

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts of pieces, where each text's pieces begin, row of each piece in ids/offsets, begins of texts)."""
        cps, begins = tk.code_points(texts)
        starts = tk.bpe_pieces(cps, begins)
        ends = np.append(starts[1:], len(cps))[: len(starts)]
        h = tk.span_hash(cps, starts, ends)
        if self.known.n > MAX_PIECES:
            self._clear()
        row = self.known.find(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            at = new[first]
            self._learn(cps, starts[at], ends[at])
            self.known.add(keys)
            row = self.known.find(h)
        strange = self._strange(cps, starts, ends, row)
        if len(strange):  # each gets a row of its own, which no hash leads to
            row[strange] = self.known.n + np.arange(len(strange))
            self._learn(cps, starts[strange], ends[strange])
            self.known.n += len(strange)
        return starts, np.searchsorted(starts, begins), row, begins

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all texts, where each text's ids begin)."""
        _, cuts, row, _ = self.pieces(texts)
        where, counts = tk.expand(self.offsets, row)
        total = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[where], total[cuts]


_encoders: dict = {}


def replay_encoder(path: str) -> tuple[Encoder, MergeTable]:
    """This process's encoder for a rank file."""
    if path not in _encoders:
        table = MergeTable(load_ranks(path))
        _encoders[path] = Encoder(lambda words: replay(words, table)), table
    return _encoders[path]


def library_encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file, by the tokenizers library."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True

        def words_to_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            got = [x.ids for x in own.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
            return np.array([i for x in got for i in x], np.int32), offsets

        _encoders[path] = Encoder(words_to_ids)
    return _encoders[path]
