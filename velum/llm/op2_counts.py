"""Operator 2: edit-aware token counts.

Per document the pre-token pieces are grouped into leaves of about ``LEAF``
pieces; a segment tree over the leaves sums their characters and tokens. An
edit finds its leaf by descending over the character sums, and only the leaves
that it touches, plus the boundary context that the split pattern can look at
(two characters), are split and encoded anew; their sums and those of their
ancestors are updated. Re-encoding ends at the first old leaf boundary that is
again a boundary of the new text: from there on the old pieces hold.

Edits of one document apply in order, each to the text that the one before
left. A block of documents advances edit by edit together, so that pieces are
split and encoded in batches.

Cases: a null or empty text has no tokens; a null or empty list of edits
changes nothing; positions and lengths are cut to the text, a null insert is
empty; repeated rows are edited each; an empty table gives an empty result;
extra columns are not carried. Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.functions.session import table
from velum.llm import arrow, bpe
from velum.llm import textkernel as tk

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LEAF, CONTEXT = 32, 2
EDITS = "array<struct<pos:long,n_delete:long,insert:string>>"


class SegmentTree:
    """Sums of characters and tokens over the leaves of one document."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1
        while self.size < len(chars):
            self.size *= 2
        self.n = len(chars)
        self.chars, self.tokens = ([0] * (2 * self.size) for _ in range(2))
        self.chars[self.size : self.size + self.n] = chars
        self.tokens[self.size : self.size + self.n] = tokens
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, pos: int) -> tuple[int, int]:
        """(leaf that holds character pos, where it starts); past the end: the last leaf with characters or 0."""
        if not self.chars[1]:
            return 0, 0
        pos = min(pos, self.chars[1] - 1)
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if pos >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def update(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        dc, dt = chars - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2

    def leaf_chars(self, leaf: int) -> int:
        return self.chars[self.size + leaf]

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size : self.size + self.n], self.tokens[self.size : self.size + self.n]


def leaves_of(texts: list[str], encoder: bpe.Encoder, upto: list[int] | None = None) -> list[tuple[list[int], list[int]]]:
    """Characters and tokens of each leaf of each text; upto: only of its pieces before this boundary (the rest is context)."""
    starts, cuts, row, begins = encoder.pieces(texts)
    counts = (encoder.offsets[1:] - encoder.offsets[:-1])[row]
    summed = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for k in range(len(texts)):
        a, b = int(cuts[k]), int(cuts[k + 1])
        stop = begins[k + 1] if upto is None else begins[k] + upto[k]
        b = a + int(np.searchsorted(starts[a:b], stop))
        at = np.arange(a, b, LEAF)
        ends = np.append(at[1:], b)[: len(at)]
        where = np.append(starts[a:b], stop)
        out.append(((where[ends - a] - where[at - a]).tolist(), (summed[ends] - summed[at]).tolist()))
    return out


class Document:
    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.text, self.tree, self.touched = text, SegmentTree(chars, tokens), 0

    def begin(self, pos: int, n_delete: int, insert: str) -> None:
        """Change the text; the leaves still are the old ones."""
        old = len(self.text)
        pos = min(max(pos, 0), old)
        end = min(pos + max(n_delete, 0), old)
        tree = self.tree
        self.first, self.start = tree.find(max(0, pos - CONTEXT - 1))
        while self.start > max(0, pos - CONTEXT) and self.first > 0:
            self.first -= 1
            self.start -= tree.leaf_chars(self.first)
        self.last, last_start = tree.find(end) if old else (-1, 0)
        self.stop = last_start + (tree.leaf_chars(self.last) if old else 0)  # end of the last touched leaf, old place
        self.shift = len(insert) - (end - pos)
        self.text = self.text[:pos] + insert + self.text[end:]

    def region(self) -> tuple[int, int]:
        """The characters to look at: up to the end of the leaf after the last touched one."""
        nxt, ahead = self.last + 1, 0
        while nxt < self.tree.n and ahead <= CONTEXT:
            ahead += self.tree.leaf_chars(nxt)
            nxt += 1
        return self.start, min(len(self.text), self.stop + self.shift + ahead)

    def settled(self, starts: np.ndarray) -> bool:
        """Is the end of the last touched leaf a boundary of the new pieces? starts: of the region's pieces, from 0."""
        if self.stop + self.shift >= len(self.text):
            return True
        want = self.stop + self.shift - self.start
        i = np.searchsorted(starts, want)
        return i < len(starts) and starts[i] == want

    def widen(self) -> None:
        while self.last + 1 < self.tree.n:
            self.last += 1
            more = self.tree.leaf_chars(self.last)
            self.stop += more
            if more:
                return

    def end(self, chars: list[int], tokens: list[int]) -> None:
        """The touched leaves are replaced; where more are needed, the tree is built anew."""
        self.touched += sum(chars)
        room = self.last - self.first + 1
        if len(chars) <= 2 * room:
            # as many leaves as there were: neighbours are joined
            per = [(sum(chars[i * len(chars) // room : (i + 1) * len(chars) // room]), sum(tokens[i * len(chars) // room : (i + 1) * len(chars) // room])) for i in range(room)]
            for i, (c, t) in enumerate(per):
                self.tree.update(self.first + i, c, t)
        else:
            c, t = self.tree.leaves()
            self.tree = SegmentTree(c[: self.first] + chars + c[self.last + 1 :], t[: self.first] + tokens + t[self.last + 1 :])


def apply_edits(documents: list[Document], edits: list[list[dict]], encoder: bpe.Encoder) -> None:
    """All edits of all documents; the n-th edits of all are done together."""
    for turn in range(max(map(len, edits), default=0)):
        todo = [d for d, e in zip(documents, edits) if turn < len(e)]
        for d, e in zip(documents, edits):
            if turn < len(e):
                d.begin(e[turn]["pos"] or 0, e[turn]["n_delete"] or 0, e[turn]["insert"] or "")
        done = []
        while todo:
            spans = [d.region() for d in todo]
            cps, begins = tk.code_points([d.text[a:b] for d, (a, b) in zip(todo, spans)])
            starts = tk.bpe_pieces(cps, begins)
            cuts = np.searchsorted(starts, begins)
            again = []
            for k, d in enumerate(todo):
                if d.settled(starts[cuts[k] : cuts[k + 1]] - begins[k]):
                    done.append(d)
                else:
                    d.widen()
                    again.append(d)
            todo = again
        spans = [d.region() for d in done]
        upto = [min(d.stop + d.shift, len(d.text)) - d.start for d in done]
        for d, (c, t) in zip(done, leaves_of([d.text[a:b] for d, (a, b) in zip(done, spans)], encoder, upto)):
            d.end(c, t)


def build(docs: DataFrame, keep: list[str], text_col: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """``keep`` and the text, with its leaves: leaf_chars, leaf_tokens (arrays). Their sum is the token count."""

    def run(texts):
        got = leaves_of(texts, bpe.replay_encoder(ranks_path)[0])
        return [pa.array(texts, pa.string()), *(pa.array([g[i] for g in got], pa.list_(pa.int32())) for i in (0, 1))]

    return arrow.add_columns(docs, text_col, "text string, leaf_chars array<int>, leaf_tokens array<int>", run, [c for c in keep if c != text_col])


def edit(trees: DataFrame, keep: list[str], edits_col: str = "edits", ranks_path: str = RANKS) -> DataFrame:
    """``keep`` and the edited text with its leaves, n_tokens, and chars_encoded: how many characters were encoded anew."""
    kept = [c for c in keep if c not in ("text", "leaf_chars", "leaf_tokens", "n_tokens", "chars_encoded")]
    schema = T.StructType([*(trees.schema[c] for c in kept), *T._parse_datatype_string("text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, chars_encoded long").fields])

    def run(batches):
        encoder, _ = bpe.replay_encoder(ranks_path)
        for batch in batches:
            for part, texts in arrow.blocks(batch, "text"):
                docs = [Document(t, c or [], n or []) for t, c, n in zip(texts, part.column("leaf_chars").to_pylist(), part.column("leaf_tokens").to_pylist())]
                apply_edits(docs, [e or [] for e in part.column("__edits").to_pylist()], encoder)
                leaves = [d.tree.leaves() for d in docs]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array([d.text for d in docs], pa.string()), *(pa.array([x[i] for x in leaves], pa.list_(pa.int32())) for i in (0, 1)), pa.array([d.tree.tokens[1] for d in docs], pa.int64()), pa.array([d.touched for d in docs], pa.int64())],
                    names=schema.names,
                )

    return trees.select(*kept, "text", "leaf_chars", "leaf_tokens", F.col(edits_col).cast(EDITS).alias("__edits")).mapInArrow(run, schema)


def sample_edits(text) -> F.Column:
    """Three edits of every text, by its length: an insertion, a deletion, a replacement at the end."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    one = lambda pos, n_delete, insert: F.struct(pos.cast("long").alias("pos"), F.lit(n_delete).cast("long").alias("n_delete"), F.lit(insert).alias("insert"))
    return F.array(one(F.floor(n / 3), 0, " [it's edited]\n"), one(F.floor(n / 2), 7, ""), one(F.greatest(n - 12, F.lit(0)), 5, "n't 2024 "))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited, chars_encoded of every document under sample_edits()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = build(docs, ["doc_id"])
    before = trees.withColumn("before", F.aggregate("leaf_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("edits", sample_edits(F.col("text")))
    after = edit(before, ["doc_id", "before"])
    return after.select("doc_id", F.col("before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.length("text").cast("long").alias("n_chars_edited"), "chars_encoded")
