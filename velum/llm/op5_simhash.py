"""Operator 5: near-duplicate classes by SimHash and the May-Ozerov recursion.

Two documents are linked when the Jaccard similarity of their sets of five-word
shingles is 0.8 or more; a class is a connected component of links. Documents
with equal sets are one node from the start (aggregated, never paired). Each
node gets a 256-bit SimHash. The search for close fingerprints follows May and
Ozerov: a random filter keeps the nodes whose weight against a random pattern
is high on a random strip of coordinates, inside each such list a second
filter is applied on the remaining coordinates, and the small lists that result
are compared by brute force. Filters are repeated until a pair at the
similarity threshold shares a list with probability ``RECALL``; their number and
strength follow from the number of nodes (lists of about ``LIST_ROWS`` at 50,000).

Candidates are verified on the exact shingle sets, which are made of the texts
of the nodes in a pair only. To stay clear of all pairs within a group, the
first pass emits the ``LIMIT`` nearest candidates of each node in each list. The
second pass has no limit but compares different components only: in the lists
of the nodes that had more candidates, and in all rows of crowded lists, which
one group has made much longer than foreseen (the first pass compares those in
parts). Parts of one and the same component are never compared again.

Cases: words are runs of ASCII letters and digits and of non-ASCII characters
other than white space, lower-cased; a text of fewer than five words is one
shingle; a text without words stands for itself (null and empty texts are equal).
Repeated rows and ids are allowed: rows are tied to classes by their sets. An
empty table gives an empty result. ``class_id`` is the smallest doc_id of the
class (null ids count only if the class has no other). Texts are read whole.
Columns other than id and text don't matter to ``classes`` and stay as they are
in ``one_of_each``, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.session import drop_tables, materialise, table
from velum.llm import arrow
from velum.llm import textkernel as tk

WORDS, SIMILARITY, BITS, RECALL = 5, 0.8, 256, 0.99
LIST_ROWS, SEED, INNER, LIMIT = 800, 5, 0.7, 4
#: A list is crowded from so many times the foreseen length on; it is compared in parts of that length.
CROWDED, PART_ROWS = 4, 2048
#: Rows of a list of the first level, as foreseen, that one task holds; of longer ones, each group of their second lists is dealt apart.
OUTER_ROWS = 300_000
#: Hamming distance up to which candidates are verified: at similarity 0.8 the mean is 39 and the deviation 5.7; short sets scatter more.
NEAR, NEAR_SHORT, SHORT = 57, 78, 30
#: The same for the first half and the first quarter of the bits, with four deviations: what goes beyond is not looked at further.
HALF_NEAR, HALF_SHORT, QUARTER_NEAR, QUARTER_SHORT = 36, 44, 22, 27
#: Bytes of shingle sets that meet in one task, about.
SET_BYTES = 24 << 20
#: Edges that one task joins to components at most, and nodes that a task holds meanwhile.
EDGES, HELD = 300_000, 300_000
#: Largest filter (bits) of the documents whose sets are needed; a fuller one lets more through, and the join drops those.
FILTER_BITS = 1 << 27


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, sorted; an independent second hash of each; where each text's begin)."""
    cps, begins = tk.code_points([t.lower() for t in texts])
    n, k = len(cps), len(texts)
    ascii_word = (cps >= 48) & (cps <= 57) | (cps >= 97) & (cps <= 122)
    solid = np.where(cps < 128, ascii_word, tk.classes()[cps] != tk.SPACE) if n else np.zeros(0, bool)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    start = np.flatnonzero(solid & (first[:n] | ~before))
    end = np.flatnonzero(solid & (first[1:] | ~after)) + 1
    cuts = np.searchsorted(start, begins)
    counts = np.diff(cuts)
    owner = np.repeat(np.arange(k), counts)
    few = np.flatnonzero(counts < WORDS)
    whole = owner[: max(0, len(start) - WORDS + 1)] == owner[WORDS - 1 :]
    lanes = []
    with np.errstate(over="ignore"):
        for lane in range(2):
            words = tk.span_hash(cps, start, end, lane)
            five = np.zeros(len(whole), np.uint64)
            for j in range(WORDS if len(five) else 0):
                five = tk._mixed(five + words[j : len(words) - WORDS + 1 + j] + np.uint64(j))
            # few words: all of them at once; none: the raw text
            single = np.zeros(len(few), np.uint64)
            for i, t in enumerate(few.tolist()):
                h = np.array([counts[t] + 77], np.uint64)
                spans = words[cuts[t] : cuts[t + 1]] if counts[t] else tk.span_hash(cps, begins[t : t + 1], begins[t + 1 : t + 2], lane) ^ np.uint64(0xABCDEF) if begins[t + 1] > begins[t] else ()
                for w in spans:
                    h = tk._mixed(h + w)
                single[i] = h[0]
            lanes.append(np.concatenate([five[whole], single]))
    of = np.concatenate([owner[: len(whole)][whole], few])
    order = np.lexsort((lanes[0], of))
    h, g, of = lanes[0][order], lanes[1][order], of[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[fresh], g[fresh], np.searchsorted(of[fresh], np.arange(k + 1))


def signatures(h: np.ndarray, g: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The identity of each set, n x 2 uint64: sums over the two hashes, so 128 bits of the words themselves."""
    with np.errstate(over="ignore"):
        return np.stack([np.add.reduceat(tk._mixed(x + np.uint64(0x1234567)), cuts[:-1]) for x in (h, g)], axis=1) if len(cuts) > 1 else np.zeros((0, 2), np.uint64)


def fingerprints(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """SimHashes, n x 4 uint64."""
    n = len(cuts) - 1
    sums = np.zeros((n, BITS), np.int32)
    with np.errstate(over="ignore"):
        at = 0
        while at < n:  # about 64k shingles at once
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + 65536, side="right")) - 1)
            for c in range(4):
                bits = tk._mixed(h[cuts[at] : cuts[to]] + np.uint64(0x9E3779B9 * (c + 11)))
                ones = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1)
                sums[at:to, 64 * c : 64 * c + 64] = np.add.reduceat(ones, cuts[at:to] - cuts[at], axis=0, dtype=np.int32)
            at = to
    twice, size = 2 * sums, np.diff(cuts)[:, None]
    tie = (tk._mixed(np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(bool)
    bits = np.where(twice == size, tie, twice > size)
    return np.packbits(bits, axis=1).view(np.uint64).reshape(n, 4)


def _bytes(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    width = a.nbytes // max(1, len(a))
    return arrow.binary_array(np.arange(len(a) + 1) * width, a.view(np.uint8).ravel()) if len(a) else pa.array([], pa.binary())


def _from_bytes(column, width: int) -> np.ndarray:
    """Rows of a binary column, each of ``width`` 64-bit numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), np.uint64)
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64).reshape(-1, width)


def sign(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with sig (binary, the set's identity), fp (binary, SimHash) and n_shingles."""

    def run(texts):
        h, g, cuts = shingles(texts)
        return [_bytes(signatures(h, g, cuts)), _bytes(fingerprints(h, cuts)), pa.array(np.diff(cuts), pa.int64())]

    return arrow.add_columns(docs, text_col, "sig binary, fp binary, n_shingles long", run, keep)


def _normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def _quantile(p: float) -> float:
    low, high = -8.0, 8.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _normal_tail(mid) > p else (low, mid)
    return low


def both_pass(z: float, rho: float) -> float:
    """P(Y > z | X > z) for standard normals of correlation rho."""
    xs = np.linspace(z, z + 8, 2001)
    density = np.exp(-(xs**2) / 2)
    return float(sum(d * _normal_tail((z - rho * x) / math.sqrt(1 - rho * rho)) for x, d in zip(xs, density)) / density.sum())


class Filters:
    """The random filters of both levels. Their number follows from the number of nodes and the recall."""

    def __init__(self, n: int):
        self.rows = LIST_ROWS * max(0.5, math.sqrt(n / 50_000))  # lists lengthen slowly, or their number would
        share = min(1.0, self.rows / max(1, n))  # of the nodes that a list holds
        self.one = share >= 1
        level = math.sqrt(share)
        self.z = _quantile(level) if not self.one else -math.inf
        cosine = 2 * SIMILARITY / (1 + SIMILARITY)
        flips = math.acos(cosine) / math.pi
        both = 1.0 if self.one else both_pass(self.z, 1 - 2 * flips)
        # a pair shares some first filter Poisson(m1) times, each time a second one Poisson(INNER) times
        outer = math.log(1 / (1 - RECALL)) / (1 - math.exp(-INNER))
        self.outer = 1 if self.one else math.ceil(outer / (level * both))
        self.inner = 1 if self.one else math.ceil(INNER / (level * both))
        self.seed, self.crowded_rows = SEED, max(PART_ROWS, math.ceil(CROWDED * self.rows))
        self.outer_rows = OUTER_ROWS
        self.groups = min(self.inner, max(1, math.ceil(n * level / OUTER_ROWS)))

    def _drawn(self, a: int) -> tuple[np.random.Generator, np.ndarray, np.ndarray]:
        rng = np.random.default_rng([self.seed, a])
        strip = rng.permutation(BITS)
        return rng, strip, rng.integers(0, 2, BITS // 2).astype(np.float32) * 2 - 1

    def lists(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, row) of every list that a fingerprint is in."""
        if self.one or not len(fp):
            return np.zeros(len(fp), np.int64), np.arange(len(fp))
        x = np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1).astype(np.float32) * 2 - 1
        half, keys, rows = BITS // 2, [], []
        limit = np.float32(self.z * math.sqrt(half))
        for at in range(0, self.outer, 256):
            drawn = [self._drawn(a) for a in range(at, min(at + 256, self.outer))]
            first = np.zeros((BITS, len(drawn)), np.float32)  # patterns, 0 off their strip
            for k, (_, strip, pattern) in enumerate(drawn):
                first[strip[:half], k] = pattern
            hits = (x @ first > limit).T
            for k, (rng, strip, _) in enumerate(drawn):
                into = np.flatnonzero(hits[k])
                second = np.zeros((BITS, self.inner), np.float32)
                second[strip[half:]] = rng.integers(0, 2, (half, self.inner)).astype(np.float32) * 2 - 1
                r, b = np.nonzero(x[into] @ second > limit)
                keys.append((at + k) * self.inner + b)
                rows.append(into[r])
        return np.concatenate(keys).astype(np.int64), np.concatenate(rows)


def candidates(node: np.ndarray, comp: np.ndarray | None, limit: int | None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left rows, right rows of candidate pairs, rows that had more than ``limit``).

    node: n x 7, identity, SimHash and number of shingles. comp: pairs only of
    different ones. side: pairs only of rows with side 0 and rows with side 1.
    Rows are sorted by the size of their sets, so that only sizes within the
    similarity are compared at all.
    """
    order = np.argsort(node[:, 6], kind="stable")
    words, size = [np.ascontiguousarray(node[order, 2 + c]) for c in range(4)], node[order, 6].astype(np.int64)
    m, left, right, more = len(order), [], [], []
    low, high = np.searchsorted(size, SIMILARITY * size - 1e-9), np.searchsorted(size, size / SIMILARITY + 1e-9, side="right")
    at = 0
    while at < m:
        to = min(m, at + max(16, min(256, 2_000_000 // max(1, int(high[min(m, at + 256) - 1] - low[at])))))
        a, b = (int(low[at]) if limit is not None else at), int(high[to - 1])
        short = size[at] < SHORT
        d = np.bitwise_count(words[0][at:to, None] ^ words[0][None, a:b])
        r, k = np.nonzero(d <= (QUARTER_SHORT if short else QUARTER_NEAR))
        i, j, dist = at + r, a + k, d[r, k].astype(np.int16)
        ok = i < j if limit is None else i != j
        i, j, dist = i[ok], j[ok], dist[ok]
        for words_to, near, near_short in ((1, HALF_NEAR, HALF_SHORT), (2, NEAR, NEAR_SHORT), (3, NEAR, NEAR_SHORT)):
            dist = dist + np.bitwise_count(words[words_to][i] ^ words[words_to][j])
            ok = dist <= np.where(np.maximum(size[i], size[j]) < SHORT, near_short, near)
            i, j, dist = i[ok], j[ok], dist[ok]
        ok = np.minimum(size[i], size[j]) >= SIMILARITY * np.maximum(size[i], size[j]) - 1e-9
        i, j = order[i], order[j]
        if comp is not None:
            ok &= (comp[i] != comp[j]).any(axis=1)
        if side is not None:
            ok &= side[i] != side[j]
        i, j, dist = i[ok], j[ok], dist[ok]
        if limit is not None and len(i):
            by = np.lexsort((j, dist, i))
            i, j = i[by], j[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
            more.append(np.unique(i[rank >= limit]))
            i, j = i[rank < limit], j[rank < limit]
        left.append(i)
        right.append(j)
        at = to
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return cat(left), cat(right), cat(more)


_PAIRS = "a binary, b binary"


def _emit(sig: np.ndarray, left: np.ndarray, right: np.ndarray, more: np.ndarray) -> list[pa.RecordBatch]:
    a, b = sig[left], sig[right]
    swap = (a[:, 0] > b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1])
    a[swap], b[swap] = b[swap], a[swap].copy()
    out = [pa.RecordBatch.from_arrays([_bytes(a), _bytes(b)], names=["a", "b"])] if len(a) else []
    if len(more):
        out.append(pa.RecordBatch.from_arrays([_bytes(sig[more]), pa.nulls(len(more), pa.binary())], names=["a", "b"]))
    return out


#: Bits of a key that number the parts of a list.
_PART = 20


def _node(batch: pa.RecordBatch) -> np.ndarray:
    """n x 7: identity, SimHash and number of shingles."""
    return np.concatenate([_from_bytes(batch.column("sig"), 2), _from_bytes(batch.column("fp"), 4), np.asarray(batch.column("n_shingles")).astype(np.uint64)[:, None]], axis=1)


def _listed(nodes: DataFrame, filters: Filters, crowded: dict[int, int] | None = None) -> DataFrame:
    """A row for each node and list: key (the list), node (sig, fp, n_shingles) and, if ``nodes`` has it, comp.

    If ``nodes`` has the flag ``again``, the rows of crowded lists, and of the others only those flagged.
    """
    second = "again" in nodes.columns
    carried = ["comp"] if second else []

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                b = batch.slice(at, 4096)
                node = _node(b)
                keys, rows = filters.lists(node[:, 2:6].copy())
                if second:
                    wanted = np.isin(keys, list(crowded)) | np.asarray(b.column("again"))[rows]
                    keys, rows = keys[wanted], rows[wanted]
                for c in range(0, len(keys), 50_000):
                    r = rows[c : c + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[c : c + 50_000]), _bytes(node[r]), *(b.column(x).take(pa.array(r)) for x in carried)], names=["key", "node", *carried])

    return nodes.mapInArrow(run, "key long, node binary" + ", comp binary" * second)


def _dealt(nodes: DataFrame, filters: Filters, crowded: dict[int, int]) -> DataFrame:
    """Each node once for each list (or group) of the first level: key, node (sig, fp, n_shingles, a bit for each list of the second level).

    The key is negative. Crowded lists have rows and keys of their own: the list and the part of it.
    """
    words = -(-filters.inner // 64)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                node = _node(batch.slice(at, 4096))
                lists, rows = filters.lists(node[:, 2:6].copy())
                alone = np.isin(lists, list(crowded))
                many = np.array([crowded[k] for k in lists[alone].tolist()], np.uint64)
                with np.errstate(over="ignore"):  # other parts in each list
                    parts = (tk._mixed(node[rows[alone], 0] + lists[alone].astype(np.uint64)) % many).astype(np.int64)
                own = lists[alone] << _PART | parts
                outer, inner = np.divmod(lists[~alone], filters.inner)
                group, r = outer * filters.groups + inner % filters.groups, rows[~alone]
                order = np.argsort(group << 12 | r, kind="stable")
                group, r, inner = group[order], r[order], inner[order]
                fresh = np.ones(len(r), bool)
                fresh[1:] = (group[1:] != group[:-1]) | (r[1:] != r[:-1])
                begins = np.flatnonzero(fresh)
                bits = np.zeros((len(own) + len(begins), words), np.uint64)
                for w in range(words if len(begins) else 0):
                    bits[len(own) :, w] = np.bitwise_or.reduceat(np.where(inner >> 6 == w, np.uint64(1) << (inner & 63).astype(np.uint64), np.uint64(0)), begins)
                keys, r = np.concatenate([own, ~group[begins]]), np.concatenate([rows[alone], r[begins]])
                for c in range(0, len(keys), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[c : c + 50_000]), _bytes(np.concatenate([node[r[c : c + 50_000]], bits[c : c + 50_000]], axis=1))], names=["key", "node"])

    return nodes.mapInArrow(run, "key long, node binary")


def _crowded(nodes: DataFrame, filters: Filters, n: int) -> dict[int, int]:
    """Lists that a sample of 20,000 nodes, about, shows to be far longer than foreseen, and in how many parts to cut them.

    A balance of load only: rows of any list are compared. Only such lists reach the driver.
    """
    if filters.one:
        return {}
    p = min(1.0, 20_000 / max(1, n))
    sample = nodes.where(F.pmod(F.xxhash64("sig", F.lit(3)), F.lit(1 << 30)) < int(p * (1 << 30)) + 1)
    seen = _listed(sample, filters).groupBy("key").count().where(F.col("count") >= max(16, filters.crowded_rows * p))
    return {r["key"]: min(math.ceil(r["count"] / p / filters.crowded_rows) + 1, 1 << _PART) for r in seen.collect()}


def _search(nodes: DataFrame, filters: Filters, crowded: dict[int, int]) -> DataFrame:
    """The LIMIT nearest candidates (a, b) of each node in each part of a list; (a, null) for nodes that have more."""
    most, held_rows, limit, width = 4 * filters.crowded_rows, 2 * filters.outer_rows, LIMIT, 7 + -(-filters.inner // 64)

    def compared(key, chunks, torn):
        node = np.concatenate(chunks)
        every = range(filters.inner) if key < 0 else [None]
        for b in every:
            own = node[:, :7] if b is None else node[(node[:, 7 + (b >> 6)] >> np.uint64(b & 63) & np.uint64(1)).astype(bool), :7]
            for at in range(0, len(own), most):
                x = own[at : at + most]
                left, right, more = candidates(x, None, limit)
                # longer than the sample told: in pieces, and all its nodes go on
                yield from _emit(x[:, :2], left, right, np.arange(len(x)) if torn or len(own) > most else more)

    def part(batches):
        key, chunks, held, torn = None, [], 0, False
        for batch in batches:
            keys, node = np.asarray(batch.column("key")), _from_bytes(batch.column("node"), width)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a and keys[a] != key:
                    if chunks:
                        yield from compared(key, chunks, torn)
                    key, chunks, held, torn = int(keys[a]), [], 0, False
                chunks.append(node[a:b])
                held += b - a
                if held > held_rows:
                    torn = True
                    yield from compared(key, chunks, torn)
                    chunks, held = [], 0
        if chunks:
            yield from compared(key, chunks, torn)

    return _dealt(nodes, filters, crowded).repartition("key").sortWithinPartitions("key").mapInArrow(part, _PAIRS).distinct()


def _search_all(nodes: DataFrame, filters: Filters, crowded: dict[int, int], tables: list[str]) -> DataFrame:
    """All candidate pairs between different components, in lists of any size. nodes: with comp and again."""
    listed = materialise(_listed(nodes, filters, crowded), "lists", tables)
    counts = materialise(listed.groupBy("key", "comp").count(), "counts", tables)
    mixed = counts.groupBy("key").agg(F.count("*").alias("comps")).where("comps > 1").select("key")
    counts = counts.join(mixed, "key", "left_semi")
    # a component that crowds a list is cut into parts of its own; the others of a list share parts
    rows = F.lit(filters.crowded_rows)
    big = F.col("count") > rows
    shared = counts.where(~big).groupBy("key").agg(F.sum("count").alias("n")).select("key", F.ceil(F.col("n") / rows).cast("int").alias("rest_parts"))
    own = counts.where(big).select("key", "comp", F.ceil(F.col("count") / rows).cast("int").alias("own_parts"))
    empty = F.unhex(F.lit(""))
    parts = shared.select("key", empty.alias("owner"), F.explode(F.sequence(F.lit(0), F.col("rest_parts") - 1)).alias("no")).unionByName(own.select("key", F.col("comp").alias("owner"), F.explode(F.sequence(F.lit(0), F.col("own_parts") - 1)).alias("no")))
    p, q = parts.alias("p"), parts.alias("q")
    order = F.struct("p.owner", "p.no") <= F.struct("q.owner", "q.no")
    same_owner = (F.col("p.owner") == F.col("q.owner")) & (F.col("p.owner") != empty)
    grid = p.join(q, F.col("p.key") == F.col("q.key")).where(order & ~same_owner)
    grid = grid.select(F.col("p.key").alias("key"), F.struct("p.owner", "p.no").alias("x"), F.struct("q.owner", "q.no").alias("y"))
    rows = listed.join(mixed, "key", "left_semi").join(own, ["key", "comp"], "left").join(shared, "key", "left")
    n_parts = F.coalesce("own_parts", "rest_parts")
    owner = F.when(F.col("own_parts").isNotNull(), F.col("comp")).otherwise(empty).alias("owner")
    placed = rows.select("key", F.struct(owner, F.pmod(F.xxhash64("node", F.lit(8)), n_parts).cast("int").alias("no")).alias("at"), "node", "comp")
    sides = grid.select("key", F.col("x").alias("at"), "x", "y", F.lit(0).alias("side")).unionByName(grid.where(F.col("x") != F.col("y")).select("key", F.col("y").alias("at"), "x", "y", F.lit(1).alias("side")))
    cells = placed.join(sides, ["key", "at"]).select(F.xxhash64("key", "x", "y").alias("cell"), "side", "node", "comp")

    def compare(t: pa.Table) -> pa.Table:
        node, side = _from_bytes(t["node"], 7), np.asarray(t["side"])
        out = _emit(node[:, :2], *candidates(node, _from_bytes(t["comp"], 2), None, side if side.any() else None))
        return pa.Table.from_batches(out) if out else pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})

    return cells.groupBy("cell").applyInArrow(compare, _PAIRS).distinct()


def _verify(pairs: DataFrame, sets: DataFrame, tables: list[str]) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of at least SIMILARITY. sets: sig, n, s (binary, sorted uint64).

    Pairs meet by component of the candidate graph, many small ones in one cell of about SET_BYTES of sets, so a
    set travels once and not once for each of its pairs; a component beyond SET_BYTES is dealt into blocks, and its
    pairs into cells of two blocks.
    """
    families = materialise(components(pairs, tables), "families", tables)
    sized = materialise(families.join(sets.select("sig", "n"), "sig").groupBy("comp").agg(F.sum("n").alias("n")), "sized", tables)
    total = 8 * (sized.agg(F.sum("n")).first()[0] or 0)
    bins = max(1, -(-total // SET_BYTES))
    blocks = sized.select("comp", F.ceil(F.col("n") * 8 / F.lit(SET_BYTES)).cast("long").alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(21)), F.col("blocks"))
    low, high = F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.xxhash64("comp", low, high))
    dealt = pairs.join(families.withColumnRenamed("sig", "a"), "a").join(blocks, "comp").select(cell.alias("cell"), "a", "b")
    dealt = materialise(dealt, "dealt", tables)
    needed = dealt.select("cell", F.explode(F.array("a", "b")).alias("sig")).distinct().join(sets, "sig").select("cell", "sig", "s")

    def check(p: pa.Table, q: pa.Table) -> pa.Table:
        own = {k: np.frombuffer(v, np.uint64) for k, v in zip(q["sig"].to_pylist(), q["s"].to_pylist())}
        keep = []
        for a, b in zip(p["a"].to_pylist(), p["b"].to_pylist()):
            x, y = own[a], own[b]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            same = int((y[at] == x).sum())
            keep.append(same >= SIMILARITY * (len(x) + len(y) - same) - 1e-9)
        return p.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return dealt.groupBy("cell").cogroup(needed.toDF("at", "sig", "s").groupBy("at")).applyInArrow(check, _PAIRS)


def _forest(batches):
    """Edges (u, v) to stars (node, smallest node of its component among the edges seen); at most HELD nodes are held at once."""
    root: dict[bytes, bytes] = {}

    def find(x):
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def stars():
        pairs = [(x, y) for x in root if (y := find(x)) != x]
        for c in range(0, len(pairs), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs[c : c + 20_000]], pa.binary()) for i in range(2)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = find(root.setdefault(u, u) and u), find(root.setdefault(v, v) and v)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > 2 * HELD:
            yield from stars()
            root.clear()
    yield from stars()


def components(links: DataFrame, tables: list[str]) -> DataFrame:
    """(sig, comp): the smallest node of each linked node's component.

    Tasks join their own edges to stars; alternating large-star and small-star
    rounds follow until one task can hold what is left (EDGES), or nothing changes.
    """
    stars = "u binary, v binary"
    edges = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_forest, stars), "edges", tables)
    known = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] <= EDGES:
            edges = edges.coalesce(1).mapInArrow(_forest, stars)
            break
        if state == known:
            break
        known = state
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges", tables)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "edges", tables)
    edges = materialise(edges, "stars", tables)
    return edges.select(F.col("u").alias("sig"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("sig"), F.col("v").alias("comp")).distinct())


def _sets(plain: DataFrame, nodes: DataFrame, found: DataFrame, tables: list[str]) -> DataFrame:
    """sig, n, s: the shingle sets of all nodes that are in a pair.

    Texts are read where they are: a Bloom filter of bounded size over the ids of
    the documents that stand for these nodes tells which to look at, and what it
    lets through wrongly falls away in the join by identity.
    """
    needed = materialise(found.where("b IS NOT NULL").select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "needed", tables)
    bits = 1 << max(13, min(FILTER_BITS.bit_length() - 1, (16 * needed.count()).bit_length()))
    places = lambda h: F.array(*(F.pmod(F.xxhash64(h, F.lit(i)), F.lit(bits)) for i in range(2)))
    marks = nodes.join(needed, "sig", "left_semi").select(F.explode(places(F.xxhash64("doc_id"))).alias("p"))
    marks = marks.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[np.asarray(marks["word"])] = np.asarray(marks["bits"]).view(np.uint64)
    shared = plain.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column("p").flatten()).reshape(-1, 2)
            hit = (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).all(axis=1)
            for _, texts in arrow.blocks(batch.filter(pa.array(hit)), "text"):
                h, g, cuts = shingles(texts)
                yield pa.RecordBatch.from_arrays([_bytes(signatures(h, g, cuts)), arrow.binary_array(cuts * 8, h.view(np.uint8))], names=["sig", "s"])

    made = plain.select(places(F.xxhash64("doc_id")).alias("p"), "text").mapInArrow(run, "sig binary, s binary")
    one = made.join(needed, "sig", "left_semi").groupBy("sig").agg(F.first("s").alias("s"))
    return materialise(one.select("sig", (F.length("s") / 8).cast("long").alias("n"), "s"), "sets", tables)


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, sig; sig, class_id and the set of the class's first row as first_sig). Both are written tables."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tables: list[str] = []
    signed = materialise(sign(plain, ["doc_id"]), "signed", tables)
    nodes = materialise(signed.groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.first("n_shingles").alias("n_shingles")), "nodes", tables)
    n = nodes.count()
    if n > 1:
        filters = Filters(n)
        todo = nodes.select("sig", "fp", "n_shingles")
        crowded = _crowded(todo, filters, n)
        comps, links, more = _pass(plain, nodes, materialise(_search(todo, filters, crowded), "pairs", tables), None, tables)
        if crowded or not more.isEmpty():
            flagged = todo.join(comps, "sig", "left").join(more.withColumn("again", F.lit(True)), "sig", "left").select("sig", "fp", "n_shingles", F.coalesce("comp", "sig").alias("comp"), F.coalesce("again", F.lit(False)).alias("again"))
            comps, _, _ = _pass(plain, nodes, materialise(_search_all(flagged, filters, crowded, tables), "pairs", tables), links, tables)
    else:
        comps = spark.createDataFrame([], "sig binary, comp binary")
    named = nodes.join(comps, "sig", "left").select("sig", "doc_id", F.coalesce("comp", "sig").alias("comp"))
    first = named.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sig")).alias("first"))
    named = materialise(named.join(first, "comp").select("sig", F.col("first.doc_id").alias("class_id"), F.col("first.sig").alias("first_sig")), "classes")
    rows = materialise(signed.select("doc_id", "sig"), "rows")
    drop_tables(spark, tables)
    return rows, named


def _pass(plain: DataFrame, nodes: DataFrame, found: DataFrame, links: DataFrame | None, tables: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, all links so far, nodes with more candidates) after the candidates ``found``; what only this pass needs is dropped."""
    own: list[str] = []
    pairs = found.where("b IS NOT NULL")
    good = materialise(_verify(pairs, _sets(plain, nodes, found, own), own), "links", tables)
    links = good if links is None else links.unionByName(good)
    comps = materialise(components(links, own), "components", tables)
    drop_tables(plain.sparkSession, own)
    return comps, links, found.where("b IS NULL").select(F.col("a").alias("sig"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id (the class's smallest doc_id) of every document."""
    rows, named = classes(table(spark, sf_dir, "documents"))
    return rows.join(named, "sig").select("doc_id", "class_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class one row of the smallest doc_id, unchanged."""
    rows, named = classes(docs)
    first = (F.col("sig") == F.col("first_sig")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = rows.join(named, "sig").where(~first).select(F.col("doc_id").alias("__id"))
        return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")), "left_anti")
    # repeated ids: of the rows that carry one, those of the class's first set, once
    stay = named.where("sig = first_sig").select(F.col("class_id").alias("__id"))
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
    keyed = sign(kept.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("__t")), ["row"], "__t")
    firsts = named.where("sig = first_sig").select("sig").distinct()
    return keyed.join(firsts, "sig", "left_semi").groupBy("sig").agg(F.first("row").alias("row")).select("row.*")
