"""Operator 1: approximate nearest neighbours by adaptive dimension scan.

Index: unit vectors are assigned to the nearest of L centroids, which k-means
fits on a bounded sample; every row is indexed. Lists of any size are cut into
parts of about ``PART_ROWS`` rows. Search: a query is sent to the ``n_probe``
nearest lists; in each part the vectors, rotated by one random orthogonal
matrix, are scanned in blocks of ``COLUMNS`` dimensions. After each block a
hypothesis test compares the partial distance, scaled to all dimensions, with
the query's bound, and abandons a candidate whose distance exceeds the bound
with high confidence (``EPSILON``). Survivors are scored on the original vectors
in double precision.

The bound tightens in rounds. First a query goes to its nearest lists (one in
``FIRST``), under the distance of the k-th nearest row of other ids in the
sample. Then it goes to the rest of its lists, under the smaller of that and
the k-th distance found. A query that has fewer than k by then, as happens when
its bound came from lists that it didn't probe, is sent to all lists, unbounded.

``n_probe`` is calibrated on the sample: the fewest lists that hold
``TARGET`` of the true neighbours of held-out sample vectors. Measured recall
is in the README and asserted in the tests.

Cases: vectors that are null, empty, zero, hold null or non-finite components,
or differ in length from most take no part; neither do rows without an id; a
row is no candidate for a query of its own id; rows that repeat an id are
candidates each, and as queries one, with the smallest of their vectors; ties
go to the smaller id; an
empty table, or one without queries, gives an empty result; extra columns are
not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from velum.functions.session import materialise, table

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 16 << 20
ROWS_PER_LIST, PART_ROWS, PART_QUERIES = 1000, 4096, 1024
COLUMNS, EPSILON, TARGET, SEED, FIRST = 16, 2.1, 0.985, 7, 4


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


class Index:
    """What the driver fits on the sample and every task gets: a few MB, whatever the table holds."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, n_rows: int, k: int):
        rng = np.random.default_rng(SEED)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        n, self.dim = unit.shape
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        n_lists = int(max(1, min(n_rows // ROWS_PER_LIST, n // 8)))
        self.centroids = unit[rng.permutation(n)[:n_lists]]
        for _ in range(10):
            near = np.argmax(unit @ self.centroids.T, axis=1)
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, near, unit)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            self.centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-300), self.centroids)
        self.bounding, self.bounding_ids = unit[:4096], ids[:4096]
        held = unit[: min(n, 400)]
        scores = held @ unit.T
        np.put_along_axis(scores, np.arange(len(held))[:, None], -np.inf, axis=1)
        top = np.argsort(-scores, axis=1)[:, : min(k, n - 1)]
        owner = np.argmax(unit @ self.centroids.T, axis=1)
        place = np.argsort(np.argsort(-(held @ self.centroids.T), axis=1), axis=1)
        ranks = np.sort(place[np.arange(len(held))[:, None], owner[top]].ravel())
        self.n_probe = int(ranks[min(len(ranks) - 1, int(TARGET * len(ranks)))]) + 1 if len(ranks) else n_lists

    def lists(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first."""
        scores = unit @ self.centroids.T
        n = min(n, scores.shape[1])
        some = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(scores, some, axis=1), axis=1), axis=1)

    def bounds(self, unit: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Squared distance to the k-th nearest row of the sample that has another id."""
        if len(self.bounding) < k:
            return np.full(len(unit), np.inf)
        scores = unit @ self.bounding.T
        scores[ids[:, None] == self.bounding_ids[None, :]] = -np.inf
        scores = np.partition(scores, len(self.bounding) - k, axis=1)[:, len(self.bounding) - k]
        return np.maximum(2 - 2 * scores, 0) * (1 + 1e-9) + 1e-12


def scan(index: Index, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k nearest found in one part for each query; original vectors in, column blocks inside."""
    nx, nq = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    rx, rq = (x / nx[:, None]) @ index.rotation, (q / nq[:, None]) @ index.rotation
    d, c = index.dim, min(COLUMNS, index.dim)
    part = (rq[:, :c] ** 2).sum(1)[:, None] + (rx[:, :c] ** 2).sum(1)[None, :] - 2 * rq[:, :c] @ rx[:, :c].T
    limit = lambda seen: bound if seen >= d else bound * (seen / d) * (1 + EPSILON / np.sqrt(seen)) ** 2
    qi, xi = np.nonzero((part <= limit(c)[:, None] + 1e-9) & (q_ids[:, None] != ids[None, :]))
    so_far, seen = part[qi, xi], c
    while seen < d and len(qi):
        to = min(seen + COLUMNS, d)
        so_far = so_far + ((rq[qi, seen:to] - rx[xi, seen:to]) ** 2).sum(1)
        seen = to
        on = so_far <= limit(seen)[qi] + 1e-9
        qi, xi, so_far = qi[on], xi[on], so_far[on]
    score = np.einsum("ij,ij->i", q[qi], x[xi]) / (nq[qi] * nx[xi])
    order = np.lexsort((ids[xi], -score, qi))
    qi, xi, score = qi[order], xi[order], score[order]
    first = np.searchsorted(qi, qi, side="left")
    top = np.arange(len(qi)) - first < k
    return qi[top], xi[top], score[top]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def search(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``df`` by cosine for each row of ``queries``."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = valid_vectors(df, id_col, vector_col).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return empty
    dim, n_rows = sizes
    rows, asked = (valid_vectors(t, id_col, vector_col).where(F.size("v") == dim) for t in (df, queries))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    most = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < int(min(1.0, most / n_rows) * (1 << 30)))
    sample = drawn.select("v", "id").limit(2 * most).collect()  # limit: only against a flood of repeated ids
    if len(sample) < 2:
        sample = rows.select("v", "id").limit(most).collect()
    index = Index(np.array([r[0] for r in sample], np.float64), np.array([r[1] for r in sample], np.int64), n_rows, k)
    first = -(-index.n_probe // FIRST)

    def assign(batches):
        for b in batches:
            if len(b):
                x = _matrix(b.column("v"), dim)
                own = index.lists(x / np.linalg.norm(x, axis=1, keepdims=True), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(own, pa.int32())], names=["id", "v", "list"])

    probe_schema = "id long, v array<double>, bound double, list int, later boolean"

    def probe(every: bool):
        def run(batches):
            for b in batches:
                if len(b):
                    unit = _matrix(b.column("v"), dim)
                    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                    lists = index.lists(unit, len(index.centroids) if every else index.n_probe)
                    at = np.repeat(np.arange(len(b)), lists.shape[1])
                    bound = np.full(len(b), np.inf) if every else index.bounds(unit, np.asarray(b.column("id")), k)
                    later = np.tile(np.arange(lists.shape[1]) >= first, len(b))
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), b.column("v").take(pa.array(at)), pa.array(bound[at]), pa.array(lists.ravel(), pa.int32()), pa.array(later)], names=["id", "v", "bound", "list", "later"])

        return run

    listed = materialise(rows.mapInArrow(assign, "id long, v array<double>, list int"), "lists")
    probes = materialise(asked.mapInArrow(probe(False), probe_schema), "probes")
    parts = materialise(listed.groupBy("list").count().select("list", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts")), "parts")
    own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    keys = ["list", "part", "q_part"]

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not (len(a) and len(b)):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, q_ids = a["id"].to_numpy(), b["id"].to_numpy()
        qi, xi, score = scan(index, _matrix(a["v"], dim), ids, _matrix(b["v"], dim), q_ids, b["bound"].to_numpy(), k)
        return pa.Table.from_arrays([pa.array(q_ids[qi]), pa.array(ids[xi]), pa.array(score)], names=names)

    def found_in(some: DataFrame, name: str) -> DataFrame:
        q_parts = some.groupBy("list").count().select("list", F.ceil(F.col("count") / PART_QUERIES).cast("int").alias("q_parts"))
        grid = F.broadcast(parts.join(q_parts, "list"))  # a row for each list: sample rows / 8 at most
        left = listed.join(grid, "list").select("id", "v", "list", own(F.col("parts"), 1).alias("part"), every(F.col("q_parts")).alias("q_part"))
        right = some.join(grid, "list").select("id", "v", "bound", "list", every(F.col("parts")).alias("part"), own(F.col("q_parts"), 2).alias("q_part"))
        pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, "query_id long, vec_id long, score double")
        return materialise(best(pairs), name)

    def best(pairs: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    some = ["query_id", "vec_id", "score"]
    found = found_in(probes.where(~F.col("later")), "near")
    if index.n_probe > first:
        reached = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), (F.greatest(2 - 2 * F.min("score"), F.lit(0.0)) * (1 + 1e-9) + 1e-12).alias("at"))
        rest = probes.where("later").join(reached, "id", "left").withColumn("bound", F.when(F.col("n") == k, F.least("bound", "at")).otherwise(F.col("bound")))
        found = materialise(best(found.select(some).unionByName(found_in(rest.drop("n", "at"), "far").select(some))), "found")
    full = found.groupBy("query_id").count().where(F.col("count") >= k)
    short = asked.join(full.select(F.col("query_id").alias("id")), "id", "left_anti")
    if n_rows > 1 and not short.isEmpty():
        whole = found_in(short.mapInArrow(probe(True), probe_schema), "whole")
        kept = found.join(whole.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score")
        found = kept.unionByName(whole)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all rows for every row of ``embeddings`` whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0), 5)
