"""Operator 10: quality classifier by importance resampling.

Two generative models of hashed word n-grams (bags of unigrams and bigrams in
``BUCKETS`` buckets) are counted over the corpus: one over the documents that
are labelled good, one over all documents. A document's log importance weight
is the sum over its n-grams of log(target / raw). Documents are drawn without
replacement by Gumbel top-k: each gets the log of its weight plus standard
Gumbel noise (from a hash of its id and text, so a rerun draws the same), and
the k largest stay, which is sampling in proportion to the weights. Raw weights
grow with the length of a text, so they are tempered: raised to the power
``SHARPNESS`` / n-grams, the log weight per n-gram times ``SHARPNESS``.

``k`` is a parameter. Left out, it is the number of documents whose weight per
n-gram reaches a cut, which is set on the labelled documents that are held out
from the fit (half of them, by a hash). Of the cuts at the quantiles 1 -
``KEEP_GOOD`` to ``MAX_QUANTILE`` of the good ones, in steps of 0.001, the one
with the largest share of good kept less share of bad kept is taken; without
held-out bad documents it is the first. The k-th largest key is found exactly
by radix selection (counts of 2^12 bins a pass), never by a sort in one task.

Counts leave each task as one row of sums, so a hot word, source or group of
copies costs no more than any other. The models have ``BUCKETS`` entries each
whatever the corpus is; only they reach the driver.

Cases: a null or empty text has no n-grams and weight 0 per n-gram and in sum;
repeated rows are counted and drawn each, in the same way; without labelled
good documents everything is kept unless k is given; an empty table gives an
empty result; null ids have no label; extra columns are carried only if named
in ``keep``, whatever their names. Rows with the k-th key stay all. Texts are
read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.session import materialise, table
from velum.llm import arrow
from velum.llm import textkernel as tk

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Share of held-out good documents that the lowest cut keeps.
KEEP_GOOD = 0.999
#: Quantile of the held-out good documents at the highest cut.
MAX_QUANTILE = 0.1
#: Labelled documents that are used at most: a bound on the broadcast (about 6 MB).
MAX_LABELLED = 100_000
#: Importance weights are raised to this power over the number of n-grams before sampling, so that they are comparable at all lengths.
SHARPNESS = 100.0


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all unigrams and bigrams, the text that each belongs to); words are lower-cased and split at white space."""
    cps, begins = tk.code_points([t.lower() for t in texts])
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = tk.classes()[cps] != tk.SPACE
    first = np.zeros(n, bool)
    first[begins[:-1][begins[:-1] < n]] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (first | ~before))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:] & ~first[1:]
    end = np.flatnonzero(solid & ~after) + 1
    h = tk.span_hash(cps, start, end)
    owner = np.searchsorted(begins, start, side="right") - 1
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    two = np.flatnonzero(owner[1:] == owner[:-1])
    with np.errstate(over="ignore"):
        pairs = tk._mixed(h[two] * np.uint64(0xD6E8FEB86659FD93) + h[two + 1])
        single = tk._mixed(h + np.uint64(1))
    return np.concatenate([single >> shift, pairs >> shift]).astype(np.int64), np.concatenate([owner, owner[two]])


def fit(docs: DataFrame, good_col: str, text_col: str = "text") -> np.ndarray:
    """log(target / raw) of each bucket; ``good_col``: true for target documents. Counts cover all rows."""
    schema = "target array<long>, raw array<long>"

    def summed(each):
        counts = np.zeros((2, BUCKETS), np.int64)
        for more in each:
            counts += more
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([c.tolist()], pa.list_(pa.int64())) for c in counts], names=["target", "raw"])

    def count(batches):
        def each():
            for batch in batches:
                for part, texts in arrow.blocks(batch, "text"):
                    bucket, owner = ngram_buckets(texts)
                    good = np.array([bool(x) for x in part.column("good").to_pylist()], bool)
                    yield np.stack([np.bincount(bucket[good[owner]], minlength=BUCKETS), np.bincount(bucket, minlength=BUCKETS)])

        yield from summed(each())

    def add(batches):
        yield from summed(np.stack([np.asarray(b.column(i).flatten()).reshape(-1, BUCKETS).sum(axis=0) for i in range(2)]) for b in batches if len(b))

    # a row of sums for each task; these are added up in shuffle partitions before they become rows by bucket
    tasks = docs.select(F.col(text_col).alias("text"), F.col(good_col).alias("good")).mapInArrow(count, schema)
    rows = tasks.repartition(F.spark_partition_id()).mapInArrow(add, schema)
    flat = rows.select(F.posexplode(F.arrays_zip("target", "raw")).alias("bucket", "c"))
    sums = flat.groupBy("bucket").agg(F.sum("c.target").alias("target"), F.sum("c.raw").alias("raw")).collect()  # BUCKETS rows
    counts = np.zeros((2, BUCKETS))
    for r in sums:
        counts[:, r["bucket"]] = r["target"], r["raw"]
    if not counts[0].any():
        return np.zeros(BUCKETS)
    p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    return np.log(p[0]) - np.log(p[1])


def _held_out():
    """The labelled documents that set the threshold; the others fit the target model."""
    return F.pmod(F.xxhash64("id", F.lit(6)), F.lit(2)) == 0


def weigh(docs: DataFrame, ratio: np.ndarray, keep: tuple[str, ...], seed: int = 17) -> DataFrame:
    """``keep``, good, held, n_ngrams, log_weight (sum), per_ngram and draw (uniform in (0, 1), from seed, id and text). docs: id, text, good."""

    def run(texts: list[str]) -> list[pa.Array]:
        bucket, owner = ngram_buckets(texts)
        return [pa.array(np.bincount(owner, minlength=len(texts)), pa.int64()), pa.array(np.bincount(owner, ratio[bucket], len(texts)), pa.float64())]

    named = docs.select(*keep, "good", _held_out().alias("held"), "text", F.xxhash64(F.lit(seed), "id", "text").alias("h"))
    out = arrow.add_columns(named, "text", "n_ngrams long, log_weight double", run, [*keep, "good", "held", "h"])
    uniform = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return out.select(*keep, "good", "held", "n_ngrams", "log_weight", (F.col("log_weight") / F.greatest(F.col("n_ngrams"), F.lit(1))).alias("per_ngram"), uniform.alias("draw"))


def gumbel_key(per_ngram: F.Column, draw: F.Column) -> F.Column:
    """Log of the tempered importance weight plus standard Gumbel noise: the k largest keys are k draws without replacement, by weight."""
    return SHARPNESS * per_ngram - F.log(-F.log(draw))


def top_k_threshold(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest of a long column, exactly, by radix selection: counts of 4096 bins a pass; None if there are fewer rows."""
    u = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))  # its unsigned order is the key's order
    prefix, above, left = None, 64, k
    for shift in (52, 40, 28, 16, 4, 0):
        rows = df if prefix is None else df.where(F.shiftrightunsigned(u, above) == prefix)
        bins = rows.select(F.shiftrightunsigned(u, shift).alias("bin")).groupBy("bin").count().collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if left <= r["count"]:
                prefix, above = r["bin"], shift
                break
            left -= r["count"]
        else:
            return None
    return (prefix & (1 << 64) - 1) - (1 << 63)


def cut(scored: DataFrame) -> tuple[float, float, float | None] | None:
    """(threshold, share of held-out good kept, share of held-out bad kept); no bad: None as that share, no good: None.

    ``scored``: good, held, per_ngram. The cut with the best difference of the
    two shares, the lowest of equal ones: one outlier moves a quantile of the
    good by its own weight only, and costs what bad documents it lets in.
    """
    held = scored.where("held AND good IS NOT NULL").select("good", "per_ngram")
    steps = [1 - KEEP_GOOD + 0.001 * i for i in range(round((MAX_QUANTILE - 1 + KEEP_GOOD) / 0.001) + 1)]
    found = held.where("good").select(F.percentile_approx("per_ngram", steps, 100_000)).first()[0]
    if found is None:
        return None
    cuts = sorted(set(found))
    reached = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("per_ngram") >= c)).alias("reached")
    counts = np.zeros((2, len(cuts) + 1))
    for r in held.groupBy("good", reached).count().collect():  # 2 * (cuts + 1) rows at most
        counts[int(r["good"]), r["reached"]] = r["count"]
    kept = counts[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:] / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    best = int(np.argmax(kept[1] - kept[0])) if counts[0].any() else 0
    return cuts[best], float(kept[1, best]), float(kept[0, best]) if counts[0].any() else None


def resample(docs: DataFrame, good: DataFrame, keep: tuple[str, ...], text_col: str = "text", id_col: str = "doc_id", k: int | None = None, max_labelled: int = MAX_LABELLED, seed: int = 17) -> DataFrame:
    """The columns ``keep`` of ``docs`` as the struct ``row``, n_ngrams, log_weight, per_ngram, key, and kept: drawn among the k.

    k: how many rows to draw; None: as many as lie above the cut that labels choose.
    good: doc_id and ``is_good`` of labelled documents. At most about
    ``max_labelled`` of them, chosen by a hash of the id, are used, so the
    broadcast is bounded.
    """
    share = max_labelled / max(1, good.count())
    used = good.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).groupBy(F.col("doc_id").alias("id")).agg(F.max("is_good").alias("good"))
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled = plain.join(F.broadcast(used), "id", "left")
    ratio = fit(labelled.withColumn("target", F.col("good") & ~_held_out()), "target")
    narrow = len(keep) == 1  # else texts are weighed again at the end: rows are not written twice
    keyed = lambda df: df.withColumn("key", F.round(gumbel_key(F.col("per_ngram"), F.col("draw")) * 1e9).cast("long"))
    scored = keyed(materialise(weigh(labelled, ratio, ("row",) if narrow else (), seed), "weights"))
    if k is None:
        at = cut(scored)
        k = scored.where(F.col("per_ngram") >= at[0]).count() if at else None
    wanted = F.lit(True)
    if k is not None:
        threshold = top_k_threshold(scored, "key", k) if k else None
        wanted = F.lit(bool(k)) if threshold is None else F.col("key") >= threshold
    return (scored if narrow else keyed(weigh(labelled, ratio, ("row",), seed))).withColumn("kept", wanted)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull()).select("doc_id", (F.col("quality") == 1).alias("is_good"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ngrams, log_weight, per_ngram, kept of every document."""
    out = resample(table(spark, sf_dir, "documents"), labels(spark, sf_dir), ("doc_id",))
    return out.select("row.doc_id", "n_ngrams", "log_weight", "per_ngram", "kept")


def kept_documents(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the resampling keeps, unchanged."""
    return resample(docs, good, tuple(docs.columns)).where("kept").select(*(F.col("row")[c].alias(c) for c in docs.columns))
