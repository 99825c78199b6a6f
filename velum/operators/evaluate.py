"""Span metrics: one-to-one matching of gold and predicted spans, precision and recall, bootstrap, agreement."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MODES = ("exact", "partial", "untyped")


def match_spans(gold: DataFrame, predicted: DataFrame, mode: str = "exact", id_col: str = "id") -> DataFrame:
    """Per document: id, pairs (array of gold index, predicted index), gold, predicted.

    Greedy: gold spans in order, each takes the first free predicted span that
    agrees. Spans are grouped by document before they meet, so the work of one
    document stays in one row and no pair of documents is formed.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    side = lambda df, name: df.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "entity"))).alias(name))
    both = side(gold, "gold").join(side(predicted, "predicted"), id_col, "full")
    none = F.array().cast("array<struct<pos:int,start:int,end:int,entity:string>>")
    both = both.select(id_col, F.coalesce("gold", none).alias("gold"), F.coalesce("predicted", none).alias("predicted"))

    def agrees(g: Column, p: Column) -> Column:
        if mode == "exact":
            return (g["start"] == p["start"]) & (g["end"] == p["end"]) & (g["entity"] == p["entity"])
        over = (g["start"] < p["end"]) & (p["start"] < g["end"])
        return over & (g["entity"] == p["entity"]) if mode == "partial" else over

    def take(pairs, g):
        free = F.filter("predicted", lambda p: agrees(g, p) & ~F.exists(pairs, lambda x: x["p"] == p["pos"]))
        return F.when(F.size(free) > 0, F.array_append(pairs, F.struct(g["pos"].alias("g"), free[0]["pos"].alias("p")))).otherwise(pairs)

    pairs = F.aggregate("gold", F.array().cast("array<struct<g:int,p:int>>"), take)
    return both.select(id_col, pairs.alias("pairs"), "gold", "predicted")


def counts(matched: DataFrame, id_col: str = "id") -> DataFrame:
    """Per document and entity: tp, fp, fn. A hit and a miss count for the gold entity, a false alarm for the predicted one."""
    hit = F.transform(F.filter("gold", lambda g: F.exists("pairs", lambda x: x["g"] == g["pos"])), lambda g: F.struct(g["entity"].alias("entity"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn")))
    miss = F.transform(F.filter("gold", lambda g: ~F.exists("pairs", lambda x: x["g"] == g["pos"])), lambda g: F.struct(g["entity"].alias("entity"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")))
    alarm = F.transform(F.filter("predicted", lambda p: ~F.exists("pairs", lambda x: x["p"] == p["pos"])), lambda p: F.struct(p["entity"].alias("entity"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn")))
    rows = matched.select(id_col, F.explode(F.concat(hit, miss, alarm)).alias("x"))
    return rows.groupBy(id_col, "x.entity").agg(*(F.sum(f"x.{c}").cast("long").alias(c) for c in ("tp", "fp", "fn")))


def prf(df: DataFrame) -> DataFrame:
    """precision, recall and f1 of summed tp, fp, fn; 0 where undefined."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.select("*", p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"))


def scores(counted: DataFrame, documents: DataFrame, id_col: str = "id") -> DataFrame:
    """Overall, by entity and by difficulty in one pass (grouping sets)."""
    counted.join(documents.select(id_col, "difficulty"), id_col).createOrReplaceTempView("__velum_counted")
    sums = counted.sparkSession.sql("SELECT entity, difficulty, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM __velum_counted GROUP BY GROUPING SETS ((), (entity), (difficulty))")
    return prf(sums)


#: Documents that the exact bootstrap takes: it numbers them in one task and draws on the driver.
EXACT_DOCS = 5000


def bootstrap_f1(per_doc: DataFrame, n_boot: int = 1000, seed: int = 42, id_col: str = "id") -> tuple[float, float]:
    """95 % interval of F1 over resampled documents, by ranks int(.025 n) and int(.975 n) - 1 of the sorted replicates.

    Documents are numbered in id order; the draws are those of random.Random(seed),
    so small test sets reproduce exactly. The draws are joined as (replicate, number, times).
    """
    spark = per_doc.sparkSession
    if per_doc.select(id_col).distinct().count() > EXACT_DOCS:
        raise ValueError(f"over {EXACT_DOCS} documents: use poisson_bootstrap_f1")
    docs = per_doc.groupBy(id_col).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    numbered = docs.withColumn("no", F.row_number().over(W.orderBy(id_col)) - 1)
    n = numbered.count()
    if not n:
        return 0.0, 0.0
    r = random.Random(seed)
    drawn: dict[tuple[int, int], int] = {}
    for b in range(n_boot):
        for _ in range(n):
            k = (b, r.randrange(n))
            drawn[k] = drawn.get(k, 0) + 1
    draws = spark.createDataFrame([(b, k, t) for (b, k), t in drawn.items()], "b int, no int, times int")
    sums = draws.join(numbered, "no").groupBy("b").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in ("tp", "fp", "fn")))
    f = [x[0] for x in prf(sums).select("f1").orderBy("f1").collect()]  # n_boot rows
    return f[int(0.025 * n_boot)], f[int(0.975 * n_boot) - 1]


def poisson_bootstrap_f1(per_doc: DataFrame, n_boot: int = 200, seed: int = 42, id_col: str = "id") -> tuple[float, float]:
    """The same interval at scale: each document counts Poisson(1) times in each replicate, drawn from a hash of its id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col("b"), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    times, edge, total = F.lit(0), 0.36787944117144233, 0.36787944117144233
    for k in range(1, 9):
        times = F.when(u > total, k).otherwise(times)
        edge /= k
        total += edge
    docs = per_doc.groupBy(id_col).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    rows = docs.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("times", times)
    f = [x[0] for x in prf(rows.groupBy("b").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in ("tp", "fp", "fn")))).select("f1").orderBy("f1").collect()]
    return f[int(0.025 * n_boot)], f[int(0.975 * n_boot) - 1]


def char_kappa(a: DataFrame, b: DataFrame, documents: DataFrame, id_col: str = "id") -> DataFrame:
    """Cohen's kappa of two annotators over characters: one row (n, agreement, kappa). documents: id, n_chars.

    Spans are cut at all boundaries of either side, so work grows with spans and not with characters.
    """
    spans = a.select(id_col, "start", "end", F.col("entity").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(b.select(id_col, "start", "end", F.lit(None).cast("string").alias("a"), F.col("entity").alias("b")))
    per = documents.select(id_col, "n_chars").join(spans.groupBy(id_col).agg(F.collect_list(F.struct("start", "end", "a", "b")).alias("s")), id_col, "left")
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.col("n_chars").cast("int")), F.coalesce(F.transform("s", lambda x: x["start"]), F.array()), F.coalesce(F.transform("s", lambda x: x["end"]), F.array()))))
    seg = per.select("s", cuts.alias("c")).select("s", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("lo"), F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(0))).alias("hi"))).alias("x"))
    label = lambda side: F.coalesce(F.get(F.transform(F.filter("s", lambda y: y[side].isNotNull() & (y["start"] <= F.col("x.lo")) & (y["end"] > F.col("x.lo"))), lambda y: y[side]), F.lit(0)), F.lit("O"))
    table = seg.select(label("a").alias("la"), label("b").alias("lb"), (F.col("x.hi") - F.col("x.lo")).cast("long").alias("n")).groupBy("la", "lb").agg(F.sum("n").alias("n"))
    total = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("n")).otherwise(0)).alias("same"))
    left, right = table.groupBy("la").agg(F.sum("n").alias("na")), table.groupBy("lb").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("la") == F.col("lb")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both"))
    po, pe = F.col("same") / F.col("n"), F.col("both") / (F.col("n").cast("double") * F.col("n"))
    return total.join(chance).select("n", po.alias("agreement"), F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))
