"""Operator 6 [native]: quality rules joined by weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a document. The votes
of all documents are counted by vote pattern (3^rules patterns at most, summed
before the shuffle), expectation-maximisation over these counts estimates for
each rule how often it is right on good and on bad documents and the share of
good documents, and a document is kept when its posterior probability of being
good reaches ``keep_from``. Only the pattern counts reach the driver; the
estimates return as literals of a log-odds expression.

Everything runs in DataFrame expressions. Repeated 5-word windows are found
inside the row: windows are hashed to 64 bits, and only texts with a repeated
hash pay for the sort that counts the covered words (two different windows of
one text of n words share a hash with probability below n^2 / 2^65).

Cases: a null or empty text has zero counts and fails the base rules; repeated
rows get the same verdict; an empty table gives an empty result; extra columns
of any name are carried if named in ``keep``. Texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.session import materialise, table

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 5
KEEP_FROM = 0.5
ROUNDS = 50
#: The most good documents that a rule may blame, and the fewest bad ones that it must (shares).
FALSE_ALARMS, CATCHES = 0.02, 0.05


def _windows(words: Column) -> Column:
    """Hash of the window that begins at each word (``words``: hashes)."""
    # word by word: slice() would copy each window
    made = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(F.size(words) >= WINDOW, made).otherwise(F.array().cast("array<bigint>"))


def _places(windows: Column) -> Column:
    """Places of the windows whose hash occurs twice or more, in order."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.array_sort(F.flatten(F.transform(F.array(pairs), lambda p: F.transform(F.filter(p, lambda x, k: F.get(p, k - 1)["h"].eqNullSafe(x["h"]) | F.get(p, k + 1)["h"].eqNullSafe(x["h"])), lambda x: x["i"]))))


def _union(places: Column) -> Column:
    """How many words the windows at these places cover."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last")),
        lambda a: a["sum"],
    )


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` as a struct ``row``, and the counts of each whole text as a struct ``m``; a row for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"))
    # inline() of one struct keeps a step's results, which a mere projection would compute anew at each use
    step = lambda df, **made: df.select(*df.columns, F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))
    df = step(df, split=F.split(text, BLANKS))
    df = step(
        df,
        words=F.transform(F.filter("split", lambda w: w != ""), lambda w: F.xxhash64(w)),
        lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        word_chars=F.length(F.array_join("split", "")),
        n_symbols=F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        n_letters=F.length(F.regexp_replace(text, r"[^\p{L}]+", "")),
    ).drop("text", "split")
    df = step(df, windows=_windows(F.col("words")), n_words=F.size("words"), n_distinct=F.size(F.array_distinct("words")), n_lines=F.size("lines"), n_dup_lines=F.size("lines") - F.size(F.array_distinct("lines"))).drop("words", "lines")
    repeated = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _union(_places(F.col("windows")))).otherwise(0)
    df = step(df, n_repeat_words=repeated)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letters")
    return df.select("row", F.struct(*(F.col(n).cast("long").alias(n) for n in names)).alias("m"))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(m: Column) -> dict[str, Column]:
    """The rules; ratios compare by multiplication, so empty texts need no division."""
    n = m["n_words"]
    return {
        "length": _vote(n >= 50, n < 10),
        "word_length": _vote((m["word_chars"] >= 3 * n) & (m["word_chars"] <= 10 * n) & (n > 0), (m["word_chars"] < 2 * n) | (m["word_chars"] > 15 * n)),
        "symbols": _vote(20 * m["n_symbols"] < n, 3 * m["n_symbols"] > n),
        "letters": _vote(10 * m["n_letters"] >= 8 * m["word_chars"], 10 * m["n_letters"] < 7 * m["word_chars"]),
        "duplicate_lines": _vote((m["n_lines"] >= 3) & (20 * m["n_dup_lines"] <= m["n_lines"]), 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
        "repeats": _vote(20 * m["n_repeat_words"] <= n, 5 * m["n_repeat_words"] > n),
        "variety": _vote((n >= 20) & (10 * m["n_distinct"] >= 3 * n), (n >= 50) & (20 * m["n_distinct"] < n)),
    }


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents, and for each rule (P(bad vote | good), P(bad vote | bad)) where it votes, from counted vote patterns.

    A rule stays what it is meant to be: of the documents on which it votes it
    may blame at most ``FALSE_ALARMS`` of the good ones and must blame at
    least ``CATCHES`` of the bad ones. An abstention is no evidence.
    """
    k = len(patterns[0][0]) if patterns else 0
    share, p = 0.85, [(0.005, 0.25)] * k
    patterns, total = sorted(patterns), sum(c for _, c in patterns)
    for _ in range(rounds if total else 0):
        good = [c * posterior(v, share, p) for v, c in patterns]
        share = min(max(sum(good) / total, 0.01), 0.99)
        for j in range(k):
            own = [(v[j], c, g) for (v, c), g in zip(patterns, good) if v[j]]
            alarm = (sum(g for x, _, g in own if x < 0) + 0.005) / (sum(g for _, _, g in own) + 1)
            catch = (sum(c - g for x, c, g in own if x < 0) + 0.25) / (sum(c - g for _, c, g in own) + 1)
            p[j] = (min(max(alarm, 1e-4), FALSE_ALARMS), min(max(catch, CATCHES), 0.95))
    return share, p


def log_odds(share: float, p: list[tuple[float, float]]) -> tuple[float, list[dict]]:
    """Prior log-odds of good, and what each vote of each rule adds."""
    return math.log(share / (1 - share)), [{-1: math.log(a / b), 0: 0.0, 1: math.log((1 - a) / (1 - b))} for a, b in p]


def posterior(v: tuple[int, ...], share: float, p: list[tuple[float, float]]) -> float:
    prior, adds = log_odds(share, p)
    return 1 / (1 + math.exp(-(prior + sum(adds[j][x] for j, x in enumerate(v)))))


def judge(measured: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """``measured`` (read twice: a written table, or measured again) with base_failed, quality (posterior) and kept."""
    rules = votes(F.col("m"))
    counted = measured.groupBy(*(v.alias(n) for n, v in rules.items())).count().collect()
    prior, adds = log_odds(*expectation_maximisation([(tuple(r[:-1]), r[-1]) for r in counted] or [((0,) * len(rules), 0)]))
    z = F.lit(prior)
    for v, add in zip(rules.values(), adds):
        z = z + F.when(v > 0, add[1]).when(v < 0, add[-1]).otherwise(add[0])
    failed = base_failed(F.col("m"))
    return measured.select("*", failed.alias("base_failed"), (1 / (1 + F.exp(-z))).alias("quality"), (~failed & (z >= math.log(keep_from / (1 - keep_from)))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept (and quality) of every document."""
    judged = judge(materialise(measure(table(spark, sf_dir, "documents")), "rules"))
    return judged.select("row.doc_id", *(f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept", "quality")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    cols = tuple(docs.columns)
    # a copy of the rows is written, well packed, as measuring them again for the verdict costs far more
    return judge(materialise(measure(docs, keep=cols), "rules", codec="zstd")).where("kept").select("row.*")
