"""What reports and retrieval need around find: set comparisons, orders, top-k, best scores, store sizes, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class IngestionError(ValueError):
    """Texts that must not be stored."""


def entity_list(text: Column) -> Column:
    """'br_cpf, , BR_CEP' as ['BR_CPF', 'BR_CEP']: capitals, blanks and empty parts dropped; null: no entities."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.upper(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def only_on_one_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks (distinct), with ``side``: the symmetric difference."""
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def shared_ids(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that both annotators have."""
    return left.select(id_col).intersect(right.select(id_col))


def terms(text: Column) -> Column:
    """The distinct words of a text: runs of ASCII letters and digits of three or more, small letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 3))


def retrieve(docs: DataFrame, question: str, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k documents that share most words with the question; ties go to the smaller id. A top-k, no global sort."""
    shared = F.size(F.array_intersect(terms(F.coalesce(F.col(text_col), F.lit(""))), terms(F.lit(question)))).cast("long")
    return docs.select(id_col, shared.alias("shared")).where("shared > 0").orderBy(F.desc("shared"), id_col).limit(k)


def ordered_by(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """``df`` with ``place`` (from 1) of ``col`` in a fixed order; names that it lacks come last, by name."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(col))
    return df.withColumn("place", F.when(at > 0, at).otherwise(F.lit(len(order) + 1)).cast("long")).orderBy("place", col)


def best_per_mode(scores: DataFrame, by: str = "mode", score: str = "f1") -> DataFrame:
    """``scores`` with ``is_best``: the rows that reach the best score of their mode."""
    return scores.withColumn("is_best", F.col(score) == F.max(score).over(W.partitionBy(by)))


def latency(times: DataFrame, by: str, ms: str = "ms") -> DataFrame:
    """Exact median of the times of each system."""
    return times.groupBy(by).agg(F.median(ms).alias("median_ms"), F.count("*").alias("n"))


def file_counts(docs: DataFrame, file_col: str = "file") -> DataFrame:
    """Documents, spans and a digest of each file. docs: file, id, text, spans. The digest is over the sorted digests of the rows."""
    row = F.sha2(F.to_json(F.struct("id", "text", "spans")), 256)
    out = docs.groupBy(file_col).agg(F.count("*").alias("n_docs"), F.sum(F.size("spans")).alias("n_spans"), F.sort_array(F.collect_list(row)).alias("rows"))
    return out.select(file_col, "n_docs", "n_spans", F.sha2(F.array_join("rows", "\n"), 256).alias("sha256"))


def store_size(tokens: DataFrame, now: float) -> DataFrame:
    """One row: live tokens and those past their time."""
    live = F.col("expires_at") > now
    return tokens.agg(F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_expired"))


def insert_or_ignore(store: DataFrame, rows: DataFrame, key: str = "token") -> DataFrame:
    """``store`` with the rows whose key it lacks; of several rows with one key the smallest stays."""
    others = [c for c in store.columns if c != key]
    one = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("r")).select(key, *(F.col("r")[c].alias(c) for c in others))
    return store.unionByName(one.join(store.select(key), key, "left_anti").select(*store.columns))


def without_overlaps_from_right(spans: Column) -> Column:
    """Of spans (structs with start and end) those kept by a walk from the right that skips what reaches into a kept one; in position order."""
    from_right = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("s")))))
    empty = F.filter(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("s"))), lambda s: F.lit(False))
    kept = F.aggregate(from_right, empty, lambda a, s: F.when((F.size(a) > 0) & (s["b"] > F.get(a, F.size(a) - 1)["a"]), a).otherwise(F.array_append(a, s)))
    return F.transform(F.reverse(kept), lambda s: s["s"])


def gate_ingestion(decided: DataFrame, quarantine: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows to hold back) of a decided table; without ``quarantine`` a row to hold back is an error."""
    passed, held = decided.where("allowed"), decided.where(~F.col("allowed"))
    if not quarantine and (n := held.count()):
        raise IngestionError(f"{n} documents may not be stored")
    return passed, held


def gate_answers(answers: DataFrame, leaks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Answers before they leave: those with a residual match are dropped (``leaks``: the result of mask.residual)."""
    return answers.join(leaks.select(id_col).distinct(), id_col, "left_anti")


def write_text(masked: DataFrame, path: str, col: str = "masked") -> None:
    """One line for each row, line feeds inside a text as they are; null texts as empty ones."""
    masked.select(F.coalesce(F.col(col), F.lit("")).alias("value")).write.text(path)


def write_corpus(docs: DataFrame, path: str, seed: int | None = None) -> DataFrame:
    """JSON lines in ``path``/data by file, and the manifest (file_counts and the seed) in ``path``/manifest; returns the manifest."""
    docs.write.partitionBy("file").json(f"{path}/data")
    manifest = file_counts(docs).withColumn("seed", F.lit(seed).cast("long"))
    manifest.write.json(f"{path}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).json(f"{path}/manifest")


def write_csv(table: DataFrame, path: str) -> None:
    table.write.option("header", True).csv(path)
