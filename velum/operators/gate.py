"""Release gates and the scan report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.operators.detect import check_score, find, with_matches
from velum.operators.registry import entities as registered


class BlockedError(ValueError):
    """Documents that must not pass; ``kinds`` has what was found, never a value."""

    def __init__(self, n: int, kinds: list[str]):
        super().__init__(f"{n} documents blocked: {', '.join(kinds)}")
        self.n, self.kinds = n, kinds


def decide(df: DataFrame, text_col: str = "text", min_score: float = 0.0, on_suspect: str = "block", entities=None) -> DataFrame:
    """``df`` with allowed, blocked_by (array of matches), checked_entities and reason. Suspects block whatever their score."""
    if on_suspect not in ("block", "allow"):
        raise ValueError(f"on_suspect is 'block' or 'allow', not {on_suspect!r}")
    check_score(min_score)
    checked = sorted(e.id for e in registered(entities))
    found = with_matches(df, text_col, "__matches", entities=entities, report_invalid=True)
    blocks = F.filter("__matches", lambda m: (m["valid_dv"] & (m["score"] >= min_score)) | (~m["valid_dv"] & F.lit(on_suspect == "block")))
    out = found.select(*df.columns, F.coalesce(blocks, F.array()).alias("blocked_by"))
    kinds = F.array_sort(F.array_distinct(F.transform("blocked_by", lambda m: m["entity"])))
    return out.select(*df.columns, (F.size("blocked_by") == 0).alias("allowed"), "blocked_by", F.array(*map(F.lit, checked)).alias("checked_entities"), F.concat_ws(", ", kinds).alias("reason"))


def require_clean(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``df`` if every text is allowed, else BlockedError."""
    blocked = decide(df, text_col, **options).where(~F.col("allowed"))
    n, kinds = blocked.agg(F.count("*"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("blocked_by", lambda m: m["entity"])))))).first()
    if n:
        raise BlockedError(n, kinds)
    return df


@dataclass
class Scan:
    """The texts are read for the report when it is read, and once more for the counts when the first of them is asked for."""

    report: DataFrame
    found: DataFrame
    suspects_fail: bool

    @cached_property
    def counts(self) -> tuple[int, int]:
        return tuple(self.found.agg(F.count_if("valid_dv"), F.count_if(~F.col("valid_dv"))).first())

    @property
    def n_valid(self) -> int:
        return self.counts[0]

    @property
    def n_suspects(self) -> int:
        return self.counts[1]

    @property
    def exit_code(self) -> int:
        return self.code(self.suspects_fail)

    def code(self, suspects_fail: bool) -> int:
        return int(bool(self.n_valid or (self.n_suspects and suspects_fail)))


def scan(df: DataFrame, text_col: str = "text", threshold: float = 0.0, suspects: bool = False, fail_on_suspect: bool = False, show_values: bool = False, max_chars: int | None = 50_000_000, **options) -> Scan:
    """Report and gate. The threshold and the display options never change the exit code: 1 if anything valid is found
    (or a suspect, when they are asked to count), else 0."""
    check_score(threshold)
    found = find(df, text_col, report_invalid=True, max_chars=max_chars, **options)
    report = found.where((F.col("score") >= threshold) | ~F.col("valid_dv"))
    if not suspects:
        report = report.where("valid_dv")
    if not show_values:
        report = report.drop("value")
    return Scan(report, found, suspects or fail_on_suspect)


def report_lines(found: DataFrame, show_values: bool = False) -> DataFrame:
    """A line of fixed columns for each match; hidden values appear as stars."""
    value = F.col("value") if show_values else F.repeat(F.lit("*"), F.char_length("value"))
    return found.select(F.format_string("%-20s %7d %7d %5.2f  %s", "entity", "start", "end", "score", value).alias("line"))


def report_json(found: DataFrame, show_values: bool = False) -> DataFrame:
    cols = [c for c in found.columns if show_values or c != "value"]
    return found.select(F.to_json(F.struct(*cols)).alias("line"))


def exposure(found: DataFrame, by: list[str], id_col: str = "doc_id") -> DataFrame:
    """Matches and documents by rollup of ``by`` and entity; no values."""
    return found.rollup(*by, "entity").agg(F.count("*").alias("n_matches"), F.countDistinct(id_col).alias("n_docs"))
