"""A corpus pipeline: quality rules, quality classifier, near-dedup, PII pseudonyms, packing.

Each stage is (name, function of (spark, docs, sf_dir)); ``run`` applies them to
``documents``, each on the written result of the one before. All but the last
return the columns of ``documents``.

Cases: a null text counts as an empty one, which the quality rules reject; repeated
rows are copies, of which near_dedup leaves one; rows that share an id with different
texts are judged each; an empty table gives an empty result; other columns of
``documents``, whatever their names, are carried to the stage before packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velum.functions.session import drop_tables, materialise, scratch, table
from velum.llm import op5_simhash, op6_rules, op8_pii, op9_packing, op10_classifier


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return op6_rules.kept_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling doesn't draw go."""
    return op10_classifier.kept_documents(docs, op10_classifier.labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return op5_simhash.one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become pseudonyms."""
    return op8_pii.safe_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return op9_packing.pack_documents(docs)


STAGES = [(f.__name__, f) for f in (quality_rules, quality_classifier, near_dedup, pii, packing)]

#: Expectation-maximisation, trained models and connected components have no SQL form here; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's input and its own tables are dropped once its result is written."""
    docs, earlier = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        written: list[str] = []
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name, written)
        drop_tables(spark, earlier)
        earlier = written
    return STAGES[-1][1](spark, docs, sf_dir)
