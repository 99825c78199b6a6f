"""Sources of documents and findings, and text taken from HTML."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions import sqlx
from velum.functions.text import collapse_blanks
from velum.operators.detect import find_column

LABELS = {
    "CPF": "BR_CPF", "CNPJ": "BR_CNPJ", "BRAZIL_CPF_NUMBER": "BR_CPF", "BRAZIL_CNPJ_NUMBER": "BR_CNPJ", "BRAZIL_PHONE_NUMBER": "BR_TELEFONE", "BRAZIL_CEP_CODE": "BR_CEP",
    "BRAZIL_RG_NUMBER": "OTHER", "BRCPFNumber": "BR_CPF", "BRLegalEntityNumber": "BR_CNPJ", "PhoneNumber": "BR_TELEFONE", "Brazil CPF Number": "BR_CPF", "Brazil Legal Entity Number (CNPJ)": "BR_CNPJ", "CREDIT_CARD": "BR_CARTAO", "CREDIT_CARD_NUMBER": "BR_CARTAO", "PHONE_NUMBER": "BR_TELEFONE",
}
SPAN = "array<struct<start:int,end:int,entity:string>>"
DOCUMENT = f"id string, domain string, difficulty string, text string, spans {SPAN}"


def text_files(spark: SparkSession, path: str, max_chars: int | None = 50_000_000) -> DataFrame:
    """(path, text), a row for each file; a text over the limit is an error when it is read, never cut."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    if max_chars is None:
        return df
    whole = F.when(F.char_length("text") > max_chars, F.raise_error(F.concat(F.lit(f"over {max_chars} characters: "), F.col("path"))).cast("string")).otherwise(F.col("text"))
    return df.select("path", whole.alias("text"))


def from_string(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


def json_lines(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    return spark.read.schema(schema).json(path)


def score_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents named system__dataset.scores.json, with system and dataset from the name."""
    df = spark.read.option("multiLine", True).json(path).withColumn("__file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.(?:scores\.)?json$", 1))
    parts = F.split("__file", "__")
    return df.withColumn("system", parts[0]).withColumn("dataset", F.get(parts, F.lit(1))).drop("__file")


def label(kind: Column) -> Column:
    """A vendor's label as an entity id, OTHER if it isn't known."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[kind], F.when(kind.startswith("BR_"), kind), F.lit("OTHER"))


def findings_csv(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, entity, start, end from a CSV export with doc_id, sit_name, start, end."""
    df = spark.read.option("header", True).schema("doc_id string, sit_name string, start int, end int").csv(path)
    return df.select("doc_id", label(F.col("sit_name")).alias("entity"), "start", "end")


FINDINGS = "resourcesAffected struct<s3Object:struct<key:string>>, classificationDetails struct<result:struct<sensitiveData:array<struct<detections:array<struct<type:string,occurrences:struct<lineRanges:array<struct<startColumn:int,endColumn:int>>>>>>>>>"


def findings_json(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, entity, start, end from nested findings; columns there count from 1 and include the last."""
    return flatten_findings(spark.read.schema(FINDINGS).json(path))


def flatten_findings(df: DataFrame) -> DataFrame:
    one = df.select(F.regexp_extract("resourcesAffected.s3Object.key", r"([^/]+?)(?:\.txt)?$", 1).alias("doc_id"), F.explode("classificationDetails.result.sensitiveData").alias("d"))
    two = one.select("doc_id", F.explode("d.detections").alias("d")).select("doc_id", "d.type", F.explode("d.occurrences.lineRanges").alias("r"))
    return two.select("doc_id", label(F.col("type")).alias("entity"), (F.col("r.startColumn") - 1).alias("start"), F.col("r.endColumn").alias("end"))


def per_document(documents: DataFrame, findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``documents`` with ``found``: array of spans, empty where there are none."""
    grouped = findings.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity"))).alias("found"))
    return documents.join(grouped, id_col, "left").withColumn("found", F.coalesce("found", F.array().cast(SPAN)))


def paragraphs(files: DataFrame, text_col: str = "text", min_len: int = 200, max_len: int = 1200, drop_flagged: bool = False) -> DataFrame:
    """Paragraphs between blank lines, blanks collapsed, of min_len to max_len characters; drop_flagged: without any identifier."""
    kept = [c for c in files.columns if c != text_col]
    parts = files.select(*kept, F.posexplode(F.split(text_col, r"\n\s*\n")).alias("no", "raw"))
    flat = parts.select(*kept, "no", sqlx.column(collapse_blanks(sqlx.col("raw"))).alias("text")).where(F.char_length("text").between(min_len, max_len))
    return flat.where(F.size(find_column("text")) == 0) if drop_flagged else flat


class _Reader(HTMLParser):
    """Paragraphs of a page: block tags open one; struck-out text, scripts and styles are left out."""

    BLOCKS = frozenset("p div br li tr td th h1 h2 h3 h4 h5 h6 section article header footer blockquote table ul ol".split())
    HIDDEN = frozenset("script style head strike s del title".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.paragraphs, self.words, self.hidden = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden.append(tag)
        elif tag == "body":
            self.hidden = [t for t in self.hidden if t not in ("head", "title")]
        if tag in self.BLOCKS:
            self.close_paragraph()

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        if tag in self.BLOCKS:
            self.close_paragraph()

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)

    def close_paragraph(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.paragraphs.append(text)
        self.words = []


def read_html(html: str | None) -> str:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.close_paragraph()
    return "\n\n".join(reader.paragraphs)


def html_to_text(df: DataFrame, html_col: str = "html", out_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the readable text of each page, in Arrow batches (HTML has no JVM-side parser)."""

    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(read_html)

    kept = [c for c in df.columns if c not in (html_col, out_col)] if keep is None else keep
    return df.select(*kept, convert(html_col).alias(out_col))


def locate(df: DataFrame, id_col: str, text_col: str, needle_col: str, order_col: str) -> DataFrame:
    """Start of each needle in its text: the n-th row with one needle takes its n-th occurrence; null if there is none."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy(id_col, needle_col).orderBy(order_col))
    parts = rf"split(`{text_col}`, concat('\\Q', `{needle_col}`, '\\E'))"
    before = F.expr(f"array_join(slice({parts}, 1, __n), `{needle_col}`)")
    return df.withColumn("__n", nth).withColumn("start", F.when(F.expr(f"size({parts}) > __n"), F.char_length(before))).drop("__n")


def tolerant_json(raw: Column) -> Column:
    """Entities of a model's answer: the outermost braces, entries with a text; anything else gives an empty array."""
    parsed = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "entities array<struct<type:string,text:string>>")
    return F.filter(F.coalesce(parsed["entities"], F.array().cast("array<struct<type:string,text:string>>")), lambda e: F.coalesce(F.char_length(e["text"]) > 0, F.lit(False)))
