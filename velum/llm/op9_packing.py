"""Operator 9: best-fit packing of token sequences under several capacities.

What an item needs is a vector: its tokens, one document, and its attention
cost (tokens squared). All three follow from its length, so the plan needs
only the histogram of lengths, which has at most ``capacity`` entries however
many documents there are. ``plan`` walks the lengths from long to short and
puts each on the open bins (kept in groups of equal content) that satisfy
every capacity and have the largest weighted dot product of need and residual,
or the smallest weighted residual norm. The plan's rows (at most a few for
each length and group) are broadcast; every piece finds its place from its
length and its number among the pieces of that length. These numbers are
counted in salted parts, so one length, source or group of copies may hold any
share of the rows.

Cases: a null or empty text is one piece of one token (id 0 alone); repeated
rows are packed each; an empty table gives an empty result; extra columns are
not carried, whatever their names. Only texts longer than the capacity are
cut, the first piece taking the remainder.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from velum.functions.session import materialise, table
from velum.llm import arrow, bpe

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
#: Documents that a sequence takes at most, and the weights of tokens, documents and attention cost in the choice of a bin.
MAX_DOCS, WEIGHTS = 128, (1.0, 0.1, 0.1)
PART_ROWS = 20_000


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, and the ids if asked for."""
    schema = f"piece int, start long, length long, ids_crc32 long{', ids array<int>' if with_ids else ''}"
    from pyspark.sql import types as T

    whole = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string(schema).fields])

    def run(batches):
        encoder = bpe.library_encoder(tokenizer)
        for batch in batches:
            for part, texts in arrow.blocks(batch, "text"):
                flat, cuts = encoder.encode(texts)
                lengths = np.diff(cuts) + 1
                # id 0 closes each document
                ids = np.full(int(lengths.sum()), END_ID, np.uint32)
                ends = np.cumsum(lengths)
                body = np.ones(len(ids), bool)
                body[ends - 1] = False
                ids[body] = flat
                raw, rows, no, start, size, crc, out = memoryview(ids.tobytes()), [], [], [], [], [], []
                for k, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist())):
                    begin, at = end - n, 0
                    upto, j = (n - 1) % capacity + 1, 0
                    while at < n:
                        rows.append(k), no.append(j), start.append(at), size.append(upto - at)
                        crc.append(zlib.crc32(raw[4 * (begin + at) : 4 * (begin + upto)]))
                        if with_ids:
                            out.append(ids[begin + at : begin + upto].astype(np.int32))
                        at, upto, j = upto, upto + capacity, j + 1
                columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
                if with_ids:
                    columns.append(pa.array(out, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=whole.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, whole)


def plan(counts: dict[int, int], capacity: int = 2048, max_docs: int | None = MAX_DOCS, max_attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """(length, first number, how many, first bin, offset): where the pieces of a length go.

    Pieces numbered first .. first+many-1 of that length go to as many bins
    from the first one on. ``rule`` "dot" takes the open bins of the largest
    weighted dot product of need and residual (both as shares of the
    capacities), "norm" those of the smallest weighted norm of what would be
    left. Of bins that are equal in this the oldest is taken. Weights of
    (1, 0, 0) make "norm" plain best fit by tokens. No document limit: as many
    as there are tokens; no attention limit: the square of the capacity, which
    a piece of full length needs. Whatever the counts, at most two groups of
    bins for each length begin, and each is taken up again once for each
    document that a bin can take.
    """
    caps = np.array([capacity, max_docs or capacity, max_attention or capacity**2], np.float64)
    w = np.asarray(weights, np.float64)
    rest = np.zeros((0, 3))  # residual capacities of each group of open bins
    groups: list[tuple[int, int]] = []  # first bin and number of bins
    out, bins = [], 0
    for length in sorted(counts, reverse=True):
        todo, number = counts[length], 0
        need = np.array([length, 1.0, float(length) ** 2])
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {caps.tolist()}")
        while todo:
            left = rest - need
            fits = np.flatnonzero((left >= 0).all(axis=1))
            if len(fits):
                if rule == "dot":
                    score = -((rest[fits] / caps) * (need / caps) * w).sum(axis=1)
                elif rule == "norm":
                    score = (((left[fits] / caps) ** 2) * w).sum(axis=1)
                else:
                    raise ValueError(f"unknown rule {rule!r}")
                g = int(fits[np.argmin(score)])
                first, many = groups[g]
                used = min(todo, many)
                residual = rest[g].copy()
                if used == many:
                    groups.pop(g)
                    rest = np.delete(rest, g, axis=0)
                else:
                    groups[g] = (first + used, many - used)
            else:
                # new bins, as many as the pieces left of this length fill when stacked
                each = int(min(caps[0] // length, caps[1], caps[2] // float(length) ** 2))
                first, used, residual = bins, -(-todo // each), caps.copy()
                bins += used
            out.append((length, number, used, first, int(caps[0] - residual[0])))
            number, todo, residual = number + used, todo - used, residual - need
            if residual[0] >= 1 and residual[1] >= 1 and residual[2] >= 1:
                same = np.flatnonzero((rest == residual).all(axis=1))
                joined = next((int(i) for i in same if sum(groups[i]) == first), None)
                if joined is not None:
                    groups[joined] = (groups[joined][0], groups[joined][1] + used)
                else:
                    groups.append((first, used))
                    rest = np.vstack([rest, residual])
    return out


def pack(parts: DataFrame, capacity: int = 2048, **rules) -> DataFrame:
    """``parts`` with sequence_id and offset. ``parts`` has doc_id, piece, start, length, ids_crc32 and is read twice: give a written table."""
    spark = parts.sparkSession
    hist = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    total = sum(hist.values())
    rows = plan(hist, capacity, **rules)
    placed = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "p_length long, first_no long, many long, first_bin long, offset long")
    salts = max(8, -(-total // PART_ROWS))
    order = [F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32"]
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", F.lit(9)), F.lit(salts)))
    # numbers before each part of a length; lengths x parts rows, summed within a length
    before = salted.groupBy("length", "__salt").count()
    before = before.select("length", "__salt", (F.sum("count").over(W.partitionBy("length").orderBy("__salt")) - F.col("count")).alias("__before"))
    own = F.row_number().over(W.partitionBy("length", "__salt").orderBy(*order))
    numbered = salted.withColumn("__own", own).join(before, ["length", "__salt"]).withColumn("__no", F.col("__before") + F.col("__own") - 1)
    hit = (F.col("length") == F.col("p_length")) & (F.col("__no") >= F.col("first_no")) & (F.col("__no") < F.col("first_no") + F.col("many"))
    if len(rows) <= 64 * capacity:  # so it is for any input: a few rows for each length
        placed = F.broadcast(placed)
    out = numbered.join(placed, hit)
    return out.select(*parts.columns, (F.col("first_bin") + F.col("__no") - F.col("first_no")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed id sequences themselves (pieces made with ``with_ids``): at most ``capacity`` ids each."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = 2048) -> DataFrame:
    return pack(materialise(pieces(docs, capacity=capacity), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``documents``."""
    return pack_documents(table(spark, sf_dir, "documents"))
