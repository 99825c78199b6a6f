"""Operator 4: byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are split by the public pattern, each distinct piece of a task's corpus
is encoded once by ``bpe.replay`` (an inverted index from token pair to word
positions, merges applied in rank order), and the ids of a text are put
together from its pieces. No shuffle: every task replays the merges for the
pieces that it meets, and remembers at most ``bpe.MAX_PIECES`` of them.

Cases: a null or empty text has no tokens and decodes to no bytes; repeated
rows are encoded alike; an empty table gives an empty result; other columns
are kept, and one named as an output is replaced. A text of any length is
encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.session import table
from velum.llm import arrow, bpe
from velum.llm import textkernel as tk

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", ranks_path: str = RANKS, keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids_col``, array<int>: the ids of each whole text, without special tokens."""

    def ids(texts: list[str]) -> list[pa.Array]:
        encoder, _ = bpe.replay_encoder(ranks_path)
        flat, cuts = encoder.encode(texts)
        return [arrow.list_array(cuts, flat)]

    return arrow.add_columns(docs, text_col, f"`{ids_col}` array<int>", ids, keep)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", ranks_path: str = RANKS) -> DataFrame:
    """Adds ``out_col``, binary: the bytes of the ids (no ids or null: no bytes)."""
    from pyspark.sql import types as T

    kept = [c for c in df.columns if c.lower() != out_col.lower()]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out_col, T.BinaryType())])

    def run(batches):
        _, merges = bpe.replay_encoder(ranks_path)
        for batch in batches:
            step = max(1, len(batch) * 500_000 // max(1, batch.nbytes // 4))
            for a in range(0, len(batch), step):
                part = batch.slice(a, step)
                ids = part.column(ids_col)
                lengths = np.array([0 if n is None else n for n in pa.compute.list_value_length(ids).to_pylist()], np.int64)
                flat = np.asarray(ids.flatten(), dtype=np.int64)
                where, counts = tk.expand(merges.offsets, flat)
                ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(lengths)])]
                out = arrow.binary_array(ends, merges.flat[where])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), out], names=schema.names)

    return df.select(*kept).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text of ``documents``."""
    coded = decode(encode(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
