"""Texts through Arrow in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters that are worked on at once; one longer text is a block of its own.
BLOCK_CHARS = 1_000_000


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with at most ``size`` characters, and their texts (null: empty)."""
    texts = [x or "" for x in batch.column(column).to_pylist()]
    a = total = 0
    for b, text in enumerate(texts):
        if total and total + len(text) > size:
            yield batch.slice(a, b - a), texts[a:b]
            a, total = b, 0
        total += len(text)
    if a < len(texts):
        yield batch.slice(a), texts[a:]


def list_array(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def binary_array(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def add_columns(df: DataFrame, column: str, added: str, fn: Callable[[list[str]], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the columns ``added`` (DDL), which ``fn`` makes from the texts of a block.

    A column of ``df`` that has the name of an added one is replaced.
    """
    new = T._parse_datatype_string(added)
    names = {f.name.lower() for f in new.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = "__text"
    schema = T.StructType([*(df.schema[c] for c in kept), *new.fields])

    def run(batches):
        for batch in batches:
            for part, texts in blocks(batch, source):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *fn(texts)], names=schema.names)

    return df.select(*kept, df[column].alias(source)).mapInArrow(run, schema)
