"""Helpers for operators that read texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text that are handled at once, where a single text is not longer.
CHARS = 1 << 20


def id_text(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, t): the two columns that are needed, under names that cannot clash."""
    return docs.select(long_id(doc_id).alias("id"), F.col(f"`{text}`").cast("string").alias("t"))


def long_id(name: str) -> Column:
    return F.col(f"`{name}`").cast("long")


def blocks(batches: Iterator[pa.RecordBatch], chars: int = CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of at most about ``chars`` characters; null texts are empty."""
    for batch in batches:
        ids, texts, size = [], [], 0
        column, values = batch.column(0).to_pylist(), batch.column(1)
        for k, i in enumerate(column):
            t = values[k].as_py() or ""
            if texts and size + len(t) > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
        if texts:
            yield ids, texts
