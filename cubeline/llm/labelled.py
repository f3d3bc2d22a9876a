"""The bounded sample of labelled rows that a classifier is fitted on.

Rows come in order of a hash of their id, at most ``sample`` of them and, by what
is learned from their texts, at most ``most`` values in all; a row whose text alone
has over a sixteenth of ``most`` is not sampled. Of a row that is in the sample the
whole text is learned from. Of rows that repeat an id the least text counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import id_text
from .scratch import Scratch


def held_out(doc_id: Column) -> Column:
    """One id in five, by checksum."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, names: tuple[str, ...], sample: int, most: int, learned: Callable, hold_out: bool = True) -> list[tuple[tuple[float, ...], bytes]]:
    """(labels, data) of each sampled row, in order of ids; ids with conflicting labels count by their mean.

    learned: for mapInArrow, (id, text) to (id, size, data), a row each. hold_out:
    rows that are held out are not learned from. To the driver come ``sample`` sizes
    and then the data of the rows that are taken.
    """
    scratch = Scratch(docs.sparkSession, "labelled")
    rows = labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), *(F.col(f"`{c}`").cast("double").alias(f"y{k}") for k, c in enumerate(names))).dropna()
    rows = rows.filter(~held_out(F.col("id"))) if hold_out else rows
    rows = rows.groupBy("id").agg(*(F.avg(f"y{k}").alias(f"y{k}") for k in range(len(names))))
    rows = scratch.keep(rows.orderBy(F.xxhash64("id"), "id").limit(sample), "rows")
    texts = id_text(docs, doc_id, text).join(F.broadcast(rows.select("id")), "id")  # at most ``sample`` ids
    texts = texts.groupBy("id").agg(F.min("t").alias("t"))
    held = scratch.keep(texts.mapInArrow(learned, "id long, size long, data binary"), "learned")
    sizes = held.join(F.broadcast(rows), "id").select("id", "size", *(f"y{k}" for k in range(len(names)))).orderBy(F.xxhash64("id"), "id").collect()
    taken, total = {}, 0
    for r in sizes:
        if 16 * r[1] <= most and total + r[1] <= most:
            taken[r[0]] = tuple(r[2:])
            total += r[1]
    if not taken:
        return []
    wanted = docs.sparkSession.createDataFrame([(i,) for i in taken], "id long")
    return [(taken[r.id], bytes(r.data)) for r in sorted(held.join(F.broadcast(wanted), "id").select("id", "data").collect())]
