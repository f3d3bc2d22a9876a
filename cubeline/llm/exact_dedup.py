"""Exact duplicates by a tree-merge of sorted digest runs.

Texts are equal when they are identical without white space (``[\\x20\\x09-\\x0D]``).
Every row is reduced to a digest entry and dealt to a run at random, so a group of
copies, or of rows that repeat an id and a text, is spread over all runs. Their
number grows with the rows. What is exchanged, and when:

1. Entries go to (run, digest), pre-aggregated on the way: each run holds a digest
   once, with the entry that stays and a count, however many copies there are.
2. These go to their digest's partition, and are sorted once: by digest, then by
   the place of their run in the tree. From here on partitions hold whole digests.
3. In binomial rounds, ``fan_in`` runs at a time are merged. The order of (2) is
   that of every round, so a round is a merge of sorted inputs that streams:
   neither exchange nor sort. Each keeps the smallest identifier that it has seen.
4. Winners go back down to (run, digest), where the run's rows look them up.

Digests are verified: an entry carries a second, independent hash and the length
of the normalised text beside the SHA-256, and only entries equal in all three
are merged.

Defined cases: a null text counts as empty, and all empty texts are equal; a row
with a null id takes part, but stays only if its group has no id; rows that
repeat an id and a text count in group_size and are reported as often as they
come; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: The characters that do not count: space and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
KEY = ["sha", "check", "length"]
#: Rows of a run, about; and the least number of runs.
RUN_ROWS, LEAST_RUNS = 1_000_000, 64


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, salt, sha, check, length, chars): a narrow entry for each row; salt is as good as random."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    rows = rows.select("id", F.length("t").alias("chars"), F.translate("t", WHITE, "").alias("t"))
    return rows.select(
        "id",
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
        F.unhex(F.sha2("t", 256)).alias("sha"),
        F.xxhash64("t").alias("check"),
        F.length("t").alias("length"),
        "chars",
    )


def _best():
    # greatest struct: most characters, then any id before none, then the smallest id
    return F.max(F.struct("chars", F.col("id").isNotNull().alias("known"), (-F.col("id")).alias("neg"))).alias("best")


def merge_rounds(entries: DataFrame, runs: int, fan_in: int) -> DataFrame:
    """(sha, check, length, best, n): each digest once, merged from ``runs`` runs, ``fan_in`` at a time."""
    level = entries.groupBy("run", *KEY).agg(_best(), F.count(F.lit(1)).alias("n"))
    places, width = [], 1
    while width < runs:
        width *= fan_in
        places.insert(0, f"merged_{width}")
        level = level.withColumn(places[0], F.expr(f"run div {width}"))
    level = level.repartition(*KEY)
    while places:
        # grouped by a prefix of the order before: a streaming merge
        level = level.groupBy(*KEY, *places).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        places.pop()
    return level.drop("run").groupBy(*KEY).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def _judged(scratch: Scratch, docs: DataFrame, doc_id: str, text: str, runs: int | None, fan_in: int) -> DataFrame:
    """(id, sha, check, length, keep_id, group_size), a row for each document."""
    if fan_in < 2:
        raise ValueError("fan_in must be 2 at least")
    entries = scratch.keep(digests(docs, doc_id, text), "entries")
    runs = max(LEAST_RUNS, entries.count() // RUN_ROWS) if runs is None else runs
    entries = entries.withColumn("run", F.pmod("salt", F.lit(runs))).drop("salt")
    top = merge_rounds(entries, runs, fan_in)
    top = top.select(*KEY, F.when(F.col("best.known"), -F.col("best.neg")).alias("keep_id"), F.col("n").alias("group_size"))
    # both sides grow with docs: shuffled at any size, never broadcast while they are few
    winners = entries.select("run", *KEY).distinct().join(top.hint("merge"), KEY)
    return entries.select("run", "id", *KEY).join(winners.hint("merge"), ["run", *KEY]).drop("run")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int | None = None, fan_in: int = 8) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each document.

    Of equal texts the one with the most characters stays, then the smallest id.
    runs: parts that a group of copies is spread over, by the number of rows if
    None. fan_in: runs that are merged at once.
    """
    out = _judged(Scratch(docs.sparkSession, "dedup"), docs, doc_id, text, runs, fan_in)
    return out.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", runs: int | None = None, fan_in: int = 8) -> DataFrame:
    """docs without the rows that do not stay; of rows that repeat an id (or have none) and a text, the one with the most characters stays."""
    scratch = Scratch(docs.sparkSession, "dedup")
    rows = _judged(scratch, docs, doc_id, text, runs, fan_in)
    rows = rows.groupBy("id", *KEY).agg(F.count(F.lit(1)).alias("n"), F.first("keep_id").alias("keep_id"))
    rows = rows.withColumn("stays", F.col("id").eqNullSafe(F.col("keep_id")))

    def keyed(some: DataFrame) -> DataFrame:
        t = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), WHITE, "")
        return some.withColumns({"__sha": F.unhex(F.sha2(t, 256)), "__check": F.xxhash64(t), "__length": F.length(t)})

    return staying_rows(scratch, docs, rows, KEY, keyed, doc_id, text)


def staying_rows(scratch: Scratch, docs: DataFrame, rows: DataFrame, key: list[str], keyed: Callable[[DataFrame], DataFrame], doc_id: str, text: str) -> DataFrame:
    """docs without the rows that do not stay, and of each (id, *key) with one row, that with the most characters; all rows whose key is null.

    rows: (id, *key, n, stays), each id and key once, n rows of docs. keyed adds the
    key to documents, names behind ``__``; it is asked for ids only that several rows
    have, or for rows without an id, as others are known by their id.
    """
    rows = scratch.keep(rows.select("id", *key, "n", "stays"), "rows")
    several = scratch.keep(rows.groupBy("id").agg(F.sum("n").alias("n")).filter("n > 1 or id is null").select("id"), "several")
    if several.isEmpty():
        return without_ids(docs, rows.filter("not stays").select("id"), doc_id)
    own = F.col(f"`{doc_id}`").cast("long")
    gone = rows.filter("not stays").select("id").union(several).distinct()
    plain = without_ids(docs.filter(own.isNotNull()), gone, doc_id)
    twice = several.select(F.col("id").alias("__several"))
    again = keyed(docs.filter(own.isNull()).union(docs.join(twice, own == F.col("__several"), "left_semi"))).withColumn("__id", own)
    names = [f"__{k}" for k in key]
    stay = rows.filter("stays").select(F.col("id").alias("__stays"), *(F.col(k).alias(f"__s_{k}") for k in key))
    same = F.col("__id").eqNullSafe(F.col("__stays"))
    for k in key:
        same &= F.col(f"__{k}") == F.col(f"__s_{k}")
    most = F.max_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.struct(F.length(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.col(f"`{text}`")))
    one = again.join(stay, same, "left_semi").groupBy("__id", *names).agg(most.alias("__row")).select("__row.*")
    return plain.union(one).union(again.filter(F.col(names[0]).isNull()).select(*(F.col(f"`{c}`") for c in docs.columns)))


def without_ids(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """docs without the ids in the first column of ``ids``; rows without an id stay."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone"))
    # ids grow with docs: shuffled at any size, never broadcast while they are few
    return docs.join(gone.hint("merge"), F.col(f"`{doc_id}`").cast("long") == F.col("__gone"), "left_anti")
