"""Intermediate tables in the folder that the driver and all executors share.

A table written here cuts the lineage: if an executor is lost later, only the
stages after the table run again. The folder is the session's
``spark.checkpoint.dir``; where that is unset (local tests) a temporary folder
is used, and on a cluster without it the operators refuse to run.

What an operator returns may still read its tables, so they stay until the driver
ends. A driver that lives on removes them itself: ``remove_all`` when no result is
wanted any more, or ``released`` around a step whose result is written inside it.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

_ROOTS: list[str] = []
_LOG = logging.getLogger(__name__)


class Scratch:
    """The tables of one operator call, under a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _ROOTS.append(self.root)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return the table read back."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        if self._n == 1:
            at, files = _file_system(self.spark, self.root)
            files.deleteOnExit(at)  # by the driver's JVM, also after spark.stop()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            _remove(self.spark, table._scratch_path)


def remove_all(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables of all operator calls so far, but the first ``since``; their results cannot be read after that."""
    while len(_ROOTS) > since:
        _remove(spark, _ROOTS.pop())


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables of the operators called inside."""
    since = len(_ROOTS)
    try:
        yield
    finally:
        remove_all(spark, since)


def settled(scratch: Scratch, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """docs, written first if they come out of a shuffle, whose rows may come in another order when a task runs again."""
    if "Exchange" not in docs._jdf.queryExecution().executedPlan().toString():
        return docs
    return scratch.keep(docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), "docs")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at, files = _file_system(spark, path)
        files.delete(at, True)
    except Exception as e:  # noqa: BLE001  only disk space is at stake
        _LOG.warning("scratch tables stay in %s: %s", path, e)
