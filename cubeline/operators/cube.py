"""A cube: dimensions, measures, and the operations on them, as one lazy frame.

Nothing is collected until asked for; each operation returns a new cube.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class UsageCube:
    def __init__(self, df: DataFrame, dims: list[str], measures: list[str]):
        self.df, self.dims, self.measures = df.select(*dims, *measures), list(dims), list(measures)

    def _of(self, df: DataFrame, dims: list[str] | None = None) -> UsageCube:
        return UsageCube(df, self.dims if dims is None else dims, self.measures)

    def _summed(self, df: DataFrame, dims: list[str]) -> UsageCube:
        return self._of(df.groupBy(*dims).agg(*(F.sum(m).alias(m) for m in self.measures)), dims)

    @classmethod
    def build(cls, df: DataFrame, dims: list[str], measures: list[str]) -> UsageCube:
        """Sums by the dimensions; rows that lack one are left out."""
        return cls(df, dims, measures)._summed(df.dropna(subset=dims), list(dims))

    def aggregate(self, rows: DataFrame) -> UsageCube:
        """More rows, added to those of equal keys."""
        return self._summed(self.df.unionByName(rows.select(*self.dims, *self.measures)), self.dims)

    def put(self, rows: DataFrame) -> UsageCube:
        """More rows, whose keys must be new."""
        out = self.df.unionByName(rows.select(*self.dims, *self.measures))
        twice = out.groupBy(*self.dims).count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"key is there already: {[twice[0][d] for d in self.dims]}")
        return self._of(out)

    def filter_on(self, dim: str, keep: Callable[[Column], Column]) -> UsageCube:
        return self._of(self.df.filter(keep(F.col(self._dim(dim)))))

    def aggregate_on(self, dim: str, f: Callable[[Column], Column]) -> UsageCube:
        """A dimension mapped to other values, and summed again."""
        return self._summed(self.df.withColumn(self._dim(dim), f(F.col(dim))), self.dims)

    def collapse_on(self, dim: str) -> UsageCube:
        """Without a dimension, summed."""
        self._dim(dim)
        return self._summed(self.df, [d for d in self.dims if d != dim])

    def slice(self, key) -> UsageCube:
        """The first dimension fixed; empty if no row has the key."""
        return self._of(self.df.filter(F.col(self.dims[0]) == F.lit(key)), self.dims[1:])

    def has_slice(self, key) -> bool:
        return not self.df.filter(F.col(self.dims[0]) == F.lit(key)).isEmpty()

    def keys_for(self, dim: str) -> DataFrame:
        """A dimension of each row, repeats included."""
        return self.df.select(self._dim(dim))

    def keys(self) -> DataFrame:
        return self.df.select(*self.dims)

    def values(self) -> DataFrame:
        return self.df.select(*self.measures)

    def __iter__(self):
        """(keys, measures) of each row, fetched a partition at a time."""
        for row in self.df.toLocalIterator():
            yield tuple(row[d] for d in self.dims), {m: row[m] for m in self.measures}

    def pack(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)

    @classmethod
    def unpack(cls, spark: SparkSession, path: str, dims: list[str], measures: list[str]) -> UsageCube:
        return cls(spark.read.parquet(path), dims, measures)

    def _dim(self, dim: str) -> str:
        if dim not in self.dims:
            raise ValueError(f"not a dimension: {dim}")
        return dim
