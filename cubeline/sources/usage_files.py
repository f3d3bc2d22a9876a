"""Usage files: nested or flat records as one flat table, with the file each row is from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "avro")


def read_usage(spark: SparkSession, path: str | list[str], kind: str = "parquet") -> DataFrame:
    """Records with ``key`` and ``value`` structs are flattened, other columns (those of partitions) stay. Avro needs Spark's avro module on the class path."""
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}: {kind}")
    df = spark.read.format(kind).load(path)
    nested = {"key", "value"} <= set(df.columns)
    flat = [*(["key.*", "value.*"] if nested else []), *(F.col(f"`{c}`") for c in df.columns if not (nested and c in ("key", "value")))]
    return df.select(*flat, F.col("_metadata.file_path").alias("file_name"))


def write_usage(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ("cluster", "day")) -> None:
    """Partitions that ``df`` has rows of are replaced, the others stay."""
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}: {kind}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(kind).save(path)
