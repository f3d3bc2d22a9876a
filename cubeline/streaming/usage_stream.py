"""Hourly usage from files of attempts as they arrive.

The split over hours is stateless; each micro-batch appends its partial sums with
its number, and a replayed batch replaces its own, so the table holds every
attempt once. Queries sum over batches, as they do over files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.usage import hourly_usage
from ..schema import ATTEMPTS


def stream_usage(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Process all files that are there, then stop; run again for later ones."""
    rows = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        out = hourly_usage(batch).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(sink)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
