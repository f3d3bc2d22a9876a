"""Which attempts of a task were superfluous, and derived times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODES = ("intent", "observed")


def mark_excess(attempts: DataFrame, mode: str = "intent", keys: tuple[str, ...] = ("job_id", "task_id")) -> DataFrame:
    """attempts with ``excess``.

    intent: attempts that did not succeed, but for the first started one of a task
    without success. observed: all but the first started one. Ties by attempt id.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}: {mode}")
    task = Window.partitionBy(*keys)
    first = F.row_number().over(task.orderBy(F.col("start_ms").asc_nulls_last(), "attempt_id")) == 1
    if mode == "observed":
        return attempts.withColumn("excess", ~first)
    good = F.coalesce(F.col("status") == "SUCCESS", F.lit(False))
    some = F.max(good).over(task)
    return attempts.withColumn("excess", F.when(some, ~good).otherwise(~first))


def derive_times(attempts: DataFrame) -> DataFrame:
    """attempts with minutes and cpu_minutes; where start or finish is 0, both are null and there are no minutes."""
    missing = (F.col("start_ms") == 0) | (F.col("finish_ms") == 0)
    out = attempts.withColumns({c: F.when(missing, None).otherwise(F.col(c)).cast("long") for c in ("start_ms", "finish_ms")})
    minutes = (F.col("finish_ms") - F.col("start_ms")) / 60000
    cpu = F.try_element_at(F.col("counters"), F.lit("CPU_MILLISECONDS")) / 60000.0
    return out.withColumns({"minutes": minutes, "cpu_minutes": cpu})
