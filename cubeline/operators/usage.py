"""Attempts to hourly usage: each attempt is split over the UTC hours that it touches.

The split is narrow (sequence and explode within the scan's stage), so one very
large job or user spreads over its rows; the only shuffle is the cube's, after
partial sums. Milliseconds are summed as whole numbers and divided once, so sums
do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import HOUR_MS, floor_hour

CUBE = ("user", "time_ms", "unit", "cluster", "excess", "type", "status")


def quality_reason() -> Column:
    """Why an attempt is not counted; null if it is."""
    return (
        F.when(F.col("status").isNull(), "no_status")
        .when(F.col("start_ms").isNull() | (F.col("start_ms") <= 0), "no_start")
        .when(F.col("finish_ms").isNull() | (F.col("finish_ms") <= 0), "no_finish")
        .when(F.col("finish_ms") < F.col("start_ms"), "finish_before_start")
        .when(F.col("user").isNull(), "no_user")
    )


def quality_counts(attempts: DataFrame) -> DataFrame:
    """(reason, n): attempts by why they are not counted, ``counted`` else."""
    return attempts.groupBy(F.coalesce(quality_reason(), F.lit("counted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def counted(attempts: DataFrame) -> DataFrame:
    return attempts.filter(quality_reason().isNull())


def _counter(name: str) -> Column:
    return F.try_element_at(F.col("counters"), F.lit(name))


def split_hours(attempts: DataFrame, prorate_shuffle: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """A row for each attempt and hour: the cube's dimensions, part_ms, cpu_share, spilled, shuffle, started, finished.

    An attempt counts as started in its first hour and finished in its last; one
    that ends on the hour ends in the hour before. Without duration there are no
    rows. Shuffled bytes are repeated in each hour unless prorate_shuffle.
    """
    whole = counted(attempts).filter("start_ms < finish_ms")
    hours = F.sequence(floor_hour(F.col("start_ms")), floor_hour(F.col("finish_ms") - 1), F.lit(HOUR_MS).cast("long"))
    rows = whole.select(
        "user", "cluster", "excess", "type", "status", "start_ms", "finish_ms",
        _counter("CPU_MILLISECONDS").alias("cpu"), _counter("SPILLED_RECORDS").alias("spill"), _counter("REDUCE_SHUFFLE_BYTES").alias("bytes"),
        *more, F.explode(hours).alias("time_ms"),
    )
    rows = rows.withColumn("part_ms", F.least(F.col("time_ms") + HOUR_MS, "finish_ms") - F.greatest("time_ms", "start_ms"))
    share = F.col("part_ms") / (F.col("finish_ms") - F.col("start_ms"))
    return rows.select(
        "user", "time_ms", F.lit("HOURS").alias("unit"), "cluster", "excess", "type", "status", "part_ms",
        (share * F.col("cpu")).alias("cpu_ms"),
        (share * F.col("spill")).cast("long").alias("spilled_records"),
        ((share * F.col("bytes")).cast("long") if prorate_shuffle else F.col("bytes")).alias("reduce_shuffle_bytes"),
        (F.col("time_ms") <= F.col("start_ms")).cast("long").alias("started"),
        (F.col("finish_ms") <= F.col("time_ms") + HOUR_MS).cast("long").alias("finished"), *more,
    )


def hourly_usage(attempts: DataFrame, prorate_shuffle: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """USAGE_HOURLY: sums by user, hour, cluster, excess, type and status, and more columns; a measure that is null throughout stays null."""
    rows = split_hours(attempts, prorate_shuffle, more)
    return rows.groupBy(*CUBE, *more).agg(
        F.sum("started").alias("started"),
        F.sum("finished").alias("finished"),
        (F.sum("part_ms") / 60000).alias("elapsed_minutes"),
        (F.sum("cpu_ms") / 60000).alias("cpu_minutes"),
        F.sum("spilled_records").alias("spilled_records"),
        F.sum("reduce_shuffle_bytes").alias("reduce_shuffle_bytes"),
    )
