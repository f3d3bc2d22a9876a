"""Lines of one job, task or attempt, merged in order of arrival.

Order is (path, line_no). All merges are pre-aggregated; attempts stay a flat
table, and nesting is a last step for those who want it. A job is one day's of one
cluster; where the place of a log does not tell them they are null, and joins take
nulls as equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("path", "line_no")
JOB = ("cluster", "day", "job_id")
JOB_FIELDS = ("user", "job_name", "job_queue", "submit_ms", "launch_ms", "total_maps", "total_reduces", "finished_maps", "finished_reduces", "failed_maps", "failed_reduces")
TASK_FIELDS = ("type", "task_status", "start_ms", "finish_ms")


def last_known(value: str | Column, when: Column | None = None) -> Column:
    """The value of the last line that has one (and where ``when`` holds)."""
    value = F.col(value) if isinstance(value, str) else value
    there = value.isNotNull() if when is None else value.isNotNull() & when
    # max_by takes the value at the greatest order among lines whose order is not null
    return F.max_by(value, F.when(there, F.struct(*ORDER)))


def merge_jobs(lines: DataFrame) -> DataFrame:
    """One row for each job; status and finish come only from lines that have both."""
    both = F.col("job_status").isNotNull() & F.col("finish_ms").isNotNull()
    ends = [last_known(c, both).alias(c) for c in ("job_status", "finish_ms")]
    return lines.groupBy(*JOB).agg(*(last_known(c).alias(c) for c in JOB_FIELDS), *ends, F.max("path").alias("path"))


def merge_tasks(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*JOB, "task_id").agg(*(last_known(c).alias(c) for c in TASK_FIELDS))


def merge_attempts(lines: DataFrame) -> DataFrame:
    """Greatest times, last known type and status, last counters that are not empty."""
    times = ("start_ms", "finish_ms", "shuffle_finished_ms", "sort_finished_ms")
    counters = last_known("counters", F.size("counters") > 0)
    return lines.groupBy(*JOB, "task_id", "attempt_id").agg(
        last_known("type").alias("type"),
        last_known("status").alias("status"),
        *(F.max(c).alias(c) for c in times),
        F.coalesce(counters, F.expr("cast(map() as map<string,bigint>)")).alias("counters"),
    )


def unsound_reason() -> Column:
    """Why a merged attempt is not used; null if it is."""
    return (
        F.when(F.col("attempt_id").isNull() | F.col("task_id").isNull(), "no_id")
        .when(F.col("status").isNull(), "no_status")
        .when(F.col("start_ms").isNull(), "no_start")
        .when(F.col("finish_ms").isNull(), "no_finish")
        .when(F.col("finish_ms") < F.col("start_ms"), "finish_before_start")
    )


def sound_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts with ids, a status and times that do not run backwards."""
    return attempts.filter(unsound_reason().isNull())


def same(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """An equi-join in which null keys are equal; the keys come from the left."""
    named = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return left.join(named, on, how).drop(*(f"__{k}" for k in keys))


def join_tasks(attempts: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attempts with their task known, attempts without)."""
    keys = (*JOB, "task_id")
    ids = tasks.select(*keys)
    return same(attempts, ids, keys, "left_semi"), same(attempts, ids, keys, "left_anti")


def nest(jobs: DataFrame, tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Jobs with their tasks, tasks with their attempts, in order of ids; jobs without tasks and tasks without attempts stay, and tasks without a job line have a job without fields."""
    own = attempts.groupBy(*JOB, "task_id").agg(F.sort_array(F.collect_list(F.struct("attempt_id", *(c for c in attempts.columns if c not in (*JOB, "task_id", "attempt_id", "counters", "user")), F.map_entries("counters").alias("counters")))).alias("attempts"))
    held = same(tasks, own, (*JOB, "task_id"), "left").withColumn("attempts", F.coalesce("attempts", F.array().cast(own.schema["attempts"].dataType)))
    listed = held.groupBy(*JOB).agg(F.sort_array(F.collect_list(F.struct("task_id", *(c for c in held.columns if c not in (*JOB, "task_id"))))).alias("tasks"))
    named = listed.select(*(F.col(k).alias(f"__{k}") for k in JOB), "tasks")
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in JOB))
    keys = [F.coalesce(k, f"__{k}").alias(k) for k in JOB]
    none = F.array().cast(listed.schema["tasks"].dataType)
    return jobs.join(named, on, "full").select(*keys, *(c for c in jobs.columns if c not in JOB), F.coalesce("tasks", none).alias("tasks"))


def unnest(jobs: DataFrame) -> DataFrame:
    """The attempts of nested jobs, flat, with their job's user; narrow."""
    rows = jobs.select(*JOB, "user", F.explode("tasks").alias("t")).select(*JOB, "user", F.col("t.task_id").alias("task_id"), F.explode("t.attempts").alias("a"))
    return rows.select(*JOB, "task_id", "user", "a.*").withColumn("counters", F.map_from_entries("counters"))
