"""Incremental runs: which days to process, logs to usage, and idempotent loads."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import excess, merge, usage
from ..schema import MANIFEST
from ..sources import confs, listing, logs, usage_files


def days(today: dt.date, num_days: int, num_days_forced: int = 0) -> list[str]:
    """yyyyMMdd, newest first, from the day before ``today`` (UTC)."""
    return [(today - dt.timedelta(days=k + 1)).strftime("%Y%m%d") for k in range(max(num_days, num_days_forced))]


def to_process(today: dt.date, num_days: int, num_days_forced: int, done: set[str], incremental: bool = True) -> list[str]:
    """Days to process: all if not incremental, else those not done and the newest forced ones."""
    listed = days(today, num_days, num_days_forced)
    return [d for k, d in enumerate(listed) if not incremental or d not in done or k < num_days_forced]


def is_forced(day: str, today: dt.date, num_days_forced: int) -> bool:
    """Whether a log day is recent enough to be computed again."""
    return (today - dt.datetime.strptime(day, "%Y%m%d").date()).days < num_days_forced


def log_globs(root: str, wanted: list[str], cluster: str = "*", queue: str = "*", suffix: str = "log") -> list[str]:
    return [f"{root}/{cluster}/daily/{queue}/{d[:4]}/{d[4:]}/*{suffix}" for d in wanted]


def attempts_from_lines(lines: DataFrame, mode: str = "intent") -> tuple[DataFrame, DataFrame]:
    """(ATTEMPTS with user and day, attempts without a task) of located, classified lines."""
    jobs = merge.merge_jobs(logs.job_lines(lines)).select(*merge.JOB, "user")
    sound = merge.sound_attempts(merge.merge_attempts(logs.attempt_lines(lines)))
    held, orphans = merge.join_tasks(sound, merge.merge_tasks(logs.task_lines(lines)))
    marked = excess.derive_times(excess.mark_excess(held, mode, (*merge.JOB, "task_id")))
    return merge.same(marked, jobs, merge.JOB, "left"), orphans


def process_logs(spark: SparkSession, paths: str | list[str], mode: str = "intent", prorate_shuffle: bool = False, split: bool = False) -> DataFrame:
    """Hourly usage with the day of the logs it is from, in one lazy plan. For more than a look use run_batch, which reads the logs once."""
    lines = logs.classify(logs.located(logs.read_lines(spark, paths, split)))
    attempts, _ = attempts_from_lines(lines, mode)
    return usage.hourly_usage(attempts, prorate_shuffle, ("day",))


# --- batches --------------------------------------------------------------------------------------


def stage_lines(lines: DataFrame, path: str) -> DataFrame:
    """Classified lines, written by kind in one narrow pass, so that each merge reads its own kind only."""
    lines.write.mode("overwrite").partitionBy("kind").parquet(path)
    return lines.sparkSession.read.schema(lines.schema).parquet(path)


def nested_jobs(staged: DataFrame, mode: str = "intent") -> DataFrame:
    """Jobs with tasks and attempts, attempts with excess and derived times, of staged lines."""
    tasks = merge.merge_tasks(logs.task_lines(staged))
    sound = merge.sound_attempts(merge.merge_attempts(logs.attempt_lines(staged)))
    held, _ = merge.join_tasks(sound, tasks)
    marked = excess.derive_times(excess.mark_excess(held, mode, (*merge.JOB, "task_id")))
    return merge.nest(merge.merge_jobs(logs.job_lines(staged)), tasks, marked)


def rejects(staged: DataFrame) -> DataFrame:
    """(kind, reason, n): lines without an id, merged attempts that are not sound, sound ones without a task."""
    lines = logs.rejected_lines(staged).select("kind", "reason")
    merged = merge.merge_attempts(logs.attempt_lines(staged))
    _, orphans = merge.join_tasks(merge.sound_attempts(merged), merge.merge_tasks(logs.task_lines(staged)))
    unsound = merged.select(F.lit("attempt").alias("kind"), merge.unsound_reason().alias("reason")).filter("reason is not null")
    every = lines.unionByName(unsound).unionByName(orphans.select(F.lit("attempt").alias("kind"), F.lit("no_task").alias("reason")))
    return every.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Nested jobs by cluster and day; the days that ``jobs`` has rows of are replaced, the others stay."""
    _replace(jobs, path)


def write_confs(found: DataFrame, path: str) -> None:
    """Accepted configurations by cluster and day, without a shuffle; days with rows are replaced."""
    _replace(found, path)


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cluster", "day").parquet(path)


def read_jobs(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """Nested jobs, of the wanted days only if given (others are not read). A day is text, as 20240101."""
    schema = spark.read.parquet(path).schema
    schema = type(schema)([f for f in schema.fields if f.name not in ("cluster", "day")]).add("cluster", "string").add("day", "string")
    rows = spark.read.schema(schema).parquet(path)
    return rows if wanted is None else rows.filter(F.col("day").isin(list(wanted)))


def discover(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(cluster, day) of the parsed jobs (or usage) under a folder, by its partitions' names, on any file system."""
    return listing.partitions(spark, path, ("cluster", "day"))


def run_batch(
    spark: SparkSession,
    logs_root: str,
    out: str,
    today: dt.date,
    num_days: int,
    num_days_forced: int = 0,
    incremental: bool = True,
    mode: str = "intent",
    prorate_shuffle: bool = False,
    split: bool = False,
    day_globs: tuple[str, ...] = ("*/daily/*/{y}/{md}", "*/daily/{y}/{md}"),
) -> dict:
    """Logs and configurations of the newest days to parsed jobs, configurations and hourly usage under ``out``.

    Days that are there already are left alone, but for the newest forced ones. Each
    log is read once; its lines are staged by kind, everything later reads these.
    What is written replaces its days, so a batch that is run again changes nothing.
    Returns {"days", "rejects": [(kind, reason, n)], "confs_rejected": n}.
    """
    done = {day for _, day in discover(spark, f"{out}/usage")}
    wanted = to_process(today, num_days, num_days_forced, done, incremental)
    globs = [f"{logs_root}/{g.format(y=d[:4], md=d[4:])}" for d in wanted for g in day_globs]
    result: dict = {"days": [], "rejects": [], "confs_rejected": 0}
    found_logs, found_confs = listing.existing(spark, [f"{g}/*log" for g in globs]), listing.existing(spark, [f"{g}/*xml" for g in globs])
    if found_confs:
        parsed = confs.read_confs(spark, found_confs)
        write_confs(confs.accepted(parsed), f"{out}/confs")
        result["confs_rejected"] = confs.rejected(parsed).count()
    if found_logs:
        staged = stage_lines(logs.classify(logs.located(logs.read_lines(spark, found_logs, split))), f"{out}/_staged")
        write_jobs(nested_jobs(staged, mode), f"{out}/jobs")
        result["days"] = sorted(r.day for r in staged.select("day").distinct().collect() if r.day)
        result["rejects"] = sorted(tuple(r) for r in rejects(staged).collect())
        attempts = merge.unnest(read_jobs(spark, f"{out}/jobs", result["days"]))
        usage_files.write_usage(usage.hourly_usage(attempts, prorate_shuffle, ("day",)), f"{out}/usage")
        listing.remove(spark, f"{out}/_staged")
    return result


# --- the usage table ------------------------------------------------------------------------------


def load(spark: SparkSession, found: DataFrame, manifest: DataFrame, table: DataFrame, read) -> tuple[DataFrame, DataFrame]:
    """(table, manifest) after new and changed files are read, and changed and deleted ones' rows are dropped.

    read: frame of (file_name, state) to rows with ``file_name``. Lazy: nothing is
    written; rows are keyed by file, as equal keys may come from several.
    """
    states = listing.diff(found, manifest)
    gone = states.filter("state in ('modified', 'deleted')").select("file_name")
    fresh = read(states.filter("state in ('unprocessed', 'modified')"))
    rows = table.join(gone, "file_name", "left_anti").unionByName(fresh)
    return rows, found.select("file_name", "modified")


def refresh(spark: SparkSession, files_glob: str, table_path: str, kind: str = "parquet") -> dict[str, int]:
    """Bring the table of usage rows under ``table_path`` up to the files: {state: number of files}.

    The table is kept by file: rows of new and changed files are written, those of
    changed and deleted ones go, all others are not touched. The manifest is written
    last; a run that broke off is done again.
    """
    found = listing.list_files(spark, files_glob).select("file_name", "modified")
    manifest_path, rows_path = f"{table_path}/manifest", f"{table_path}/rows"
    manifest = spark.read.schema(MANIFEST).parquet(manifest_path) if listing.existing(spark, [manifest_path]) else spark.createDataFrame([], MANIFEST)
    states = [tuple(r) for r in listing.diff(found, manifest).collect()]  # a row for each file, as a listing is the driver's anyway
    fresh = [f for f, state in states if state in ("unprocessed", "modified")]
    for name in (f for f, state in states if state in ("modified", "deleted")):
        listing.remove(spark, f"{rows_path}/file_key={_file_key(name)}")
    if fresh:
        rows = usage_files.read_usage(spark, fresh, kind)
        rows = rows.withColumn("file_key", F.sha2("file_name", 256))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_key").parquet(rows_path)
    listed = spark.createDataFrame([(r.file_name, r.modified) for r in found.collect()], MANIFEST)
    listed.coalesce(1).write.mode("overwrite").parquet(manifest_path)
    counts: dict[str, int] = {}
    for _, state in states:
        counts[state] = counts.get(state, 0) + 1
    return counts


def _file_key(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()
