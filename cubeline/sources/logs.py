"""History log lines to typed job, attempt and task lines.

Lines are read with their place, ``(path, line_no)``, as merges need their order.
Whole files are read by default: a log is one job's and small. For logs that are
too large for a row, ``split=True`` reads line by line; a line's number is then made
of where its split of the file begins and its row there, so numbers rise through
the file, however it is split and dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the log format.
JOB_LINE = r'^Job JOBID="([^"]+)".*'
JOB_ID = r"job_\d+_\d+"
ATTEMPT_LINE = r'^(Map|Reduce)Attempt TASK_TYPE="(MAP|REDUCE)".+'
TASK_LINE = r'Task TASKID="([^"]+)" TASK_TYPE="(MAP|REDUCE)".+'
TASK_ID = r"^task_(\d+_\d+)_[mr]_\d+$"
PARAMETER = r'([A-Z_]+)="([^"]+)"'
COUNTER = r"\[\(([A-Z_]+)\)\(.+?\)\((\d+)\)\]"
#: <root>/<cluster>/daily/<queue>/<yyyy>/<MMdd>/<file>, with or without the queue
DATED = r"([^/]+)/daily/(?:([^/]+)/)?(\d{4})/(\d{4})/[^/]+$"


def _pairs(text: Column, pattern: str) -> Column:
    """name -> value of all matches; of equal names the last."""
    names, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.map_from_entries(F.arrays_zip(names.alias("k"), values.alias("v")))


def located(df: DataFrame) -> DataFrame:
    """With cluster, queue and day by the path; null where it is not dated."""

    def part(k: int) -> Column:
        return F.nullif(F.regexp_extract("path", DATED, k), F.lit(""))

    return df.withColumns({"cluster": part(1), "queue": part(2), "day": F.concat(part(3), part(4))})


def read_lines(spark: SparkSession, paths: str | list[str], split: bool = False) -> DataFrame:
    """(path, line_no, line)."""
    if split:
        row = F.expr("monotonically_increasing_id() & 8589934591")  # of the task, 33 bits
        place = F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(1 << 33).cast("decimal(11,0)") + row.cast("decimal(11,0)")
        rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), place.cast("decimal(38,0)").alias("line_no"), F.col("value").alias("line"))
        return rows
    rows = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).select("path", F.col("n").cast("long").alias("line_no"), "line")


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once: filters on it are not pushed below, which would compute it again."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def classify(lines: DataFrame) -> DataFrame:
    """Lines of (path, line_no, line) that are a job's, an attempt's or a task's, in this order: kind, job_id, params, counters, prefix.

    Cheap tests of how a line begins guard the patterns, so most lines meet one
    pattern for their kind; parameters are read only of the kinds that a reader keeps.
    """
    place = [c for c in lines.columns if c != "line"]
    rows = lines.select(*place, F.replace("line", F.lit('\\"'), F.lit("")).alias("line"))
    line = F.col("line")
    # most lines of a log are none of these kinds
    rows = rows.filter(line.contains("JOBID=") | line.contains("USER=") | line.contains("TASK_TYPE="))
    direct = F.when(line.startswith("Job JOBID="), F.regexp_extract(line, JOB_LINE, 1)).otherwise("")
    loose = F.when(line.contains("USER="), F.regexp_extract(line, JOB_ID, 0)).otherwise("")
    tried = line.startswith("MapAttempt TASK_TYPE=") | line.startswith("ReduceAttempt TASK_TYPE=")
    prefix = F.when(tried, F.regexp_extract(line, ATTEMPT_LINE, 1)).otherwise("")
    rows = _once(rows, "is", F.struct(direct.alias("direct"), loose.alias("loose"), prefix.alias("prefix"), (line.startswith("Task TASKID=") & line.rlike("^" + TASK_LINE)).alias("task")))
    job = F.when(F.col("is.direct") != "", F.col("is.direct")).otherwise(F.col("is.loose"))
    kind = F.when(job != "", "job").when(F.col("is.prefix") != "", "attempt").when(F.col("is.task"), "task")
    rows = rows.select(*place, "line", F.upper("is.prefix").alias("prefix"), job.alias("job"), kind.alias("kind")).filter("kind is not null")
    rows = _once(rows, "params", _pairs(line, PARAMETER))
    task = F.regexp_extract(F.coalesce(F.try_element_at(F.col("params"), F.lit("TASKID")), F.lit("")), TASK_ID, 1)
    rows = _once(rows, "task", F.when(F.col("kind") != "job", task).otherwise(""))
    job_id = F.when(F.col("kind") == "job", F.col("job")).when(F.col("task") != "", F.concat(F.lit("job_"), F.col("task")))
    return rows.select(*place, "kind", job_id.alias("job_id"), "prefix", "params", "line")


def _param(name: str) -> Column:
    return F.try_element_at(F.col("params"), F.lit(name))


def _long(name: str) -> Column:
    return _param(name).try_cast("long")


def _status(name: str) -> Column:
    """SUCCESS, FAILED or KILLED; FAILURE means FAILED; else null."""
    value = _param(name)
    return F.when(value == "FAILURE", "FAILED").when(value.isin("SUCCESS", "FAILED", "KILLED"), value)


def _place(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c in ("path", "line_no", "cluster", "queue", "day")]


def job_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("kind = 'job' and job_id is not null").select(
        *_place(lines), "job_id", _param("USER").alias("user"), _param("JOBNAME").alias("job_name"), _param("JOB_QUEUE").alias("job_queue"), _status("JOB_STATUS").alias("job_status"),
        *(_long(f"{n}_TIME").alias(f"{n.lower()}_ms") for n in ("SUBMIT", "LAUNCH", "FINISH")),
        *(_param(n).try_cast("int").alias(n.lower()) for n in ("TOTAL_MAPS", "TOTAL_REDUCES", "FINISHED_MAPS", "FINISHED_REDUCES", "FAILED_MAPS", "FAILED_REDUCES")),
    )


def counters(text: Column) -> Column:
    """name -> count of all counters in a line; numbers too large are null."""
    return F.transform_values(_pairs(text, COUNTER), lambda _, v: v.try_cast("long"))


def attempt_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("kind = 'attempt'").select(
        *_place(lines), "job_id", _param("TASKID").alias("task_id"), _param("TASK_ATTEMPT_ID").alias("attempt_id"), F.col("prefix").alias("type"), _status("TASK_STATUS").alias("status"),
        _long("START_TIME").alias("start_ms"), _long("FINISH_TIME").alias("finish_ms"), _long("SHUFFLE_FINISHED").alias("shuffle_finished_ms"), _long("SORT_FINISHED").alias("sort_finished_ms"),
        counters(F.col("line")).alias("counters"),
    ).filter("job_id is not null and task_id is not null and attempt_id is not null")


def task_lines(lines: DataFrame) -> DataFrame:
    return lines.filter("kind = 'task'").select(
        *_place(lines), "job_id", _param("TASKID").alias("task_id"), _param("TASK_TYPE").alias("type"), _status("TASK_STATUS").alias("task_status"),
        _long("START_TIME").alias("start_ms"), _long("FINISH_TIME").alias("finish_ms"),
    ).filter("job_id is not null and task_id is not null")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(path, line_no, kind, reason) of classified lines that lack an id."""
    reason = (
        F.when((F.col("kind") != "job") & _param("TASKID").isNull(), "no_task_id")
        .when(F.col("job_id").isNull(), "no_job_id")
        .when((F.col("kind") == "attempt") & _param("TASK_ATTEMPT_ID").isNull(), "no_attempt_id")
    )
    return lines.filter(reason.isNotNull()).select("path", "line_no", "kind", reason.alias("reason"))
