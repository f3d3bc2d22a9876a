"""The registered queries over the driver's tables, each with its DuckDB text.

Events stand for attempts: an event is an attempt of ``value`` minutes by its user.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics, timefn
from .operators import excess, merge, usage
from .operators.cube import UsageCube
from .plans import present, query, runs
from .session import shared_folder
from .sources import confs, listing, logs, usage_files

ZONE = "America/New_York"
START, END = 1_704_412_800_000, 1_706_227_200_000  # 2024-01-05 and 2024-01-26, UTC
USERS = ("user_2", "user_44", "user_100")
TOP = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- adapters -------------------------------------------------------------------------------------


def attempts_from_events(spark: SparkSession, sf_dir: str, mode: str = "intent") -> DataFrame:
    rows = table(spark, sf_dir, "events")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    # reduces may fail and be killed too
    kind = F.when(F.col("event_type").isin("purchase", "view") | (F.col("event_type").isin("error", "signup") & (F.col("event_id") % 2 == 0)), "REDUCE").otherwise("MAP")
    held = F.map_filter(
        F.create_map(F.lit("CPU_MILLISECONDS"), F.when(k % 10 != 0, k * 700), F.lit("SPILLED_RECORDS"), k, F.lit("REDUCE_SHUFFLE_BYTES"), F.when(kind == "REDUCE", k * 1024)),
        lambda _, v: v.isNotNull(),
    )
    out = rows.select(
        F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta").alias("cluster"),
        F.concat(F.lit("job_20240101_"), F.col("user_id").cast("string")).alias("job_id"),
        F.concat(F.lit("task_20240101_"), F.col("user_id").cast("string"), F.lit("_m_"), F.expr("cast(event_id div 500 as string)")).alias("task_id"),
        F.concat(F.lit("attempt_"), F.col("event_id").cast("string")).alias("attempt_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        kind.alias("type"),
        F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "KILLED").otherwise("SUCCESS").alias("status"),
        start.alias("start_ms"),
        (start + F.round(F.col("value") * 60000).cast("long")).alias("finish_ms"),
        held.alias("counters"),
    )
    return excess.mark_excess(out, mode)


def work_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for what a query writes and reads back; the driver's JVM removes it."""
    path = f"{shared_folder(spark)}/queries/{name}-{uuid.uuid4().hex}"
    at, files = listing.file_system(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def usage_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.hourly_usage(attempts_from_events(spark, sf_dir))


def usage_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of usage: an order is an hour with its price as minutes in cents."""
    rows = table(spark, sf_dir, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 24 * timefn.HOUR_MS
    return rows.select(F.concat(F.lit("user_"), (F.col("o_custkey") % 7).cast("string")).alias("user"), F.lit("alpha").alias("cluster"), ms.alias("time_ms"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.lit(1).cast("long").alias("started"))


_ATTEMPTS = """
raw AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS cluster, 'job_20240101_' || user_id AS job_id,
    'task_20240101_' || user_id || '_m_' || (event_id // 500) AS task_id, 'attempt_' || event_id AS attempt_id, 'user_' || user_id AS "user",
    CASE WHEN event_type IN ('purchase', 'view') OR event_type IN ('error', 'signup') AND event_id % 2 = 0 THEN 'REDUCE' ELSE 'MAP' END AS type,
    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'KILLED' ELSE 'SUCCESS' END AS status,
    epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(round(value * 60000) AS BIGINT) AS finish_ms,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id, user_id
  FROM events
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, task_id ORDER BY start_ms, attempt_id) AS rn, max(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, task_id) AS good,
    CASE WHEN k % 10 <> 0 THEN k * 700 END AS cpu, k AS spill, CASE WHEN type = 'REDUCE' THEN k * 1024 END AS bytes
  FROM raw
), attempts AS (SELECT *, CASE WHEN good = 1 THEN status <> 'SUCCESS' ELSE rn > 1 END AS excess FROM marked)
"""

_USAGE = (
    _ATTEMPTS
    + """, split AS (
  SELECT *, least(time_ms + 3600000, finish_ms) - greatest(time_ms, start_ms) AS part_ms
  FROM (SELECT *, unnest(range(start_ms - start_ms % 3600000, finish_ms, 3600000)) AS time_ms FROM attempts WHERE start_ms < finish_ms) x
), usage AS (
  SELECT "user", time_ms, 'HOURS' AS unit, cluster, excess, type, status, CAST(sum(CASE WHEN time_ms <= start_ms THEN 1 ELSE 0 END) AS BIGINT) AS started,
    CAST(sum(CASE WHEN finish_ms <= time_ms + 3600000 THEN 1 ELSE 0 END) AS BIGINT) AS finished, CAST(sum(part_ms) AS BIGINT) / 60000 AS elapsed_minutes,
    sum(part_ms / (finish_ms - start_ms) * cpu) / 60000 AS cpu_minutes, CAST(sum(CAST(trunc(part_ms / (finish_ms - start_ms) * spill) AS BIGINT)) AS BIGINT) AS spilled_records,
    CAST(sum(bytes) AS BIGINT) AS reduce_shuffle_bytes
  FROM split GROUP BY ALL
)
"""
)

_ORDERS = """
usage AS (
  SELECT 'user_' || (o_custkey % 7) AS "user", 'alpha' AS cluster, epoch_us(o_orderdate) // 1000 + o_orderkey % 24 * 3600000 AS time_ms,
    CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(1 AS BIGINT) AS started FROM orders
)
"""


def _sql_local(ms: str, zone: str) -> str:
    return f"((make_timestamp({ms} * 1000) AT TIME ZONE 'UTC') AT TIME ZONE '{zone}')"


def _sql_start(local: str, unit: str) -> str:
    if unit == "WEEKS":
        return f"date_trunc('week', {local} + INTERVAL 1 DAY) - INTERVAL 1 DAY"
    return f"date_trunc('{unit.lower()[:-1]}', {local})"


def _sql_ms(local: str, zone: str) -> str:
    return f"epoch_us(({local}) AT TIME ZONE '{zone}') // 1000"


def sql_bucket(ms: str, unit: str, zone: str = ZONE) -> str:
    return f"{ms} - {ms} % 3600000" if unit == "HOURS" else _sql_ms(_sql_start(_sql_local(ms, zone), unit), zone)


def sql_axis(unit: str, zone: str = ZONE, start: int = START, end: int = END) -> str:
    """CTE ``axis`` over ``usage`` of cluster alpha."""
    if unit == "HOURS":
        return f"axis AS (SELECT unnest(range({start - start % 3_600_000}, {end - end % 3_600_000} + 1, 3600000)) AS time_ms)"
    step = {"DAYS": "1 DAY", "WEEKS": "7 DAY", "MONTHS": "1 MONTH", "QUARTERS": "3 MONTH"}[unit]
    first, last = (_sql_start(_sql_local(x, zone), unit) for x in (f"greatest({start}, min(time_ms))", f"least({end}, max(time_ms))"))
    plus = "" if unit == "QUARTERS" else f" + INTERVAL {step}"
    return f"""bounds AS (SELECT CAST({first}{plus} AS TIMESTAMP) AS a, CAST({last} - INTERVAL {step} AS TIMESTAMP) AS b FROM usage WHERE cluster = 'alpha'),
axis AS (SELECT {_sql_ms("local", zone)} AS time_ms FROM (SELECT unnest(generate_series(a, b, INTERVAL {step})) AS local FROM bounds) x)"""


def _sql_where(pairs) -> str:
    return " AND ".join([f'{d} = {v}' if isinstance(v, bool) else f"{d} = '{v}'" for d, v in pairs] or ["true"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


# --- usage and metrics ----------------------------------------------------------------------------

_HOURLY = ["user", "time_ms", "unit", "cluster", "excess", "type", "status", "started", "finished", "elapsed_minutes", "spilled_records", "reduce_shuffle_bytes"]
_add(
    "hourly_usage",
    lambda s, d: usage_from_events(s, d).select(*_HOURLY, F.round("cpu_minutes", 6).alias("cpu_minutes")),
    f"WITH {_USAGE} SELECT * REPLACE (round(cpu_minutes, 6) AS cpu_minutes) FROM usage",
)


def _bucketed(unit: str) -> None:
    if unit in ("MONTHS", "QUARTERS"):
        f = lambda s, d: usage_from_orders(s, d).groupBy("user", timefn.bucket(F.col("time_ms"), unit, ZONE).alias("bucket_ms")).agg(F.sum("cents").alias("cents"), F.sum("started").alias("started"))
        sql = f'WITH {_ORDERS} SELECT "user", {sql_bucket("time_ms", unit)} AS bucket_ms, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(started) AS BIGINT) AS started FROM usage GROUP BY ALL'
    else:
        f = lambda s, d: query.aggregate(usage_from_events(s, d), ["user"], {"cluster": "alpha"}, unit, ZONE).select("user", F.col("time_ms").alias("bucket_ms"), "started", "finished", F.round("elapsed_minutes", 6).alias("elapsed_minutes"), "reduce_shuffle_bytes")
        sql = f"""WITH {_USAGE} SELECT "user", {sql_bucket("time_ms", unit)} AS bucket_ms, CAST(sum(started) AS BIGINT) AS started, CAST(sum(finished) AS BIGINT) AS finished,
            round(sum(elapsed_minutes), 6) AS elapsed_minutes, CAST(sum(reduce_shuffle_bytes) AS BIGINT) AS reduce_shuffle_bytes FROM usage WHERE cluster = 'alpha' GROUP BY ALL"""
    _add(f"usage_{unit.lower()}_tz", f, sql)


def _metric(name: str) -> None:
    pairs, measure = metrics.conditions(name), metrics.measure(name)
    f = lambda s, d: usage_from_events(s, d).filter((F.col("cluster") == "alpha") & metrics.predicate(name)).groupBy("user", timefn.bucket(F.col("time_ms"), "DAYS", ZONE).alias("day_ms")).agg(F.round(F.sum(measure).cast("double"), 6).alias("value"))
    sql = f"""WITH {_USAGE} SELECT "user", {sql_bucket("time_ms", "DAYS")} AS day_ms, round(CAST(sum({measure}) AS DOUBLE), 6) AS value FROM usage WHERE cluster = 'alpha' AND {_sql_where(pairs)} GROUP BY ALL"""
    _add(f"metric_{name}", f, sql)


def _axis(unit: str) -> None:
    if unit in ("MONTHS", "QUARTERS"):
        a, b = 820_454_400_000, 915_148_800_000  # 1996-01-01 and 1999-01-01
        f = lambda s, d: query.axis_for(usage_from_orders(s, d), query.Request("alpha", "totalStarted", a, b, unit, ZONE, USERS))
        _add(f"axis_{unit.lower()}", f, f"WITH {_ORDERS}, {sql_axis(unit, ZONE, a, b)} SELECT time_ms FROM axis")
    else:
        f = lambda s, d: query.axis_for(usage_from_events(s, d), query.Request("alpha", "totalStarted", START, END, unit, ZONE, USERS))
        _add(f"axis_{unit.lower()}", f, f"WITH {_USAGE}, {sql_axis(unit)} SELECT time_ms FROM axis")


for _unit in timefn.UNITS:
    _bucketed(_unit)
    _axis(_unit)
for _name in metrics.METRICS:
    _metric(_name)

_add("clusters", lambda s, d: query.clusters(usage_from_events(s, d)), f"WITH {_USAGE} SELECT DISTINCT cluster FROM usage")
_add("users", lambda s, d: query.users(usage_from_events(s, d), "alpha"), f"""WITH {_USAGE} SELECT DISTINCT "user" FROM usage WHERE cluster = 'alpha'""")
_add("time_range", lambda s, d: query.time_range(usage_from_events(s, d), "alpha"), f"WITH {_USAGE} SELECT min(time_ms) AS lo_ms, max(time_ms) AS hi_ms FROM usage WHERE cluster = 'alpha'")

_REQUEST = query.Request("alpha", "minutesTotal", START, END, "DAYS", ZONE, USERS, USERS[:2])
_IN = ", ".join(f"'{u}'" for u in USERS)
_DAYS = f"""days AS (SELECT "user", {sql_bucket("time_ms", "DAYS")} AS time_ms, sum(elapsed_minutes) AS value FROM usage WHERE cluster = 'alpha' GROUP BY ALL)"""
_GRID = f"WITH {_USAGE}, {sql_axis('DAYS')}, {_DAYS}"
_GRID_ROWS = f"""SELECT u."user", a.time_ms, coalesce(d.value, 0.0) AS value FROM axis a CROSS JOIN (SELECT unnest([{_IN}]) AS "user") u LEFT JOIN days d ON d."user" = u."user" AND d.time_ms = a.time_ms"""


def _dense(s: SparkSession, d: str) -> DataFrame:
    return query.per_user(usage_from_events(s, d), _REQUEST)


_add("per_user_dense", lambda s, d: _dense(s, d).select("user", "time_ms", F.round("value", 6).alias("value")), f'{_GRID} SELECT "user", time_ms, round(value, 6) AS value FROM ({_GRID_ROWS}) x')
_add(
    "aggregated_dense",
    lambda s, d: query.aggregated(usage_from_events(s, d), _REQUEST).select("time_ms", F.round("value", 6).alias("value")),
    f"""{_GRID} SELECT a.time_ms, round(coalesce(sum(d.value), 0.0), 6) AS value FROM axis a LEFT JOIN days d ON d.time_ms = a.time_ms AND d."user" IN ('{USERS[0]}', '{USERS[1]}') GROUP BY a.time_ms""",
)
_add("complement_users", lambda s, d: query.complement(usage_from_events(s, d), "alpha", list(USERS)), f"""WITH {_USAGE} SELECT DISTINCT "user" FROM usage WHERE cluster = 'alpha' AND "user" NOT IN ({_IN})""")

# --- cube -----------------------------------------------------------------------------------------


def _cube(s: SparkSession, d: str) -> UsageCube:
    return UsageCube.build(usage_from_events(s, d), ["cluster", "user", "type"], ["started", "spilled_records"])


_CUBE_SQL = f'WITH {_USAGE}, cube AS (SELECT cluster, "user", type, CAST(sum(started) AS BIGINT) AS started, CAST(sum(spilled_records) AS BIGINT) AS spilled_records FROM usage GROUP BY ALL)'
_SUMS = "CAST(sum(started) AS BIGINT) AS started, CAST(sum(spilled_records) AS BIGINT) AS spilled_records"
_add("cube_build", lambda s, d: _cube(s, d).df, f"{_CUBE_SQL} SELECT * FROM cube")
_add("cube_filter", lambda s, d: _cube(s, d).filter_on("type", lambda c: c == "MAP").df, f"{_CUBE_SQL} SELECT * FROM cube WHERE type = 'MAP'")
_add("cube_aggregate_on", lambda s, d: _cube(s, d).aggregate_on("user", lambda c: F.substring(c, 1, 6)).df, f'{_CUBE_SQL} SELECT cluster, substr("user", 1, 6) AS "user", type, {_SUMS} FROM cube GROUP BY ALL')
_add("cube_collapse", lambda s, d: _cube(s, d).collapse_on("user").df, f"{_CUBE_SQL} SELECT cluster, type, {_SUMS} FROM cube GROUP BY ALL")
_add("cube_slice", lambda s, d: _cube(s, d).slice("beta").df, f"""{_CUBE_SQL} SELECT "user", type, started, spilled_records FROM cube WHERE cluster = 'beta'""")
_add("cube_keys", lambda s, d: _cube(s, d).keys_for("user"), f'{_CUBE_SQL} SELECT "user" FROM cube')

# --- attempts -------------------------------------------------------------------------------------

_add("excess_intent", lambda s, d: attempts_from_events(s, d).select("attempt_id", "excess"), f"WITH {_ATTEMPTS} SELECT attempt_id, excess FROM attempts")
_add("excess_observed", lambda s, d: attempts_from_events(s, d, "observed").select("attempt_id", "excess"), f"WITH {_ATTEMPTS} SELECT attempt_id, rn > 1 AS excess FROM attempts")


def _flawed(s: SparkSession, d: str) -> DataFrame:
    n = F.substring("attempt_id", 9, 30).cast("long")
    rows = attempts_from_events(s, d)
    return rows.withColumns({"status": F.when(n % 11 != 0, F.col("status")), "start_ms": F.when(n % 13 == 0, F.lit(0)).otherwise(F.col("start_ms")), "finish_ms": F.when(n % 17 != 0, F.col("finish_ms"))})


_add(
    "attempt_quality",
    lambda s, d: usage.quality_counts(_flawed(s, d)),
    f"""WITH {_ATTEMPTS} SELECT CASE WHEN event_id % 11 = 0 THEN 'no_status' WHEN event_id % 13 = 0 THEN 'no_start' WHEN event_id % 17 = 0 THEN 'no_finish'
        WHEN finish_ms < start_ms THEN 'finish_before_start' ELSE 'counted' END AS reason, count(*) AS n FROM attempts GROUP BY ALL""",
)

# --- logs: rendered, read back --------------------------------------------------------------------


def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line_no, line): events as a job's history, two lines for each attempt, task and job."""
    a = attempts_from_events(spark, sf_dir).withColumn("n", F.substring("attempt_id", 9, 30).cast("long"))
    path = F.concat(F.lit("/logs/"), F.col("cluster"), F.lit("/daily/main/2024/0101/"), F.col("job_id"), F.lit(".log"))
    head = F.concat(F.initcap("type"), F.format_string('Attempt TASK_TYPE="%s" TASKID="%s" TASK_ATTEMPT_ID="%s" ', "type", "task_id", "attempt_id"))
    count = F.aggregate(F.map_entries("counters"), F.lit(""), lambda x, e: F.concat(x, F.format_string("[(%s)(some (label))(%d)]", e["key"], e["value"])))
    tries = [F.concat(head, F.format_string('START_TIME="%d" QUOTED="a \\"b\\" c" .', "start_ms")), F.concat(head, F.format_string('TASK_STATUS="%s" FINISH_TIME="%d" COUNTERS="{(g)(G)', "status", "finish_ms"), count, F.lit('}" .'))]

    def lines(rows: DataFrame, first: int, texts: list) -> DataFrame:
        listed = F.explode(F.array(*(F.struct((F.col("n") * 10 + first + k).alias("line_no"), x.alias("line")) for k, x in enumerate(texts))))
        return rows.select(path.alias("path"), listed.alias("x")).select("path", "x.*")

    tasks = a.groupBy("cluster", "job_id", "task_id").agg(F.min("type").alias("type"), F.min("start_ms").alias("a"), F.max("finish_ms").alias("b"), F.min("n").alias("n"))
    of_task = [F.format_string('Task TASKID="%s" TASK_TYPE="%s" START_TIME="%d" .', "task_id", "type", "a"), F.format_string('Task TASKID="%s" TASK_TYPE="%s" TASK_STATUS="SUCCESS" FINISH_TIME="%d" EMPTY="" .', "task_id", "type", "b")]
    jobs = a.groupBy("cluster", "job_id", "user").agg(F.min("start_ms").alias("a"), F.max("finish_ms").alias("b"), F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    of_job = [F.format_string('Job JOBID="%s" JOBNAME="daily \\"x\\"" USER="%s" SUBMIT_TIME="%d" .', "job_id", "user", "a"), F.format_string('Job JOBID="%s" FINISH_TIME="%d" JOB_STATUS="FAILURE" FINISHED_MAPS="%d" TOTAL_MAPS="oops" .', "job_id", "b", "c")]
    return lines(a, 0, tries).union(lines(tasks, 3, of_task)).union(lines(jobs, 5, of_job))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return logs.classify(logs.located(rendered_lines(s, d)))


def _staged_lines(s: SparkSession, d: str) -> DataFrame:
    """The lines, classified once, as both kinds are wanted."""
    return runs.stage_lines(_lines(s, d), f"{work_path(s, 'lines')}/staged")


def _held_attempts(lines: DataFrame) -> DataFrame:
    return merge.join_tasks(merge.sound_attempts(merge.merge_attempts(logs.attempt_lines(lines))), merge.merge_tasks(logs.task_lines(lines)))[0]


_add(
    "log_roundtrip",
    lambda s, d: _held_attempts(_staged_lines(s, d)).select("cluster", "job_id", "task_id", "attempt_id", "type", "status", "start_ms", "finish_ms"),
    f"WITH {_ATTEMPTS} SELECT cluster, job_id, task_id, attempt_id, type, status, start_ms, finish_ms FROM attempts WHERE finish_ms >= start_ms",
)
_add(
    "merge_attempts",
    lambda s, d: excess.derive_times(merge.merge_attempts(logs.attempt_lines(_lines(s, d)))).select("attempt_id", F.round("minutes", 6).alias("minutes"), F.round("cpu_minutes", 6).alias("cpu_minutes")),
    f"WITH {_ATTEMPTS} SELECT attempt_id, round((finish_ms - start_ms) / 60000, 6) AS minutes, round(cpu / 60000, 6) AS cpu_minutes FROM attempts",
)
_add(
    "merge_tasks",
    lambda s, d: merge.merge_tasks(logs.task_lines(_lines(s, d))).select("task_id", "type", "task_status", "start_ms", "finish_ms"),
    f"WITH {_ATTEMPTS} SELECT task_id, min(type) AS type, 'SUCCESS' AS task_status, min(start_ms) AS start_ms, max(finish_ms) AS finish_ms FROM attempts GROUP BY job_id, task_id",
)
_add(
    "merge_jobs",
    lambda s, d: merge.merge_jobs(logs.job_lines(_lines(s, d))).select("cluster", "job_id", "user", "job_name", "job_status", "submit_ms", "finish_ms", "finished_maps", "total_maps"),
    f"""WITH {_ATTEMPTS} SELECT cluster, job_id, "user", 'daily x' AS job_name, 'FAILED' AS job_status, min(start_ms) AS submit_ms, max(finish_ms) AS finish_ms, CAST(count(*) AS INTEGER) AS finished_maps, CAST(NULL AS INTEGER) AS total_maps FROM attempts GROUP BY ALL""",
)
_add(
    "counters_map",
    lambda s, d: merge.merge_attempts(logs.attempt_lines(_lines(s, d))).select("attempt_id", F.col("counters")["SPILLED_RECORDS"].alias("spilled"), F.try_element_at("counters", F.lit("REDUCE_SHUFFLE_BYTES")).alias("bytes")),
    f"WITH {_ATTEMPTS} SELECT attempt_id, spill AS spilled, bytes FROM attempts",
)


# --- logs with flaws: conflicting lines in a second file, lines without ids, orphans, zero times --------


def flawed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rendered_lines, and a later file for each job whose lines say something else, or something useless."""
    a = attempts_from_events(spark, sf_dir).withColumn("n", F.substring("attempt_id", 9, 30).cast("long"))
    path = F.concat(F.lit("/logs2/"), F.col("cluster"), F.lit("/daily/2024/0101/"), F.col("job_id"), F.lit("_more.log"))  # without the queue
    n, prefix = F.col("n"), F.concat(F.initcap("type"), F.lit("Attempt"))
    said = F.concat(
        F.format_string('%s TASK_TYPE="%s" TASKID="%s" TASK_ATTEMPT_ID="%s" START_TIME="%d"', prefix, "type", "task_id", "attempt_id", F.col("start_ms") - 1000),
        F.when(n % 7 == 0, ' TASK_STATUS="KILLED"').otherwise(""),
        F.when(n % 5 == 0, F.format_string(' FINISH_TIME="%d"', F.col("finish_ms") + 60000)).otherwise(' FINISH_TIME="99999999999999999999"'),
        F.when(n % 4 == 0, ' COUNTERS="{(g)(G)[(SPILLED_RECORDS)(x)(5)]}" .').otherwise(" ."),
    )
    cut = F.when(n % 11 == 0, F.format_string('%s TASK_TYPE="%s" TASKID="%s" START_TIME="7"', prefix, "type", "task_id"))
    other = F.when(n % 23 == 0, F.format_string('MapAttempt TASK_TYPE="MAP" TASKID="task_x_m" TASK_ATTEMPT_ID="t%d" START_TIME="7" .', n))
    orphan = F.when(n % 13 == 0, F.format_string('MapAttempt TASK_TYPE="MAP" TASKID="%s" TASK_ATTEMPT_ID="orphan_%d" TASK_STATUS="SUCCESS" START_TIME="5" FINISH_TIME="9" .', F.concat("task_id", F.lit("999")), n))
    zero = F.when(n % 17 == 0, F.format_string('MapAttempt TASK_TYPE="MAP" TASKID="%s" TASK_ATTEMPT_ID="zero_%d" TASK_STATUS="SUCCESS" START_TIME="0" FINISH_TIME="%d" COUNTERS="{(g)(G)[(CPU_MILLISECONDS)(c)(60000)]}" .', "task_id", n, "start_ms"))
    odd = F.when(n % 19 == 0, F.format_string('MapAttempt TASK_TYPE="MAP" TASKID="%s" TASK_ATTEMPT_ID="odd_%d" TASK_STATUS="DONE" START_TIME="5" FINISH_TIME="9" .', "task_id", n))
    back = F.when(n % 29 == 0, F.format_string('MapAttempt TASK_TYPE="MAP" TASKID="%s" TASK_ATTEMPT_ID="back_%d" TASK_STATUS="FAILED" START_TIME="9" FINISH_TIME="5" .', "task_id", n))
    setup = F.when(n % 31 == 0, F.format_string('MapAttempt TASK_TYPE="SETUP" TASKID="%s" TASK_ATTEMPT_ID="setup_%d" START_TIME="5" .', "task_id", n))
    listed = F.explode(F.array(*(F.struct((n * 10 + k).alias("line_no"), x.alias("line")) for k, x in enumerate((said, cut, other, orphan, zero, odd, back, setup)))))
    more = a.select(path.alias("path"), listed.alias("x")).select("path", "x.*").filter("line is not null")
    jobs = a.groupBy("cluster", "job_id").agg(F.min("user").alias("user"))
    renamed = jobs.select(path.alias("path"), F.lit(0).cast("long").alias("line_no"), F.format_string('Late %s USER="%s_late" JOB_QUEUE="q" FINISH_TIME="1"', "job_id", "user").alias("line"))
    return rendered_lines(spark, sf_dir).union(more).union(renamed)


def _flawed_lines(s: SparkSession, d: str) -> DataFrame:
    return logs.classify(logs.located(flawed_lines(s, d)))


_MERGED = (
    _ATTEMPTS
    + """, merged AS (
  SELECT cluster, job_id, task_id, attempt_id, type, CASE WHEN event_id % 7 = 0 THEN 'KILLED' ELSE status END AS status, start_ms, finish_ms + CASE WHEN event_id % 5 = 0 THEN 60000 ELSE 0 END AS finish_ms,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE cpu END AS cpu, CASE WHEN event_id % 4 = 0 THEN 5 ELSE spill END AS spill FROM attempts
  UNION ALL SELECT cluster, job_id, task_id, 'zero_' || event_id, 'MAP', 'SUCCESS', 0, start_ms, 60000, NULL FROM attempts WHERE event_id % 17 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, task_id ORDER BY start_ms, attempt_id) AS rn, max(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, task_id) AS good FROM merged
), parsed AS (
  SELECT cluster, '20240101' AS day, job_id, task_id, attempt_id, replace(job_id, 'job_20240101_', 'user_') || '_late' AS "user", type, status, CASE WHEN good = 1 THEN status <> 'SUCCESS' ELSE rn > 1 END AS excess,
    CASE WHEN start_ms > 0 THEN start_ms END AS start_ms, CASE WHEN start_ms > 0 THEN finish_ms END AS finish_ms, CASE WHEN start_ms > 0 THEN (finish_ms - start_ms) / 60000 END AS minutes, cpu / 60000 AS cpu_minutes, spill
  FROM ranked
)
"""
)
_PARSED = ["cluster", "day", "job_id", "task_id", "attempt_id", "user", "type", "status", "excess", "start_ms", "finish_ms"]


def _parsed_jobs(s: SparkSession, d: str) -> DataFrame:
    """Flawed lines, staged, merged, written as parsed jobs, read back."""
    path = work_path(s, "parsed")
    staged = runs.stage_lines(_flawed_lines(s, d), f"{path}/staged")
    runs.write_jobs(runs.nested_jobs(staged), f"{path}/jobs")
    return runs.read_jobs(s, f"{path}/jobs", ["20240101"])


_add(
    "merge_conflicts",
    lambda s, d: excess.derive_times(merge.sound_attempts(merge.merge_attempts(logs.attempt_lines(_flawed_lines(s, d))))).filter(~F.col("attempt_id").startswith("orphan")).select(
        "attempt_id", "type", "status", "start_ms", "finish_ms", F.round("minutes", 6).alias("minutes"), F.round("cpu_minutes", 6).alias("cpu_minutes"), F.try_element_at("counters", F.lit("SPILLED_RECORDS")).alias("spilled")),
    f"WITH {_MERGED} SELECT attempt_id, type, status, start_ms, finish_ms, round(minutes, 6) AS minutes, round(cpu_minutes, 6) AS cpu_minutes, spill AS spilled FROM parsed",
)
_add(
    "parsed_roundtrip",
    lambda s, d: merge.unnest(_parsed_jobs(s, d)).select(*_PARSED, F.round("minutes", 6).alias("minutes"), F.round("cpu_minutes", 6).alias("cpu_minutes"), F.try_element_at("counters", F.lit("SPILLED_RECORDS")).alias("spilled")),
    f"""WITH {_MERGED} SELECT {", ".join(f'"{c}"' for c in _PARSED)}, round(minutes, 6) AS minutes, round(cpu_minutes, 6) AS cpu_minutes, spill AS spilled FROM parsed""",
)
_add(
    "nested_jobs",
    lambda s, d: _parsed_jobs(s, d).select(
        "job_id", "user", "job_name", "job_queue", "job_status", "submit_ms", "finish_ms", F.size("tasks").cast("long").alias("n_tasks"), F.aggregate("tasks", F.lit(0).cast("long"), lambda x, t: x + F.size(t["attempts"])).alias("n_attempts"),
        F.element_at("tasks", 1)["task_id"].alias("first_task"), F.element_at(F.element_at("tasks", -1)["attempts"], -1)["attempt_id"].alias("last_attempt")),
    f"""WITH {_MERGED}, j AS (SELECT job_id, min(start_ms) AS submit_ms, max(finish_ms) AS finish_ms FROM attempts GROUP BY job_id)
    SELECT p.job_id, any_value(p."user") AS "user", 'daily x' AS job_name, 'q' AS job_queue, 'FAILED' AS job_status, any_value(j.submit_ms) AS submit_ms, any_value(j.finish_ms) AS finish_ms, count(DISTINCT task_id) AS n_tasks, count(*) AS n_attempts,
      min(task_id) AS first_task, max_by(attempt_id, task_id || ' ' || attempt_id) AS last_attempt FROM parsed p JOIN j ON j.job_id = p.job_id GROUP BY p.job_id""",
)
_add(
    "log_rejects",
    lambda s, d: runs.rejects(_flawed_lines(s, d)),
    """SELECT 'attempt' AS kind, reason, count(*) AS n FROM (
      SELECT 'no_attempt_id' AS reason FROM events WHERE event_id % 11 = 0 UNION ALL SELECT 'no_job_id' FROM events WHERE event_id % 23 = 0 UNION ALL SELECT 'no_task' FROM events WHERE event_id % 13 = 0
      UNION ALL SELECT 'no_status' FROM events WHERE event_id % 19 = 0 UNION ALL SELECT 'finish_before_start' FROM events WHERE event_id % 29 = 0) x GROUP BY reason""",
)
_add(
    "job_places",
    lambda s, d: merge.merge_jobs(logs.job_lines(_flawed_lines(s, d))).select("cluster", "day", "job_id", "path"),
    f"""WITH {_ATTEMPTS} SELECT DISTINCT cluster, '20240101' AS day, job_id, '/logs2/' || cluster || '/daily/2024/0101/' || job_id || '_more.log' AS path FROM attempts""",
)
_add(
    "parsed_usage",
    lambda s, d: usage.hourly_usage(merge.unnest(_parsed_jobs(s, d)), True, ("day",)).select("user", "time_ms", "cluster", "excess", "type", "status", "day", "started", "finished", "elapsed_minutes", "spilled_records"),
    f"""WITH {_MERGED}, split AS (SELECT *, least(time_ms + 3600000, finish_ms) - greatest(time_ms, start_ms) AS part_ms
      FROM (SELECT *, unnest(range(start_ms - start_ms % 3600000, finish_ms, 3600000)) AS time_ms FROM parsed WHERE start_ms < finish_ms) x)
    SELECT "user", time_ms, cluster, excess, type, status, day, CAST(sum(CASE WHEN time_ms <= start_ms THEN 1 ELSE 0 END) AS BIGINT) AS started, CAST(sum(CASE WHEN finish_ms <= time_ms + 3600000 THEN 1 ELSE 0 END) AS BIGINT) AS finished,
      CAST(sum(part_ms) AS BIGINT) / 60000 AS elapsed_minutes, CAST(sum(CAST(trunc(part_ms / (finish_ms - start_ms) * spill) AS BIGINT)) AS BIGINT) AS spilled_records FROM split GROUP BY ALL""",
)


def _discovered(s: SparkSession, d: str) -> DataFrame:
    path = work_path(s, "days")
    days = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")
    runs.write_jobs(table(s, d, "events").select(F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta").alias("cluster"), days.alias("day"), "event_id"), path)
    return s.createDataFrame(runs.discover(s, path), "cluster string, day string")


_add("discovered_days", _discovered, "SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS cluster, strftime(ts, '%Y%m%d') AS day FROM events")


def _replaced(s: SparkSession, d: str) -> DataFrame:
    """Usage written as nested records by cluster and day; one cluster's days written again, doubled; read back flat."""
    path, rows = work_path(s, "usage"), usage_from_events(s, d).withColumn("day", F.lit("d1"))
    keys = ["user", "time_ms", "unit", "excess", "type", "status"]
    nested = lambda r: r.select(F.struct(*keys).alias("key"), F.struct("started", "finished", "elapsed_minutes").alias("value"), "cluster", "day")
    usage_files.write_usage(nested(rows), path)
    usage_files.write_usage(nested(rows.filter("cluster = 'alpha'").withColumn("started", F.col("started") * 2)), path)
    return usage_files.read_usage(s, path).filter(F.col("file_name").contains("cluster=")).drop("file_name")


_add(
    "usage_replaced",
    _replaced,
    f"""WITH {_USAGE} SELECT "user", time_ms, unit, excess, type, status, started * CASE WHEN cluster = 'alpha' THEN 2 ELSE 1 END AS started, finished, elapsed_minutes, cluster, 'd1' AS day FROM usage""",
)


def _conf_files(s: SparkSession, d: str) -> DataFrame:
    """Configurations written by cluster and day, read back."""
    path = work_path(s, "confs")
    runs.write_confs(_confs(s, d), path)
    return s.read.parquet(path).select("cluster", F.col("day").cast("string").alias("day"), "job_id", F.map_contains_key("configuration", F.lit("empty")).alias("whole"))


def rendered_confs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    prop = '<property><name>%s</name><value>%s</value></property>'  # noqa: Q000
    queue = F.when(F.col("user_id") % 3 != 0, F.format_string(prop, F.lit("mapred.job.queue.name"), F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string")))).otherwise("")
    twice = F.concat(F.format_string(prop, F.lit("depth"), F.lit("first")), F.format_string(prop, F.lit("depth"), F.concat(F.lit(" n "), F.col("user_id").cast("string"))))
    body = F.concat(F.lit("<configuration>"), queue, twice, F.lit("<property><name>empty</name><value></value></property></configuration>"))
    name = F.concat(F.lit("/logs/"), F.when(F.col("user_id") % 2 == 0, "alpha").otherwise("beta"), F.lit("/daily/main/2024/0101/job_20240101_"), F.col("user_id").cast("string"), F.lit("_conf.xml"))
    return ids.select(name.alias("path"), F.when(F.col("user_id") % 10 == 9, "<configuration><property>").otherwise(body).alias("value"))


def _confs(s: SparkSession, d: str) -> DataFrame:
    return confs.accepted(confs.parse_confs(logs.located(rendered_confs(s, d))))


_CONFS = """confs AS (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS cluster, 'job_20240101_' || user_id AS job_id,
  CASE WHEN user_id % 3 <> 0 THEN 'q' || (user_id % 3) ELSE 'unknown' END AS queue, ' n ' || user_id AS depth, '' AS empty FROM events WHERE user_id % 10 <> 9)"""
_add("conf_map", lambda s, d: _confs(s, d).select("cluster", "job_id", confs.queue(F.col("configuration")).alias("queue"), F.col("configuration")["depth"].alias("depth"), F.col("configuration")["empty"].alias("empty")), f"WITH {_CONFS} SELECT * FROM confs")
_add(
    "job_conf_join",
    lambda s, d: confs.join_confs(merge.merge_jobs(logs.job_lines(_lines(s, d))), _confs(s, d)).select("cluster", "job_id", "user", F.try_element_at("configuration", F.lit("depth")).alias("depth")),
    f'WITH {_CONFS}, {_ATTEMPTS} SELECT j.cluster, j.job_id, j."user", c.depth FROM (SELECT DISTINCT cluster, job_id, "user" FROM attempts) j LEFT JOIN confs c ON c.cluster = j.cluster AND c.job_id = j.job_id',
)

_add("conf_files", _conf_files, f"WITH {_CONFS} SELECT cluster, '20240101' AS day, job_id, true AS whole FROM confs")
_add(
    "conf_rejects",
    lambda s, d: confs.rejected(confs.parse_confs(logs.located(rendered_confs(s, d)))),
    "SELECT DISTINCT '/logs/' || CASE WHEN user_id % 2 = 0 THEN 'alpha' ELSE 'beta' END || '/daily/main/2024/0101/job_20240101_' || user_id || '_conf.xml' AS path, 'malformed' AS reason FROM events WHERE user_id % 10 = 9",
)

# --- presentation ---------------------------------------------------------------------------------


def _series(s: SparkSession, d: str) -> DataFrame:
    rows = usage_from_events(s, d).filter("cluster = 'alpha'")
    return rows.groupBy("user", timefn.bucket(F.col("time_ms"), "DAYS", ZONE).alias("time_ms")).agg(F.sum("started").alias("value"))


_SERIES = f"""WITH {_USAGE}, series AS (SELECT "user", {sql_bucket("time_ms", "DAYS")} AS time_ms, CAST(sum(started) AS BIGINT) AS value FROM usage WHERE cluster = 'alpha' GROUP BY ALL)"""
_add(
    "top_n_others",
    lambda s, d: present.top_and_rest(_series(s, d), TOP),
    f"""{_SERIES}, ranked AS (SELECT "user", row_number() OVER (ORDER BY sum(value) DESC, "user") AS rn FROM series GROUP BY "user"),
    named AS (SELECT "user" AS u, CASE WHEN rn <= {TOP} THEN "user" ELSE (SELECT count(*) FROM ranked WHERE rn > {TOP}) || ' users' END AS "user" FROM ranked),
    folded AS (SELECT n."user", s.time_ms, CAST(sum(s.value) AS BIGINT) AS value FROM series s JOIN named n ON n.u = s."user" GROUP BY ALL)
    SELECT "user", time_ms, value, CAST(sum(value) OVER (PARTITION BY "user") AS BIGINT) AS total FROM folded""",
)
_add(
    "last7_table",
    lambda s, d: present.last_periods(_series(s, d), "totalStarted").select("user", F.array_join(F.transform("recent", lambda x: x.cast("string")), ",").alias("recent"), "total"),
    f"""{_SERIES}, shown AS (SELECT DISTINCT time_ms FROM series ORDER BY time_ms DESC LIMIT 7)
    SELECT s."user", coalesce(string_agg(CAST(CASE WHEN t.time_ms IS NOT NULL THEN s.value END AS VARCHAR), ',' ORDER BY s.time_ms), '') AS recent, CAST(sum(s.value) AS BIGINT) AS total
    FROM series s LEFT JOIN shown t ON t.time_ms = s.time_ms GROUP BY s."user" """,
)
_PIVOT = ", ".join(f"""round(max(CASE WHEN "user" = '{u}' THEN value END) / 60, 1) AS {u}""" for u in USERS)
_add(
    "csv_pivot",
    lambda s, d: present.csv_pivot(_dense(s, d).withColumn("value", F.round("value", 6)), list(USERS), "minutesTotal", ZONE),
    f"""{_GRID}, grid AS ({_GRID_ROWS}), tidy AS (SELECT "user", time_ms, round(value, 6) AS value FROM grid) SELECT strftime({_sql_local("time_ms", ZONE)}, '%Y-%m-%d') AS time, {_PIVOT} FROM tidy GROUP BY time_ms""",
)

# --- listings -------------------------------------------------------------------------------------


def _manifest(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file_name"), F.col("event_id").alias("e"), F.col("ts").cast("timestamp").alias("modified"))
    now = rows.filter("e % 3 <> 0").withColumn("modified", F.when(F.col("e") % 7 == 0, F.col("modified") + F.expr("interval 2 seconds")).otherwise(F.date_trunc("second", "modified")))
    return listing.diff(now, rows.filter("e % 5 <> 0"))


_add(
    "manifest_diff",
    _manifest,
    """SELECT 'f' || event_id AS file_name, CASE WHEN event_id % 5 = 0 THEN 'unprocessed' WHEN event_id % 3 = 0 THEN 'deleted' WHEN event_id % 7 = 0 THEN 'modified' ELSE 'processed' END AS state
    FROM events WHERE event_id % 3 <> 0 OR event_id % 5 <> 0""",
)


def _upload(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select(F.col("event_id").alias("e"), F.unix_millis(F.col("ts").cast("timestamp")).alias("modified_ms"))
    name = F.concat(F.lit("job_1_"), F.col("e").cast("string"))
    found = rows.select(F.concat(F.lit("/local/"), name, F.when(F.col("e") % 13 == 0, "_x.crc").otherwise("_x.log")).alias("file_name"), "modified_ms")
    named = rows.filter("e % 4 <> 0").select(F.concat(F.lit("/local/"), name, F.lit("_conf.xml")).alias("file_name"), F.when(F.col("e") % 2 == 0, "main").alias("queue"))
    stamp = F.timestamp_millis("modified_ms")
    there = rows.filter("e % 6 = 1").select(F.concat(F.lit("/up/g/daily/unknown/"), F.date_format(stamp, "yyyy/MMdd/"), name, F.lit("_x.log")).alias("target"))
    return listing.to_upload(found, named, there, "g", END, 10, "/up/")


_add(
    "upload_anti_join",
    _upload,
    f"""WITH e AS (SELECT event_id AS e, epoch_us(ts) // 1000 AS ms, 'job_1_' || event_id AS name FROM events)
    SELECT '/local/' || name || '_x.log' AS file_name, '/local/' || name || '_conf.xml' AS conf_name,
      '/up/g/daily/' || CASE WHEN e % 2 = 0 THEN 'main' ELSE 'unknown' END || strftime(make_timestamp(ms * 1000), '/%Y/%m%d/') || name || '_x.log' AS target
    FROM e WHERE e % 13 <> 0 AND e % 4 <> 0 AND ms >= {END} - 864000000 AND ms < {END} - 86400000 AND e % 6 <> 1""",
)


def _totals(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file_name"), F.col("ts").cast("timestamp").alias("modified"), (F.col("user_id") * 10).alias("bytes"))
    return listing.total_bytes(rows)


_add("input_totals", _totals, "SELECT CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT user_id, user_id * 10 AS bytes FROM events) x")


def _loaded(s: SparkSession, d: str) -> DataFrame:
    """Rows of files that are new or changed are read, those of changed and deleted files go."""
    rows = table(s, d, "events").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file_name"), F.col("event_id").alias("e"), F.col("ts").cast("timestamp").alias("modified"))
    now = rows.filter("e % 3 <> 0").withColumn("modified", F.when(F.col("e") % 7 == 0, F.col("modified") + F.expr("interval 2 seconds")).otherwise(F.col("modified")))
    held = rows.filter("e % 5 <> 0")
    old = held.select("file_name", F.explode(F.array("e", F.col("e") + 1)).alias("v"))
    return runs.load(s, now.select("file_name", "modified"), held.select("file_name", "modified"), old, lambda f: f.select("file_name", (-F.substring("file_name", 2, 30).cast("long")).alias("v")))[0]


_add(
    "manifest_load",
    _loaded,
    """SELECT 'f' || event_id AS file_name, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN -event_id ELSE event_id + k END AS v FROM events, (VALUES (0), (1)) x(k)
    WHERE event_id % 3 <> 0 AND (k = 0 OR NOT (event_id % 5 = 0 OR event_id % 7 = 0))""",
)

# --- more of the cube, of times and of what is shown ----------------------------------------------

_add(
    "cube_aggregate",
    lambda s, d: _cube(s, d).aggregate(_cube(s, d).filter_on("cluster", lambda c: c == "alpha").df).df,
    f"{_CUBE_SQL} SELECT cluster, \"user\", type, started * CASE WHEN cluster = 'alpha' THEN 2 ELSE 1 END AS started, spilled_records * CASE WHEN cluster = 'alpha' THEN 2 ELSE 1 END AS spilled_records FROM cube",
)
_add(
    "cube_put",
    lambda s, d: _cube(s, d).put(_cube(s, d).filter_on("cluster", lambda c: c == "alpha").df.withColumn("cluster", F.lit("gamma"))).df,
    f"{_CUBE_SQL} SELECT * FROM cube UNION ALL SELECT 'gamma', \"user\", type, started, spilled_records FROM cube WHERE cluster = 'alpha'",
)


def _unpacked_cube(s: SparkSession, d: str) -> DataFrame:
    path, cube = f"{work_path(s, 'cube')}/cube", _cube(s, d)
    cube.pack(path)
    return UsageCube.unpack(s, path, cube.dims, cube.measures).df


_add("cube_unpack", _unpacked_cube, f"{_CUBE_SQL} SELECT * FROM cube")
_add(
    "prorate_shuffle",
    lambda s, d: usage.hourly_usage(attempts_from_events(s, d), True).select("user", "time_ms", "cluster", "excess", "type", "status", "reduce_shuffle_bytes"),
    f"""WITH {_USAGE} SELECT "user", time_ms, cluster, excess, type, status, CAST(sum(CAST(trunc(part_ms / (finish_ms - start_ms) * bytes) AS BIGINT)) AS BIGINT) AS reduce_shuffle_bytes FROM split GROUP BY ALL""",
)
_add("floor_day", lambda s, d: usage_from_events(s, d).select(timefn.floor_day(F.col("time_ms")).alias("day_ms")).distinct(), f"WITH {_USAGE} SELECT DISTINCT epoch_us(date_trunc('day', make_timestamp(time_ms * 1000))) // 1000 AS day_ms FROM usage")


def _ticks(s: SparkSession, d: str) -> DataFrame:
    ms = F.col("time_ms")
    rows = usage_from_orders(s, d).select("time_ms").distinct().select("time_ms", F.explode(F.array(ms, timefn.bucket(ms, "DAYS", ZONE), timefn.bucket(ms, "MONTHS", ZONE))).alias("tick_ms"))
    return rows.select("tick_ms").distinct().select("tick_ms", *(timefn.ceil_tick(F.col("tick_ms"), u, ZONE).alias(u.lower()) for u in ("DAYS", "WEEKS", "MONTHS", "QUARTERS")))


def _sql_tick(unit: str) -> str:
    step = {"DAYS": "1 DAY", "WEEKS": "7 DAY", "MONTHS": "1 MONTH", "QUARTERS": "3 MONTH"}[unit]
    here, after = sql_bucket("tick_ms", unit), _sql_ms(f"{_sql_start(_sql_local('tick_ms', ZONE), unit)} + INTERVAL {step}", ZONE)
    return f"CASE WHEN {here} = tick_ms THEN tick_ms ELSE {after} END AS {unit.lower()}"


_add(
    "tick_ceiling",
    _ticks,
    f"""WITH {_ORDERS}, t AS (SELECT DISTINCT unnest([time_ms, {sql_bucket("time_ms", "DAYS")}, {sql_bucket("time_ms", "MONTHS")}]) AS tick_ms FROM usage)
    SELECT tick_ms, {", ".join(_sql_tick(u) for u in ("DAYS", "WEEKS", "MONTHS", "QUARTERS"))} FROM t""",
)
_add(
    "period_labels",
    lambda s, d: usage_from_orders(s, d).select("time_ms").distinct().select("time_ms", *(timefn.label(F.col("time_ms"), u, ZONE).alias(u.lower()) for u in ("DAYS", "MONTHS", "QUARTERS")), timefn.iso_day(F.col("time_ms"), ZONE).alias("iso")),
    f"""WITH {_ORDERS}, t AS (SELECT DISTINCT time_ms, {_sql_local("time_ms", ZONE)} AS l FROM usage)
    SELECT time_ms, strftime(l, '%b ') || day(l) || CASE WHEN day(l) IN (11, 12, 13) THEN 'th' WHEN day(l) % 10 = 1 THEN 'st' WHEN day(l) % 10 = 2 THEN 'nd' WHEN day(l) % 10 = 3 THEN 'rd' ELSE 'th' END AS days,
      strftime(l, '%b %Y') AS months, 'Q' || quarter(l) || ' ' || year(l) AS quarters, strftime(l, '%Y-%m-%d') AS iso FROM t""",
)


def _relative(s: SparkSession, d: str) -> DataFrame:
    """Ranges before the last moments of each month that events are in, and one before a leap day's."""
    rows = [(now, unit, *timefn.relative_range(now, k, unit)) for now in (END, 1_709_164_800_000, 1_711_800_000_000) for unit, k in (("DAYS", 10), ("WEEKS", 3), ("MONTHS", 1), ("MONTHS", 13))]
    return s.createDataFrame(rows, "now_ms long, unit string, start_ms long, end_ms long")


_add(
    "relative_range",
    _relative,
    f"""SELECT now_ms, unit, epoch_us(make_timestamp(now_ms * 1000) - CASE unit WHEN 'DAYS' THEN INTERVAL 10 DAY WHEN 'WEEKS' THEN INTERVAL 21 DAY ELSE to_months(k) END) // 1000 AS start_ms, now_ms AS end_ms
    FROM (VALUES (CAST({END} AS BIGINT)), (1709164800000), (1711800000000)) n(now_ms), (VALUES ('DAYS', 0), ('WEEKS', 0), ('MONTHS', 1), ('MONTHS', 13)) u(unit, k)""",
)
_add(
    "csv_compat",
    lambda s, d: present.csv_pivot(query.per_user(usage_from_events(s, d), query.Request("alpha", "totalStarted", START, END, "DAYS", ZONE, USERS)), list(USERS), "totalStarted", ZONE, True),
    f"""{_GRID}, grid AS ({_GRID_ROWS}), counts AS (SELECT "user", {sql_bucket("time_ms", "DAYS")} AS time_ms, CAST(sum(started) AS BIGINT) AS started FROM usage WHERE cluster = 'alpha' GROUP BY ALL)
    SELECT strftime({_sql_local("g.time_ms", ZONE)}, '%Y-%m-%d') AS time, {", ".join(f"""round(max(CASE WHEN g."user" = '{u}' THEN coalesce(c.started, 0) END) / 60, 1) AS {u}""" for u in USERS)}
    FROM grid g LEFT JOIN counts c ON c."user" = g."user" AND c.time_ms = g.time_ms GROUP BY g.time_ms""",
)
_add(
    "table_page",
    lambda s, d: present.last_periods(_series(s, d), "totalStarted", 3, 10, 5, "user", False).select("user", F.array_join(F.transform("recent", lambda x: x.cast("string")), ",").alias("recent"), "total"),
    f"""{_SERIES}, shown AS (SELECT DISTINCT time_ms FROM series ORDER BY time_ms DESC LIMIT 3)
    SELECT s."user", coalesce(string_agg(CAST(CASE WHEN t.time_ms IS NOT NULL THEN s.value END AS VARCHAR), ',' ORDER BY s.time_ms), '') AS recent, CAST(sum(s.value) AS BIGINT) AS total
    FROM series s LEFT JOIN shown t ON t.time_ms = s.time_ms GROUP BY s."user" ORDER BY s."user" LIMIT 10 OFFSET 5""",
)


def _graph(s: SparkSession, d: str) -> DataFrame:
    """The three users that are named and all others of the cluster, by day; two of them are drawn."""
    every = _series(s, d)
    others = every.filter(~F.col("user").isin(list(USERS))).groupBy("time_ms").agg(F.sum("value").alias("value"))
    return present.graph_series(every.filter(F.col("user").isin(list(USERS))), "totalStarted", others, 7, 2)


_add(
    "graph_series",
    _graph,
    f"""{_SERIES}, totals AS (SELECT "user", sum(value) AS total, row_number() OVER (ORDER BY sum(value) DESC, "user") AS rn FROM series WHERE "user" IN ({_IN}) GROUP BY "user"),
    labelled AS (SELECT 2 AS layer, s."user", s.time_ms, s.value, t.total FROM series s JOIN totals t ON t."user" = s."user" WHERE t.rn <= 2
      UNION ALL SELECT 1, (SELECT count(*) - 2 FROM totals) || ' users', s.time_ms, sum(s.value), 0 FROM series s JOIN totals t ON t."user" = s."user" WHERE t.rn > 2 GROUP BY s.time_ms
      UNION ALL SELECT 0, '7 more users', time_ms, sum(value), 0 FROM series WHERE "user" NOT IN ({_IN}) GROUP BY time_ms)
    SELECT CAST(dense_rank() OVER (ORDER BY layer, total, "user" DESC) - 1 AS INTEGER) AS position, "user", time_ms, CAST(value AS BIGINT) AS value, layer = 0 AS disabled FROM labelled""",
)


def _json(s: SparkSession, d: str) -> DataFrame:
    """The JSON answer to a request, taken apart again."""
    schema = "cluster string, times array<long>, users array<struct<user:string,data:array<double>>>, users_aggregated array<double>, num_aggregated_users int"
    said = s.createDataFrame([(query.response(usage_from_events(s, d), _REQUEST),)], "j string").select(F.from_json("j", schema).alias("j")).select("j.*")
    aggregate = F.struct(F.concat(F.col("num_aggregated_users").cast("string"), F.lit(" users")).alias("user"), F.col("users_aggregated").alias("data"))
    rows = said.select("cluster", "times", F.explode(F.concat("users", F.array(aggregate))).alias("u"))
    return rows.select("cluster", "u.user", F.explode(F.arrays_zip("times", F.col("u.data").alias("value"))).alias("x")).select("cluster", "user", F.col("x.times").alias("time_ms"), F.round("x.value", 6).alias("value"))


_add(
    "json_response",
    _json,
    f"""{_GRID}, grid AS ({_GRID_ROWS}) SELECT 'alpha' AS cluster, "user", time_ms, round(value, 6) AS value FROM grid
    UNION ALL SELECT 'alpha', '2 users', time_ms, round(sum(value), 6) FROM grid WHERE "user" IN ('{USERS[0]}', '{USERS[1]}') GROUP BY time_ms""",
)
