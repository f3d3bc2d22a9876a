"""Schemas of the working tables, as DDL."""

from __future__ import annotations

TASK_TYPES = ("MAP", "REDUCE")
STATUSES = ("SUCCESS", "FAILED", "KILLED")
UNIT = "HOURS"


ATTEMPTS = (
    "cluster string, job_id string, task_id string, attempt_id string, user string, type string, status string, "
    "start_ms bigint, finish_ms bigint, shuffle_finished_ms bigint, sort_finished_ms bigint, counters map<string,bigint>, "
    "excess boolean, minutes double, cpu_minutes double"
)
USAGE_HOURLY = (
    "user string, time_ms bigint, unit string, cluster string, excess boolean, type string, status string, "
    "started bigint, finished bigint, elapsed_minutes double, cpu_minutes double, spilled_records bigint, reduce_shuffle_bytes bigint"
)
JOB_CONF = "path string, cluster string, job_id string, configuration map<string,string>"
LISTING = "file_name string, modified timestamp, bytes bigint"
MANIFEST = "file_name string, modified timestamp"
