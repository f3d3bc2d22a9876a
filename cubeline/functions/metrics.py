"""The catalogue of metrics: which rows count, and which measure is summed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MEASURES = ("elapsed_minutes", "cpu_minutes", "started", "finished", "reduce_shuffle_bytes")
DIMENSIONS = ("user", "time_ms", "cluster", "excess", "type", "status")

# Metric, (dimension, value) that rows must have, measure.
METRICS: dict[str, tuple[tuple[tuple[str, object], ...], str]] = {
    "minutesTotal": ((), "elapsed_minutes"),
    "minutesMap": ((("type", "MAP"),), "elapsed_minutes"),
    "minutesReduce": ((("type", "REDUCE"),), "elapsed_minutes"),
    "minutesExcessTotal": ((("excess", True),), "elapsed_minutes"),
    "minutesExcessMap": ((("type", "MAP"), ("excess", True)), "elapsed_minutes"),
    "minutesExcessReduce": ((("type", "REDUCE"), ("excess", True)), "elapsed_minutes"),
    "minutesSuccess": ((("status", "SUCCESS"),), "elapsed_minutes"),
    "minutesFailed": ((("status", "FAILED"),), "elapsed_minutes"),
    "minutesKilled": ((("status", "KILLED"),), "elapsed_minutes"),
    "cpuTotal": ((), "cpu_minutes"),
    "totalStarted": ((), "started"),
    "totalFinished": ((), "finished"),
    "mapStarted": ((("type", "MAP"),), "started"),
    "mapFinished": ((("type", "MAP"),), "finished"),
    "reduceStarted": ((("type", "REDUCE"),), "started"),
    "reduceFinished": ((("type", "REDUCE"),), "finished"),
    "successStarted": ((("status", "SUCCESS"),), "started"),
    "successFinished": ((("status", "SUCCESS"),), "finished"),
    "failedStarted": ((("status", "FAILED"),), "started"),
    "failedFinished": ((("status", "FAILED"),), "finished"),
    "killedStarted": ((("status", "KILLED"),), "started"),
    "killedFinished": ((("status", "KILLED"),), "finished"),
    "reduceShuffleBytes": ((("type", "REDUCE"),), "reduce_shuffle_bytes"),
}

# The metrics that a dashboard offers, with their names.
LABELS = {
    "minutesTotal": "Total Hours",
    "minutesMap": "Map Hours",
    "minutesReduce": "Reduce Hours",
    "minutesExcessTotal": "Total Hours (excess)",
    "minutesExcessMap": "Map Hours (excess)",
    "minutesExcessReduce": "Reduce Hours (excess)",
    "minutesSuccess": "Successful Hours",
    "minutesFailed": "Failed Hours",
    "minutesKilled": "Killed Hours",
    "cpuTotal": "CPU Hours",
    "totalStarted": "Tasks",
    "mapStarted": "Maps",
    "reduceStarted": "Reduces",
    "successFinished": "Successful",
    "failedFinished": "Failed",
    "killedFinished": "Killed",
    "reduceShuffleBytes": "Reduce Shuffle Bytes",
}


def _known(metric: str) -> tuple[tuple[tuple[str, object], ...], str]:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return METRICS[metric]


def measure(metric: str) -> str:
    return _known(metric)[1]


def conditions(metric: str) -> tuple[tuple[str, object], ...]:
    return _known(metric)[0]


def equal_all(pairs) -> Column:
    """dimension = value, for all pairs; true without any."""
    return reduce(lambda a, b: a & b, [F.col(d) == F.lit(v) for d, v in pairs], F.lit(True))


def predicate(metric: str) -> Column:
    return equal_all(conditions(metric))


def in_minutes(metric: str) -> bool:
    return measure(metric).endswith("_minutes")


def zero(metric: str) -> Column:
    """What an empty slot shows."""
    return F.lit(0.0) if in_minutes(metric) else F.lit(0).cast("long")


def shown(metric: str, value: Column, compat: bool = False) -> Column:
    """Minutes as hours to one decimal; counts and bytes as they are, or, if compat, divided alike."""
    return F.round(value / 60, 1) if compat or in_minutes(metric) else value
